"""Errors with stable codes; the HTTP daemon shows code, message and extra."""

from __future__ import annotations


class LodestoneError(Exception):
    code = "internal"

    def __init__(self, message: str, **extra):
        super().__init__(message)
        self.extra = extra


class StaleFile(LodestoneError):
    code = "stale_file_identity"


class RemoteStaleFile(StaleFile):
    code = "s3_identity_mismatch"


class IndexLocked(LodestoneError):
    pass


class UnsupportedFormat(LodestoneError):
    pass


class BadRequest(LodestoneError):
    code = "bad_request"


class CatalogError(LodestoneError):
    code = "catalog_error"


class UnsupportedDeletes(LodestoneError):
    code = "iceberg_unsupported_deletes"


class SqlScopeError(LodestoneError):
    code = "bad_request"
