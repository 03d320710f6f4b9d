"""Key text, its hash bucket, and typed predicates back from key text."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Joins the parts of a compound key (fixed value of the index format).
SEPARATOR = "\x1f"
_BOUNDS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def key_text(name: str, kind: T.DataType) -> Column:
    """The text by which a value is a key; null stays null."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return c.cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c.cast("timestamp"), _STAMP)
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise ValueError(f"unsupported key column type: {name} is {kind.simpleString()}")
    return c.cast("string")


def require(schema: T.StructType, columns: Sequence[str]) -> None:
    for c in columns:
        if c not in schema.names:
            raise ValueError(f"missing key column `{c}`")


def key_expr(schema: T.StructType, columns: Sequence[str]) -> Column:
    """The encoded key; null if any part is null, so that the row belongs to no key."""
    require(schema, columns)
    parts: list[Column] = []
    for c in columns:
        parts += [F.lit(SEPARATOR)] * bool(parts) + [key_text(c, schema[c].dataType)]
    return F.concat(*parts)


def encode_key(parts: Sequence[str]) -> str:
    return SEPARATOR.join(parts)


def encode_cli_key(text: str) -> str:
    """`a||b` or an encoded key."""
    return text if SEPARATOR in text else text.replace("||", SEPARATOR)


def bucket_of(key: str, buckets: int) -> int:
    return int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big") % buckets


def bucket_expr(key: Column, buckets: int) -> Column:
    """The same as bucket_of, in Spark."""
    head = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(buckets).cast("decimal(20,0)")).cast("int")


def _part(name: str, kind: T.DataType, text: str) -> Column:
    c, never = F.col(f"`{name}`"), F.lit(False)
    if isinstance(kind, T.StringType):
        return c == F.lit(text)
    for t, bits in _BOUNDS.items():
        if isinstance(kind, t):
            if not re.fullmatch(r"-?(0|[1-9]\d*)", text) or text == "-0":
                return never
            v = int(text)
            return c == F.lit(v).cast(kind) if -(1 << bits) <= v < 1 << bits else never
    if isinstance(kind, T.BooleanType):
        return c == F.lit(text == "true") if text in ("true", "false") else never
    if isinstance(kind, T.DateType):
        try:
            day = dt.date.fromisoformat(text)
        except ValueError:
            return never
        return c == F.lit(day) if day.isoformat() == text else never
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        try:
            at = dt.datetime.strptime(text, "%Y-%m-%dT%H:%M:%S.%fZ")
        except ValueError:
            return never
        if not re.search(r"\.\d{3}Z$", text):
            return never
        # key text has milliseconds; the column may have microseconds
        low, high = (F.lit(f"{x:%Y-%m-%d %H:%M:%S.%f}").cast("timestamp_ntz" if isinstance(kind, T.TimestampNTZType) else "timestamp") for x in (at, at + dt.timedelta(milliseconds=1)))
        return (c >= low) & (c < high)
    return key_text(name, kind) == F.lit(text)


def typed_any(schema: T.StructType, columns: Sequence[str], keys: Sequence[str]) -> Column:
    """Rows of any of some keys: one IN where the key is one column of text or integers."""
    if len(columns) == 1 and isinstance(schema[columns[0]].dataType, (T.StringType, *_BOUNDS)):
        kind, c = schema[columns[0]].dataType, F.col(f"`{columns[0]}`")
        if isinstance(kind, T.StringType):
            return c.isin(list(keys))
        bits = next(b for t, b in _BOUNDS.items() if isinstance(kind, t))
        fit = [int(k) for k in keys if re.fullmatch(r"-?(0|[1-9]\d*)", k) and k != "-0" and -(1 << bits) <= int(k) < 1 << bits]
        return c.isin([F.lit(v).cast(kind) for v in fit]) if fit else F.lit(False)
    out = F.lit(False)
    for k in keys:
        out = out | typed_predicate(schema, columns, k)
    return out


def typed_predicate(schema: T.StructType, columns: Sequence[str], key: str) -> Column:
    """Rows of a key, by comparisons with typed literals, which reach the Parquet scan; a text that no value has matches nothing."""
    require(schema, columns)
    parts = key.split(SEPARATOR) if len(columns) > 1 else [key]
    if len(parts) != len(columns):
        # a part may hold the separator itself: compare the encoded text
        return key_expr(schema, columns) == F.lit(key)
    out = None
    for c, p in zip(columns, parts):
        test = _part(c, schema[c].dataType, p)
        out = test if out is None else out & test
    return out
