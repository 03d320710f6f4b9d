"""Small files and listings through Hadoop's file systems, so that an index can be wherever Spark can write."""

from __future__ import annotations

import contextlib
import fcntl
import re
import time
from pathlib import Path

from pyspark.sql import SparkSession

from ..errors import IndexLocked


class Fs:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def _p(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(name if re.match(r"/|[a-z][a-z0-9+.-]*:/", name) else self.path(name))
        return p.getFileSystem(self._conf), p

    def exists(self, name: str) -> bool:
        fs, p = self._p(name)
        return fs.exists(p)

    def read(self, name: str) -> str:
        fs, p = self._p(name)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: a temporary file, then a rename over the old one."""
        fs, p = self._p(name)
        tmp = self._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self._conf)
        opts = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        opts[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(tmp, p, opts)

    def delete(self, name: str) -> None:
        fs, p = self._p(name)
        fs.delete(p, True)

    def list(self, name: str) -> list[str]:
        fs, p = self._p(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def status(self, name: str) -> tuple[int, int, str | None] | None:
        """Size, modification time in ms and, where the file system has one, etag; or None."""
        fs, p = self._p(name)
        if not fs.exists(p):
            return None
        s = fs.getFileStatus(p)
        tagged = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.EtagSource").isInstance(s)
        return s.getLen(), s.getModificationTime(), s.getEtag() if tagged else None

    def rename(self, old: str, new: str) -> None:
        fs, p = self._p(old)
        if not fs.rename(p, self._p(new)[1]):
            raise OSError(f"cannot rename {old} to {new}")

    @contextlib.contextmanager
    def lock(self, name: str = ".lock", wait_s: float = 0.2):
        """One writer at a time; IndexLocked if another has it for longer than wait_s."""
        local = self.root.removeprefix("file:") if self.root[:1] == "/" or self.root.startswith("file:") else None
        until = time.monotonic() + wait_s
        if local is not None:
            file = Path("/" + local.lstrip("/")) / name
            file.parent.mkdir(parents=True, exist_ok=True)
            with file.open("w") as f:
                while True:
                    try:
                        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                        break
                    except BlockingIOError:
                        if time.monotonic() > until:
                            raise IndexLocked("index lock is held by another writer") from None
                        time.sleep(0.02)
                yield
            return
        fs, p = self._p(name)
        while True:
            try:
                fs.create(p, False).close()
                break
            except Exception:
                if time.monotonic() > until:
                    raise IndexLocked("index lock is held by another writer") from None
                time.sleep(0.02)
        try:
            yield
        finally:
            fs.delete(p, False)
