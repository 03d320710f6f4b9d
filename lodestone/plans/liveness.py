"""Which index entries are live, as one pure function of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_entries(entries: DataFrame, files: DataFrame | None, forgotten: DataFrame | None, tombstones: bool = True) -> DataFrame:
    """The live ones of entries (key, seq, file_path, tombstone, ...).

    files: events (file_path, seq, snapshot boolean, role: 'live' or 'dropped'); forgotten: key.
    An entry of a file is dead
    - if the file is dropped by a later fragment, or by the same one if that is a plain fragment (there adding comes first);
    - if a later snapshot fragment lists the file;
    - if its key has a later tombstone, or is forgotten.
    Both file rules say that the entry's seq is less than some number per file, so one join decides them. Without files (no file
    was dropped or superseded), without forgotten keys or without tombstones, their rule needs no join.
    """
    out = entries.filter("not tombstone") if tombstones else entries
    if files is not None:
        floor = F.when((F.col("role") == "dropped") & ~F.col("snapshot"), F.col("seq") + 1).when((F.col("role") == "dropped") | F.col("snapshot"), F.col("seq"))
        floors = files.select("file_path", floor.alias("f")).filter("f is not null").groupBy("file_path").agg(F.max("f").alias("file_floor"))
        out = out.join(floors, "file_path", "left").filter("file_floor is null or seq >= file_floor")
    if tombstones:
        stones = entries.filter("tombstone").groupBy("key").agg(F.max("seq").alias("key_floor"))
        out = out.join(stones, "key", "left").filter("key_floor is null or seq > key_floor")
    if forgotten is not None:
        out = out.join(forgotten.select("key").distinct(), "key", "left_anti")
    return out.select(*entries.columns)


def last_wins(entries: DataFrame) -> DataFrame:
    """Of the entries of one (key, file), the last; entries of one seq are one."""
    rest = [c for c in entries.columns if c not in ("key", "file_path")]
    out = entries.groupBy("key", "file_path").agg(F.max_by(F.struct(*rest), "seq").alias("x"))  # combines map-side, unlike a window
    return out.select("key", "file_path", "x.*").select(*entries.columns)
