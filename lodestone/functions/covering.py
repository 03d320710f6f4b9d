"""Covering values: what the index keeps per (key, file) so that some questions need no data file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .times import millis

#: total is exact; integers and decimals of up to 6 places are summed without rounding.
TYPE = "struct<value_count:bigint,total:decimal(38,6),min_ts:bigint,max_ts:bigint>"
_TOTAL = "decimal(38,6)"


@dataclass(frozen=True)
class Covering:
    """What is counted and summed. shape flat: a value per row; nested: a list of structs per row; blob: JSON with such a list."""

    time: str | None = "timestamp"
    measure: str | None = "duration_ms"
    shape: str = "flat"
    items: str = "listens"
    payload: str = "payload"

    @staticmethod
    def sniff(schema: T.StructType, time: str | None = "timestamp", measure: str | None = "duration_ms") -> Covering:
        """The shape that a table's columns tell."""
        if "payload" in schema.names and "track_uri" not in schema.names:
            return Covering(time, measure, "blob")
        if "listens" in schema.names:
            return Covering(time, measure, "nested")
        if not {x for x in (time, measure) if x} & set(schema.names):
            raise ValueError("covering needs a time column, a measure, a list or a payload")
        return Covering(time if time in schema.names else None, measure if measure in schema.names else None)


_BLOB = "struct<{items}:array<struct<timestamp_ms:bigint,timestamp:bigint,track_uri:string,duration_ms:bigint>>>"


def blob_items(payload: Column, items: str = "listens") -> Column:
    """The items of a JSON payload, null if there is no such list."""
    return F.from_json(payload.cast("string"), _BLOB.format(items=items))[items]


def _positive(c: Column) -> Column:
    return F.greatest(F.coalesce(c.cast(_TOTAL), F.lit(0).cast(_TOTAL)), F.lit(0).cast(_TOTAL))


def _span(values: Column) -> tuple[Column, Column]:
    return F.array_min(F.filter(values, lambda x: x.isNotNull())), F.array_max(F.filter(values, lambda x: x.isNotNull()))


def columns(c: Covering, schema: T.StructType) -> dict[str, Column]:
    """Per row: _n values, their _total, _lo and _hi time in ms. Group with aggregate()."""
    zero, none = F.lit(0).cast(_TOTAL), F.lit(None).cast("long")
    if c.shape == "flat":
        ts = millis(c.time, schema[c.time].dataType) if c.time else none
        return {"_n": F.lit(1).cast("long"), "_total": _positive(F.col(f"`{c.measure}`")) if c.measure else zero, "_lo": ts, "_hi": ts}
    if c.shape == "nested":
        items = F.col(f"`{c.items}`")
        kind = schema[c.items].dataType
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType):
            return {"_n": F.lit(1).cast("long"), "_total": zero, "_lo": none, "_hi": none}
        item = kind.elementType
        when = F.transform(items, lambda x: millis(x[c.time], item[c.time].dataType)) if c.time in item.names else None
        much = F.transform(items, lambda x: _positive(x[c.measure])) if c.measure in item.names else None
        n = F.coalesce(F.when(items.isNotNull(), F.size(items)), F.lit(0)).cast("long")
    else:
        items = blob_items(F.col(f"`{c.payload}`"), c.items)
        when = F.transform(items, lambda x: F.coalesce(x["timestamp_ms"], x["timestamp"]))
        much = F.transform(items, lambda x: _positive(x["duration_ms"]))
        n = F.coalesce(F.when(items.isNotNull(), F.size(items)), F.lit(1)).cast("long")
    lo, hi = _span(when) if when is not None else (none, none)
    total = F.coalesce(F.aggregate(much, zero, lambda s, x: (s + x).cast(_TOTAL)), zero) if much is not None else zero
    return {"_n": n, "_total": total, "_lo": lo, "_hi": hi}


def aggregate() -> Column:
    """The covering struct of a group of rows that have columns()."""
    return F.struct(
        F.sum("_n").alias("value_count"),
        F.sum("_total").cast(_TOTAL).alias("total"),
        F.min("_lo").alias("min_ts"),
        F.max("_hi").alias("max_ts"),
    ).cast(TYPE)
