"""Milliseconds and time arguments."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DAY_MS = 86_400_000


def millis(name: str | Column, kind: T.DataType) -> Column:
    """Unix milliseconds of a time column, cut toward zero; integers are taken as milliseconds."""
    c = F.col(f"`{name}`") if isinstance(name, str) else name
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * _DAY_MS
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return whole_div(F.unix_micros(c.cast("timestamp")), 1000)
    return c.cast("long")


def whole_div(c: Column, by: int) -> Column:
    """Integer division toward zero."""
    rest = c % by  # takes the sign of c
    return ((c - rest).cast("decimal(20,0)") / by).cast("long")


def parse_time_ms(text: str, end_of_day: bool = False) -> int:
    """Integer milliseconds, YYYY-MM-DD (its first or last millisecond, UTC) or RFC 3339."""
    text = text.strip()
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        day = dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)
        return int(day.timestamp()) * 1000 + (_DAY_MS - 1 if end_of_day else 0)
    try:
        at = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"invalid time `{text}`") from None
    if at.tzinfo is None:
        raise ValueError(f"invalid time `{text}`: it has no zone")
    return (at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(milliseconds=1)
