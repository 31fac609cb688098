"""Schedules in prose: festival ranges, weekday series, date lists, single dates."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

import pandas as pd
from dateutil import parser
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: spellings of dates that are understood. Fixed values.
_DASH = r"\s*[-–]\s*"
_CROSS = re.compile(rf"(?i)^([a-z]+)\s+(\d{{1,2}}){_DASH}([a-z]+)\s+(\d{{1,2}})$")
_SAME = re.compile(r"(?i)^([a-z]+)\s+(\d{1,2})\s*(?:[-–]|&)\s*(\d{1,2})$")
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_SERIES = re.compile(rf"(?i)^({'|'.join(_DAYS)})s?\s*,\s*(.+?)\s+through\s+(.+)$")
_LISTED = re.compile(r"^[A-Za-z]+\s+\d")


@dataclass(frozen=True)
class Span:
    start: datetime
    end: datetime | None = None
    time_dropped: bool = False


def instant(text: str, default: datetime) -> datetime | None:
    """One date or time text, in UTC; what it doesn't say comes from ``default``. None where it can't be read."""
    try:
        found = parser.parse(text.strip(), default=default)
        return found.replace(tzinfo=timezone.utc) if found.tzinfo is None else found.astimezone(timezone.utc)
    except (ValueError, OverflowError, TypeError):
        return None


def moment(date: str, time: str, default: datetime) -> Span | None:
    """Date and time together; without the time where both can't be read as one."""
    for text, dropped in ((" ".join(filter(None, (date, time))), False), (date, bool(time))):
        if text and (found := instant(text, default)) is not None:
            return Span(found, time_dropped=dropped)
    return None


def _range(a: str, b: str, time: str, default: datetime) -> list[Span] | None:
    noon = default.replace(hour=12, minute=0, second=0, microsecond=0)
    first, last = moment(a, time, default if time else noon), moment(b, "", noon)
    if first is None or last is None:
        return None
    low, high = sorted((first.start, last.start.replace(hour=23, minute=59, second=59, microsecond=0)))
    return [replace(first, start=low, end=high)]


def _festival(date: str, time: str, default: datetime) -> list[Span] | None:
    if m := _CROSS.match(date):
        return _range(f"{m[1]} {int(m[2])}", f"{m[3]} {int(m[4])}", time, default)
    if m := _SAME.match(date):
        return _range(f"{m[1]} {int(m[2])}", f"{m[1]} {int(m[3])}", time, default)
    return None


def _series(date: str, time: str, default: datetime) -> list[Span] | None:
    m = _SERIES.match(date)
    if not m:
        return None
    noon = default.replace(hour=12, minute=0, second=0, microsecond=0)
    ends = [instant(m[2], noon), instant(m[3], noon)]
    if None in ends:
        return None
    low, high = sorted(ends)
    wanted = _DAYS.index(m[1].lower())
    day = low + timedelta(days=(wanted - low.weekday()) % 7)
    out = []
    while day.date() <= high.date():
        span = moment(f"{day:%B %d}", time, day) if time else Span(day)
        if span:
            out.append(span)
        day += timedelta(days=7)
    return out


def _listed(date: str, time: str, default: datetime) -> list[Span] | None:
    parts = [p for p in map(str.strip, date.split(",")) if p]
    if "," not in date or len(parts) < 2 or not all(map(_LISTED.match, parts)):
        return None
    spans = [moment(p, time, default) for p in parts]
    return None if None in spans else spans


#: tried in this order; a single date is what is left
SHAPES: tuple[tuple[str, Callable[[str, str, datetime], list[Span] | None]], ...] = (("festival", _festival), ("series", _series), ("list", _listed))


def expand(date: str | None, time: str | None, now: datetime) -> tuple[str | None, list[Span]]:
    """(kind, spans) of a listing's date and time texts; kind None where they can't be read. Missing parts come from
    noon of ``now``'s day."""
    date, time = (date or "").strip(), (time or "").strip()
    default = now.astimezone(timezone.utc).replace(hour=12, minute=0, second=0, microsecond=0)
    if date:
        for kind, shape in SHAPES:
            if (spans := shape(date, time, default)) is not None:
                return kind, spans
    single = moment(date, time, default)
    return ("single", [single]) if single else (None, [])


_TYPE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("starts", T.ArrayType(T.TimestampType())),
        T.StructField("ends", T.ArrayType(T.TimestampType())),
        T.StructField("time_dropped", T.BooleanType()),
    ]
)


def schedule(date: Column, time: Column, now: str) -> Column:
    """struct<kind, starts, ends, time_dropped> by an Arrow-batched function; equal texts of a batch are read once."""
    at = datetime.fromisoformat(now).replace(tzinfo=timezone.utc)

    @F.pandas_udf(_TYPE)
    def run(dates: pd.Series, times: pd.Series) -> pd.DataFrame:
        seen: dict[tuple, tuple] = {}
        rows = []
        for key in zip(dates, times, strict=True):
            if key not in seen:
                kind, spans = expand(*key, at)
                seen[key] = kind, [s.start for s in spans], [s.end for s in spans], any(s.time_dropped for s in spans)
            rows.append(seen[key])
        return pd.DataFrame(rows, columns=["kind", "starts", "ends", "time_dropped"])

    return run(date, time)
