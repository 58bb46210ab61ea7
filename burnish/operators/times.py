"""Dates and times."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import WS, ascii_digits
from .base import BaseCleaner, named


class TimeFormat(str, Enum):
    ISO_DATETIME = "iso_datetime"
    ISO_DATE = "iso_date"
    ISO_TIME = "iso_time"
    INDIAN_DATE = "indian_date"


#: Field patterns: 1-digit fields are taken, a day may be padded by a space.
Y, M, D = r"(\d{4})", r"(1[0-2]|0[1-9]|[1-9])", r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])"
CLOCK = r"(2[0-3]|[01]\d|\d):([0-5]\d|\d):([0-5]\d|\d)"
HALF_DAY = rf"(1[0-2]|0[1-9]|[1-9]):([0-5]\d|\d){WS}+([AaPp])[Mm]"


@dataclass(frozen=True, kw_only=True)
class DateTimeCleaner(BaseCleaner):
    """Seven usual ways to write a date, a time or both; day before month. A time alone
    has no date, and stands on 0001-01-01 where one is asked for with it."""

    Format: ClassVar = TimeFormat

    out_format: TimeFormat = TimeFormat.ISO_DATETIME

    def parts(self, c: Column) -> tuple[Column]:
        c = ascii_digits(c)
        y, m, d = Y, M, D
        # (pattern, places of year, month, day, hour, minute, second)
        shapes = [
            (rf"{y}-{m}-{d}(?:{WS}+|[Tt]){CLOCK}", (1, 2, 3, 4, 5, 6)),
            (rf"{y}-{m}-{d}", (1, 2, 3, 0, 0, 0)),
            (rf"{d}-{m}-{y}", (3, 2, 1, 0, 0, 0)),
            (rf"{d}/{m}/{y}", (3, 2, 1, 0, 0, 0)),
        ]

        def field(pattern: str, k: int) -> Column:
            return F.btrim(F.regexp_extract(c, pattern, k)).cast("int") if k else F.lit(0)

        dated, alone = [], []
        for shape, places in shapes:
            pattern = rf"\A{shape}\z"
            whole = F.try_make_timestamp_ntz(*[field(pattern, k) for k in places])
            dated.append(F.when(c.rlike(pattern) & (field(pattern, places[0]) >= 1), whole))
        clock, half = rf"\A{CLOCK}\z", rf"\A{HALF_DAY}\z"
        first = (F.lit(1), F.lit(1), F.lit(1))
        alone.append(F.when(c.rlike(clock), F.try_make_timestamp_ntz(*first, *[field(clock, k) for k in (1, 2, 3)])))
        hour = field(half, 1) % 12 + F.when(F.lower(F.regexp_extract(c, half, 3)) == "p", 12).otherwise(0)
        alone.append(F.when(c.rlike(half), F.try_make_timestamp_ntz(*first, hour, field(half, 2), F.lit(0))))
        date, both = F.coalesce(*dated), F.coalesce(*dated, *alone)
        if self.out_format is TimeFormat.ISO_DATETIME:
            return (F.date_format(both, "yyyy-MM-dd'T'HH:mm:ss"),)
        if self.out_format is TimeFormat.ISO_TIME:
            return (F.date_format(both, "HH:mm:ss"),)
        return (F.date_format(date, "yyyy-MM-dd" if self.out_format is TimeFormat.ISO_DATE else "dd-MM-yyyy"),)

    def name_score(self, column: str) -> float:
        return 1.0 if column.lower().endswith("_at") else named(column, ("date", "time", "timestamp"))
