"""Dates from mixed formats; nothing throws on bad input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "d/M/yyyy")
OPEN_DAYS = 60


def parse_date(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """First format that reads the whole text (a time of day after it is dropped), else null."""
    text = F.regexp_extract(F.trim(c), r"^([0-9./-]+)([ T][0-9:.]+)?$", 1)
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats)).cast("date")


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def end_date(published: Column, end: Column, days: int = OPEN_DAYS) -> Column:
    return F.coalesce(end, F.date_add(published, days))
