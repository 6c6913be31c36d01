"""Predicates of the search filters, and row filters of the corpus build."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import blank


@dataclass
class Filters:
    """Structured conditions of a search. None (and 0 for salaries, "" for texts) means no condition."""

    industry: str | None = None
    city: str | None = None
    education: str | None = None
    experience: str | None = None
    salary_min: float | None = None
    salary_max: float | None = None
    date_from: date | str | None = None
    date_to: date | str | None = None
    exclude: str | None = None

    def active(self) -> dict:
        return {k: v for k, v in vars(self).items() if v}

    def merged(self, parsed: dict) -> Filters:
        """Own conditions win over those parsed from the query."""
        return Filters(**{**{k: v for k, v in parsed.items() if v}, **self.active()})


def predicate(f: Filters) -> Column:
    """One conjunction over role columns, which the scan can push down. Null salaries pass; null dates do not."""
    c = F.col
    rules = {
        "industry": lambda v: c("industry").contains(v),
        "city": lambda v: c("city") == v,
        "education": lambda v: c("education").contains(v),
        "experience": lambda v: c("experience").contains(v),
        "salary_min": lambda v: c("salary_min").isNull() | (c("salary_min") >= float(v)),
        "salary_max": lambda v: c("salary_max").isNull() | (c("salary_max") <= float(v)),
        "date_from": lambda v: c("pub_date") >= F.lit(v).cast("date"),
        "date_to": lambda v: c("pub_date") <= F.lit(v).cast("date"),
        "exclude": lambda v: ~(F.coalesce(c("title"), F.lit("")).contains(v) | F.coalesce(c("body"), F.lit("")).contains(v)),
    }
    return reduce(lambda a, b: a & b, (rules[k](v) for k, v in f.active().items()), F.lit(True))


def apply(df: DataFrame, f: Filters) -> DataFrame:
    return df.where(predicate(f)) if f.active() else df


def complete(df: DataFrame, critical: list[str]) -> DataFrame:
    """Rows whose critical fields are neither null nor blank."""
    return df.where(reduce(lambda a, b: a & b, (~blank(F.col(c)) for c in critical), F.lit(True)))


def above(df: DataFrame, score: str = "score", least: float = 0.0001) -> DataFrame:
    return df.where(F.col(score) > least)


def positive(df: DataFrame, score: str = "score") -> DataFrame:
    return df.where(F.col(score) > 0)


def members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def others(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")
