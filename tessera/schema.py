"""Column roles of the record table. Operators speak of roles, data keeps its own names."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class CorpusSpec:
    """Name of the column that plays each role; None if there is none."""

    doc_id: str = "doc_id"
    title: str | None = "title"
    body: str | None = "body"
    company: str | None = "company"
    industry: str | None = "industry"
    city: str | None = "city"
    salary_min: str | None = "salary_min"
    salary_max: str | None = "salary_max"
    education: str | None = "education"
    experience: str | None = "experience"
    category: str | None = "category"
    pub_date: str | None = "pub_date"
    end_date: str | None = "end_date"


POSTING = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in ("company", "stock", "industry", "title", "city")),
        T.StructField("salary_min", T.DoubleType()),
        T.StructField("salary_max", T.DoubleType()),
        *(T.StructField(c, T.StringType()) for c in ("body", "education", "experience", "category")),
        T.StructField("pub_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
    ]
)
TEXT_COLUMNS = [f.name for f in POSTING if isinstance(f.dataType, T.StringType)]


def with_roles(df: DataFrame, spec: CorpusSpec) -> DataFrame:
    """The columns of df under the names of their roles; absent roles are null columns of the posting's type."""
    types = {f.name: f.dataType for f in POSTING}
    out = []
    for f in fields(spec):
        name = getattr(spec, f.name)
        out.append((F.col(name) if name else F.lit(None)).cast(types[f.name]).alias(f.name))
    return df.select(*out)


def resolve_aliases(df: DataFrame, aliases: dict[str, list[str]], extra: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """Field selection by alias table: for each target the first raw name that exists. Returns the frame and the targets that are missing."""
    chosen = {target: next((n for n in names if n in df.columns), None) for target, names in aliases.items()}
    keep = [F.col(f"`{n}`").alias(t) for t, n in chosen.items() if n]
    keep += [F.col(f"`{c}`") for c in extra if c in df.columns and c not in chosen]
    return df.select(*keep), [t for t, n in chosen.items() if not n]


def canonical_order(df: DataFrame, order: list[str]) -> DataFrame:
    """The columns of order that exist, in that order; unknown ones go."""
    return df.select(*(c for c in order if c in df.columns))
