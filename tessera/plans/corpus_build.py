"""Offline build: raw records to processed, cleaned and indexed tables. Every step is DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates, text
from tessera.operators import filters as FL
from tessera.operators import profile as P
from tessera.schema import TEXT_COLUMNS, canonical_order, resolve_aliases

ORDER = ["ext_id", "company", "stock", "industry", "title", "city", "salary_min", "salary_max", "body", "education", "experience", "category", "pub_date", "end_date"]
CRITICAL = ["company", "body", "industry"]
DEFAULTS = {"education": "学历不限", "experience": "经验不限"}
NEGOTIABLE = -1.0


def preprocess(raw: DataFrame, aliases: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """Field selection, one date format, end dates, canonical order. Returns the frame and the missing fields."""
    df, missing = resolve_aliases(raw, aliases, ORDER)
    for c in ("pub_date", "end_date"):
        df = df.withColumn(c, dates.parse_date(F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("date"))
    df = df.withColumn("end_date", dates.end_date(F.col("pub_date"), F.col("end_date")))
    return canonical_order(df, ORDER), missing


def clean(df: DataFrame, brands: tuple[str, ...]) -> DataFrame:
    """Texts cleaned (of the names of the collecting site, too), incomplete rows dropped, defaults filled, salaries parsed and ordered, categories normalised."""
    has = set(df.columns)
    for c in [c for c in TEXT_COLUMNS if c in has]:
        df = df.withColumn(c, text.clean_text(F.col(c), brands))
    df = FL.complete(df, [c for c in CRITICAL if c in has])
    for c, v in DEFAULTS.items():
        if c in has:
            df = df.withColumn(c, text.fill_default(F.col(c), v))
    for c in ("salary_min", "salary_max"):
        if c in has:
            df = df.withColumn(c, text.parse_number(F.when(text.blank(F.col(c).cast("string")), str(NEGOTIABLE)).otherwise(F.col(c).cast("string"))))
    if {"salary_min", "salary_max"} <= has:
        low, high = text.ordered_pair(F.col("salary_min"), F.col("salary_max"))
        df = df.withColumns({"salary_min": low, "salary_max": high})
    for c, f in (("education", text.normalize_education), ("experience", text.normalize_experience), ("city", text.normalize_city), ("industry", F.trim)):
        if c in has:
            df = df.withColumn(c, f(F.col(c)))
    return df


def quality_report(before: DataFrame, after: DataFrame, patterns: dict[str, str]) -> dict[str, DataFrame]:
    texts = [c for c, t in after.dtypes if t == "string"]
    return {"missing": P.missing(after), "comparison": P.comparison(before, after), "residue": P.residue(after, patterns, texts), "salary": P.salary_issues(after, "salary_min", "salary_max")}


def explore(df: DataFrame) -> dict[str, DataFrame]:
    """The nine aggregations of the data exploration."""
    return {
        "missing": P.missing(df),
        "cardinality": P.cardinality(df),
        "industries": P.value_counts(df, "industry", 20),
        "industry_sizes": P.group_sizes(df, "industry"),
        "company_sizes": P.group_sizes(df, "company"),
        "cities": P.with_share(P.value_counts(df, "city")).orderBy(F.desc("n"), "value").limit(20),
        "salaries": P.numeric_stats(df, ["salary_min", "salary_max"]),
        "salary_bins": P.histogram(df, F.col("salary_min"), [0, 5000, 8000, 10000, 15000, 20000, 30000, 50000, 100000, 200000]),
        "dates": P.date_parts(df, "pub_date"),
    }


def resegment(sample: DataFrame, corpus: DataFrame, key: str, body: str = "body") -> DataFrame:
    """Sampled rows with the corpus's text; rows the corpus lacks keep their own."""
    own = corpus.select(key, F.col(body).alias("fresh"))
    return sample.join(own, key, "left").withColumn(body, F.coalesce("fresh", body)).drop("fresh")


def numbered(df: DataFrame, key: str, column: str) -> DataFrame:
    """line_no (from 1, in order of key) beside the id, for rows that have text; numbered after the filter, so no line shifts."""
    from tessera.operators.ranking import global_rank

    return global_rank(df.where(~text.blank(F.col(column))).select(key, column), key).withColumn("line_no", F.col("rank") + 1).drop("rank")
