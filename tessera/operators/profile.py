"""Profiles, distributions, validation counts and their comparison. Each is one or two aggregations over the data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import blank


def _long(df: DataFrame, values: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregation pass, then a row for each column name."""
    first = next(iter(values.values()))
    flat = df.agg(*(e.alias(f"{name}\u0001{c}") for c, parts in values.items() for name, e in parts.items()), *([] if values else [F.count(F.lit(1)).alias("n")]))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"`{name}\u0001{c}`").alias(name) for name in first)) for c in values))
    return flat.select(F.explode(rows).alias("r")).select("r.*")


def missing(df: DataFrame) -> DataFrame:
    """column, n_null, pct_null, n_present for every column."""
    n = F.count(F.lit(1))
    return _long(df, {c: {"n_null": F.count_if(F.col(f"`{c}`").isNull()), "n_rows": n} for c in df.columns}).select(
        "column", "n_null", F.round(100.0 * F.col("n_null") / F.greatest("n_rows", F.lit(1)), 4).alias("pct_null"), (F.col("n_rows") - F.col("n_null")).alias("n_present")
    )


def cardinality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _long(df, {c: {"n_distinct": F.count_distinct(F.col(f"`{c}`"))} for c in columns or df.columns})


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Counts of the non-null values, most frequent first, ties by value."""
    out = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")
    return out.limit(top) if top else out


def with_share(counts: DataFrame, n: str = "n") -> DataFrame:
    total = counts.agg(F.sum(n).alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.round(100.0 * F.col(n) / F.col("total"), 4)).drop("total")  # one row


def group_sizes(df: DataFrame, column: str) -> DataFrame:
    """Summary of the sizes of the groups of a column."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.max("n").alias("max_size"),
        F.min("n").alias("min_size"),
        F.round(F.median("n"), 4).alias("median_size"),
        F.round(F.avg("n"), 4).alias("mean_size"),
        F.round(F.stddev_samp("n"), 4).alias("std_size"),
        F.count_if(F.col("n") == 1).alias("singletons"),
    )


#: Different values of an interval up to which the driver takes them, and the inverse of the rank error of the bounds.
VALUES, ACCURACY = 100_000, 10_000


def percentiles(df: DataFrame, columns: list[str], shares: tuple[float, ...], values: int = VALUES, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Exact percentiles of each column, interpolated between neighbours; null if it has no values.

    No task meets all values: approximate ones bound an interval around each wanted rank, and rows below
    and inside it are counted, until it holds few different values. Only these are sorted, with their counts.
    """
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    n = df.agg(*(F.count(v).alias(f"n{i}") for i, v in enumerate(x.values()))).first() if columns else ()
    place = {(c, p): p * (n[i] - 1) for i, c in enumerate(columns) for p in shares if n[i]}
    ranks = {t: (math.floor(at), math.ceil(at)) for t, at in place.items()}
    bounds: dict[tuple, tuple[float | None, float | None]] = dict.fromkeys(place, (None, None))
    below, inside, wide = dict.fromkeys(place, 0), {t: n[columns.index(t[0])] for t in place}, list(place)

    def within(t: tuple) -> Column:
        lo, hi = bounds[t]
        own = x[t[0]].isNotNull()
        return own & (F.lit(True) if lo is None else x[t[0]] >= lo) & (F.lit(True) if hi is None else x[t[0]] <= hi)

    def counted(targets: list[tuple]) -> dict[tuple, tuple[int, int, int]]:
        parts = [F.struct((F.lit(0) if bounds[t][0] is None else F.count_if(x[t[0]] < bounds[t][0])).cast("long"), F.count_if(within(t)), F.approx_count_distinct(F.when(within(t), x[t[0]]))) for t in targets]
        return dict(zip(targets, map(tuple, df.agg(*(p.alias(f"p{i}") for i, p in enumerate(parts))).first()), strict=True))

    while wide:
        # Where the wanted ranks lie inside the interval, with room for twice the error to both sides.
        asked = {t: [min(max((r - below[t]) / max(inside[t] - 1, 1) + e, 0.0), 1.0) for r, e in zip(ranks[t], (-2 / accuracy, 2 / accuracy), strict=True)] for t in wide}
        found = df.agg(*(F.percentile_approx(F.when(within(t), x[t[0]]), F.array(*map(F.lit, asked[t])), F.lit(accuracy)).alias(f"a{i}") for i, t in enumerate(wide))).first()
        before = dict(bounds)
        for t, (lo, hi) in zip(wide, found, strict=True):
            bounds[t] = (lo, hi)
        got = counted(wide)
        for t in wide:
            lower, own, _ = got[t]
            if lower > ranks[t][0] or lower + own <= ranks[t][1]:  # the approximation was worse than it should be
                bounds[t] = before[t]
                got[t] = (below[t], inside[t], 0)
            below[t], inside[t] = got[t][:2]
        wide = [t for t in wide if got[t][2] > values and bounds[t] != before[t]]
    if not place:
        return {c: [None] * len(shares) for c in columns}
    order = list(place)
    each = F.array(*(F.when(within(t), F.struct(F.lit(i).alias("t"), x[t[0]].alias("v"))) for i, t in enumerate(order)))
    held = df.select(F.explode(each).alias("h")).where("h is not null").groupBy("h.t", "h.v").agg(F.count(F.lit(1)).alias("n")).collect()
    lists = {t: sorted(((r.v, r.n) for r in held if r.t == i), key=lambda a: (a[0] != a[0], a[0])) for i, t in enumerate(order)}

    def at(t: tuple, rank: int) -> float:
        left = rank - below[t]
        for v, m in lists[t]:
            left -= m
            if left < 0:
                return v
        raise AssertionError("the rank lies outside its interval")

    def value(t: tuple) -> float:
        lo, hi = (at(t, r) for r in ranks[t])
        return lo if ranks[t][0] == ranks[t][1] or lo == hi else (ranks[t][1] - place[t]) * lo + (place[t] - ranks[t][0]) * hi

    return {c: [value((c, p)) if (c, p) in place else None for p in shares] for c in columns}


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, median, std, min, max, p25, p75 (rounded to 2) of each column; all null if it has no values."""
    of = percentiles(df, columns, (0.25, 0.5, 0.75))

    def stats(c: str) -> dict[str, Column]:
        x = F.col(c)
        p25, median, p75 = (F.lit(v).cast("double") for v in of[c])
        out = {"mean": F.avg(x), "median": median, "std": F.stddev_samp(x), "min": F.min(x).cast("double"), "max": F.max(x).cast("double"), "p25": p25, "p75": p75}
        return {"count": F.count(x)} | {k: F.round(v, 2) for k, v in out.items()}

    return _long(df, {c: stats(c) for c in columns})


def mean_average(df: DataFrame, low: str, high: str) -> DataFrame:
    """Mean of the middle of two bounds, over rows that have both."""
    return df.agg(F.round(F.avg((F.col(low) + F.col(high)) / 2), 4).alias("mean_average"))


def histogram(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Counts in left-closed bins; the last bin is open. Bins without rows count 0."""
    bins = df.sparkSession.createDataFrame([(i, float(e), float(edges[i + 1]) if i + 1 < len(edges) else None) for i, e in enumerate(edges)], "bin int, low double, high double")
    at = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        at = F.when(value >= e, i).otherwise(at)
    counts = df.select(at.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def date_parts(df: DataFrame, column: str) -> DataFrame:
    """Rows per year and month."""
    d = F.col(column)
    return df.where(d.isNotNull()).groupBy(F.year(d).alias("year"), F.month(d).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def date_span(df: DataFrame, raw: str, parsed: str) -> DataFrame:
    return df.agg(F.min(parsed).alias("first"), F.max(parsed).alias("last"), F.count_if(~blank(F.col(raw)) & F.col(parsed).isNull()).alias("unparsed"))


def date_issues(df: DataFrame, pub: str, end: str, raw_pub: str | None = None, raw_end: str | None = None) -> DataFrame:
    """Counts of date problems."""
    days = F.datediff(end, pub)
    lost = lambda raw, c: F.count_if(~blank(F.col(raw)) & F.col(c).isNull()) if raw else F.count_if(F.col(c).isNull())
    return df.agg(
        lost(raw_pub, pub).alias("pub_unparsed"), lost(raw_end, end).alias("end_unparsed"), F.count_if(days <= 0).alias("end_not_after_pub"), F.count_if((days > 0) & (days < 7)).alias("under_7_days"), F.count_if(days > 365).alias("over_365_days")
    )


def salary_issues(df: DataFrame, low: str, high: str, least: float = 1000, most: float = 200_000) -> DataFrame:
    """Rows out of range; they are counted and kept. -1 (negotiable) is no issue."""
    a, b = F.col(low), F.col(high)
    return df.agg(F.count_if((a != -1) & (a < least)).alias("below"), F.count_if(b > most).alias("above"), F.count_if((a != -1) & (b != -1) & (a > b)).alias("swapped"), F.count_if(a.isNull() | b.isNull()).alias("missing"))


def residue(df: DataFrame, patterns: dict[str, str], columns: list[str]) -> DataFrame:
    """column and, per pattern, the number of its matches inside single values."""
    return _long(df, {c: {name: F.coalesce(F.sum(F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0)))), F.lit(0)) for name, p in patterns.items()} for c in columns})


def comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, nulls and distinct values of each common column before and after."""
    own = lambda df: _long(df, {c: {"rows": F.count(F.lit(1)), "nulls": F.count_if(F.col(f"`{c}`").isNull()), "distinct": F.count_distinct(F.col(f"`{c}`"))} for c in df.columns})
    a, b = own(before), own(after)
    return a.join(b.select(F.col("column").alias("other"), *(F.col(c).alias(f"{c}_after") for c in ("rows", "nulls", "distinct"))), F.col("column") == F.col("other")).select(
        "column", *((F.col(f"{c}_after") - F.col(c)).alias(f"d_{c}") for c in ("rows", "nulls", "distinct"))
    )


def symbol_sizes(counts: DataFrame, n: str = "n") -> DataFrame:
    """Map symbol sizes from 4 to 32, in proportion between the least and the largest count."""
    ends = counts.agg(F.min(n).alias("lo"), F.max(n).alias("hi"))
    size = 4 + (F.col(n) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)) * 28
    return counts.crossJoin(F.broadcast(ends)).withColumn("symbol_size", F.round(F.greatest(size, F.lit(4.0)), 4)).drop("lo", "hi")  # one row


def top_and_bottom(counts: DataFrame, n: int = 10) -> DataFrame:
    """The n largest and the n smallest groups of value, n."""
    top = counts.orderBy(F.desc("n"), "value").limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(counts.orderBy("n", "value").limit(n).withColumn("side", F.lit("bottom")))


def ordered_by_list(counts: DataFrame, order: list[str]) -> DataFrame:
    """Rows in the order of a list of values; unknown values come after it."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("value"))
    return counts.withColumn("position", F.when(at > 0, at).otherwise(999).cast("int")).orderBy("position", "value")


def zipf_fit(terms: DataFrame) -> DataFrame:
    """Least squares of log10(freq) on log10(rank): slope, intercept, r2, deviation from -1. terms: freq, rank."""
    x, y = F.log10("rank"), F.log10("freq")
    return terms.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")).select(
        F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 6).alias("r2"), F.round(F.abs(F.col("slope") + 1), 6).alias("deviation")
    )


def hapax(terms: DataFrame) -> DataFrame:
    return terms.agg(F.count_if(F.col("freq") == 1).alias("hapax"), F.round(100.0 * F.count_if(F.col("freq") == 1) / F.count(F.lit(1)), 4).alias("share"), F.count(F.lit(1)).alias("types"), F.sum("freq").alias("tokens"))


def ranked_terms(terms: DataFrame) -> DataFrame:
    """Adds rank by frequency (ties by term) and relative frequency to term, freq.

    Ranks are given per frequency first and then inside each: only the number of
    different frequencies meets in one task, not the vocabulary.
    """
    per = terms.groupBy("freq").agg(F.count(F.lit(1)).alias("n"))
    before = per.select(F.col("freq").alias("of_freq"), (F.sum("n").over(W.orderBy(F.desc("freq"))) - F.col("n")).alias("before"), F.sum(F.col("freq") * F.col("n")).over(W.orderBy(F.desc("freq")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("tokens"))
    inside = F.row_number().over(W.partitionBy("freq").orderBy("term"))
    ranked = terms.withColumn("inside", inside).join(before, F.col("freq") == F.col("of_freq"))
    return ranked.select("term", "freq", (F.col("before") + F.col("inside")).alias("rank"), F.round(F.col("freq") / F.col("tokens"), 9).alias("share"))
