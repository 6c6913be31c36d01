"""Profiles, distributions, validation and comparison over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.operators import filters as FL
from tessera.operators import profile as P
from tessera.plans import corpus_build as CB
from tessera.queries import views as V
from tessera.registry import query
from tessera.schema import resolve_aliases
from tessera.streaming.windows import windowed

_HOLES = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, o_orderpriority AS priority FROM orders"


def _holes(spark, sf_dir) -> DataFrame:
    """Orders with nulls in two columns."""
    o = V.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.col("o_orderpriority").alias("priority"))


_COLUMNS = ("o_orderkey", "price", "status", "priority")


def _each(parts: str, columns=_COLUMNS, source: str = "h") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {parts.replace('{c}', c)} FROM {source}" for c in columns)


@query("missing_profile", f"WITH h AS ({_HOLES}) " + _each("count(*) - count({c}) AS n_null, round(100.0 * (count(*) - count({c})) / count(*), 4) AS pct_null, count({c}) AS n_present"))
def missing_profile(spark, sf_dir) -> DataFrame:
    return P.missing(_holes(spark, sf_dir))


@query("cardinality", f"WITH h AS ({_HOLES}) " + _each("count(DISTINCT {c}) AS n_distinct"))
def cardinality(spark, sf_dir) -> DataFrame:
    return P.cardinality(_holes(spark, sf_dir))


@query("before_after", f"WITH h AS ({_HOLES}), g AS (SELECT * FROM h WHERE status IS NOT NULL) " + _each("(SELECT count(*) FROM g) - count(*) AS d_rows, (SELECT count(*) - count({c}) FROM g) - (count(*) - count({c})) AS d_nulls, (SELECT count(DISTINCT {c}) FROM g) - count(DISTINCT {c}) AS d_distinct"))
def before_after(spark, sf_dir) -> DataFrame:
    before = _holes(spark, sf_dir)
    return P.comparison(before, FL.complete(before, ["status"]))


@query("value_counts_topn", "SELECT l_shipdate AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def value_counts_topn(spark, sf_dir) -> DataFrame:
    return P.value_counts(V.table(spark, sf_dir, "lineitem"), "l_shipdate", 20)


_SIZES = "SELECT o_custkey AS value, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1"


@query("group_size_summary", f"SELECT count(*) AS n_groups, max(n) AS max_size, min(n) AS min_size, round(median(n), 4) AS median_size, round(avg(n), 4) AS mean_size, round(stddev_samp(n), 4) AS std_size, count(*) FILTER (WHERE n = 1) AS singletons FROM ({_SIZES})")
def group_size_summary(spark, sf_dir) -> DataFrame:
    return P.group_sizes(V.table(spark, sf_dir, "orders"), "o_custkey")


@query("top_and_bottom", f"WITH c AS ({_SIZES}) SELECT * FROM (SELECT *, 'top' AS side FROM c ORDER BY n DESC, value LIMIT 10) UNION ALL SELECT * FROM (SELECT *, 'bottom' AS side FROM c ORDER BY n, value LIMIT 10)")
def top_and_bottom(spark, sf_dir) -> DataFrame:
    return P.top_and_bottom(P.value_counts(V.table(spark, sf_dir, "orders"), "o_custkey"))


@query("numeric_stats", _each("count({c}) AS count, round(avg({c}), 2) AS mean, round(median({c}), 2) AS median, round(stddev_samp({c}), 2) AS std, round(CAST(min({c}) AS DOUBLE), 2) AS min, round(CAST(max({c}) AS DOUBLE), 2) AS max, round(quantile_cont({c}, 0.25), 2) AS p25, round(quantile_cont({c}, 0.75), 2) AS p75", ("l_quantity", "l_extendedprice", "l_discount"), "lineitem"))
def numeric_stats(spark, sf_dir) -> DataFrame:
    return P.numeric_stats(V.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("mean_average", f"WITH {V.JOB} SELECT round(avg((salary_min + salary_max) / 2), 4) AS mean_average FROM job")
def mean_average(spark, sf_dir) -> DataFrame:
    return P.mean_average(V.jobs(spark, sf_dir), "salary_min", "salary_max")


_EDGES = [0, 5000, 8000, 10000, 15000, 20000, 30000, 50000, 100000, 200000]


@query("histogram_edges", f"WITH e AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin, CAST(unnest({_EDGES}) AS DOUBLE) AS low), b AS (SELECT *, lead(low) OVER (ORDER BY bin) AS high FROM e) SELECT bin, low, high, (SELECT count(*) FROM orders WHERE o_totalprice >= low AND (high IS NULL OR o_totalprice < high)) AS n FROM b")
def histogram_edges(spark, sf_dir) -> DataFrame:
    return P.histogram(V.table(spark, sf_dir, "orders"), F.col("o_totalprice"), _EDGES)


@query("date_part_counts", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders GROUP BY 1, 2")
def date_part_counts(spark, sf_dir) -> DataFrame:
    return P.date_parts(V.table(spark, sf_dir, "orders"), "o_orderdate")


@query("ordered_by_list", "SELECT value, n, CAST(coalesce(list_position(['1-URGENT', '3-MEDIUM', '2-HIGH'], value), 999) AS INTEGER) AS position FROM (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1)")
def ordered_by_list(spark, sf_dir) -> DataFrame:
    return P.ordered_by_list(P.value_counts(V.table(spark, sf_dir, "orders"), "o_orderpriority"), ["1-URGENT", "3-MEDIUM", "2-HIGH"])


_MIXED = "CASE CAST(o_orderkey % 5 AS INTEGER) WHEN 0 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 1 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN 2 THEN 'n/a' WHEN 3 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END"
_PARSED = f"""raw AS (SELECT o_orderkey, {_MIXED} AS raw, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') WHEN o_orderkey % 11 = 1 THEN strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') END AS raw_end FROM orders),
parsed AS (SELECT *, CAST(coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%Y/%m/%d'), try_strptime(raw, '%Y.%m.%d'), try_strptime(raw, '%m/%d/%Y'), try_strptime(raw, '%d/%m/%Y')) AS DATE) AS pub_date FROM raw),
full_dates AS (SELECT *, coalesce(CAST(raw_end AS DATE), CAST(pub_date + 60 AS DATE)) AS end_date FROM parsed)"""


def _dated(spark, sf_dir) -> DataFrame:
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    raw = F.when(key % 5 == 0, F.date_format(day, "yyyy/MM/dd")).when(key % 5 == 1, F.date_format(day, "yyyy.MM.dd")).when(key % 5 == 2, "n/a").when(key % 5 == 3, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    end = F.when(key % 3 == 0, F.date_format(F.date_add(day, 3), "yyyy-MM-dd")).when(key % 11 == 1, F.date_format(F.date_add(day, -1), "yyyy-MM-dd"))
    rows = V.table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"), end.alias("raw_end"))
    rows = rows.withColumn("pub_date", dates.parse_date(F.col("raw")))
    return rows.withColumn("end_date", dates.end_date(F.col("pub_date"), dates.parse_date(F.col("raw_end"))))


@query("date_parse_unify", f"WITH {_PARSED} SELECT o_orderkey, strftime(pub_date, '%Y-%m-%d') AS pub_date, strftime(end_date, '%Y-%m-%d') AS end_date FROM full_dates")
def date_parse_unify(spark, sf_dir) -> DataFrame:
    return _dated(spark, sf_dir).select("o_orderkey", dates.iso(F.col("pub_date")).alias("pub_date"), dates.iso(F.col("end_date")).alias("end_date"))


@query("date_validation", f"WITH {_PARSED} SELECT count(*) FILTER (WHERE trim(raw) <> '' AND pub_date IS NULL) AS pub_unparsed, count(*) FILTER (WHERE end_date IS NULL) AS end_unparsed, count(*) FILTER (WHERE end_date - pub_date <= 0) AS end_not_after_pub, count(*) FILTER (WHERE end_date - pub_date BETWEEN 1 AND 6) AS under_7_days, count(*) FILTER (WHERE end_date - pub_date > 365) AS over_365_days FROM full_dates")
def date_validation(spark, sf_dir) -> DataFrame:
    return P.date_issues(_dated(spark, sf_dir), "pub_date", "end_date", raw_pub="raw")


@query("date_span", f"WITH {_PARSED} SELECT min(pub_date) AS first, max(pub_date) AS last, count(*) FILTER (WHERE trim(raw) <> '' AND pub_date IS NULL) AS unparsed FROM full_dates")
def date_span(spark, sf_dir) -> DataFrame:
    return P.date_span(_dated(spark, sf_dir), "raw", "pub_date")


@query("salary_flags", f"WITH {V.JOB} SELECT count(*) FILTER (WHERE salary_min <> -1 AND salary_min < 1000) AS below, count(*) FILTER (WHERE salary_max > 200000) AS above, count(*) FILTER (WHERE salary_min > salary_max) AS swapped, count(*) FILTER (WHERE salary_min IS NULL OR salary_max IS NULL) AS missing FROM job")
def salary_flags(spark, sf_dir) -> DataFrame:
    return P.salary_issues(V.jobs(spark, sf_dir), "salary_min", "salary_max")


@query("residual_dirt", "SELECT 'html' AS \"column\", CAST(sum(len(regexp_extract_all(html, 'https?://[^\" ]+'))) AS BIGINT) AS links, CAST(sum(len(regexp_extract_all(html, '&[a-z]+;'))) AS BIGINT) AS entities FROM pages UNION ALL SELECT 'url', CAST(sum(len(regexp_extract_all(url, 'https?://[^\" ]+'))) AS BIGINT), CAST(sum(len(regexp_extract_all(url, '&[a-z]+;'))) AS BIGINT) FROM pages")
def residual_dirt(spark, sf_dir) -> DataFrame:
    return P.residue(V.table(spark, sf_dir, "pages"), {"links": 'https?://[^" ]+', "entities": "&[a-z]+;"}, ["html", "url"])


@query("field_selection", "SELECT o_orderkey AS ext_id, o_orderstatus AS category, o_totalprice AS salary_min FROM orders")
def field_selection(spark, sf_dir) -> DataFrame:
    aliases = {"ext_id": ["key", "o_orderkey"], "category": ["o_orderstatus"], "salary_min": ["pay", "o_totalprice", "o_orderkey"], "stock": ["ticker"]}
    df, _ = resolve_aliases(V.table(spark, sf_dir, "orders"), aliases)
    return df


@query("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_join(spark, sf_dir) -> DataFrame:
    orders = V.table(spark, sf_dir, "orders").where("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")
    return FL.others(V.table(spark, sf_dir, "customer"), orders, "c_custkey").select("c_custkey")


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(spark, sf_dir) -> DataFrame:
    orders = V.table(spark, sf_dir, "orders").where("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")
    return FL.members(V.table(spark, sf_dir, "customer"), orders, "c_custkey").select("c_custkey")


@query("resegment_join", "SELECT s.o_orderkey, coalesce(CASE WHEN c.o_totalprice > 50000 THEN c.o_orderpriority END, s.o_orderstatus) AS body FROM orders s LEFT JOIN orders c ON s.o_orderkey = c.o_orderkey")
def resegment_join(spark, sf_dir) -> DataFrame:
    orders = V.table(spark, sf_dir, "orders")
    sample = orders.select("o_orderkey", F.col("o_orderstatus").alias("body"))
    return CB.resegment(sample, orders.where("o_totalprice > 50000").select("o_orderkey", F.col("o_orderpriority").alias("body")), "o_orderkey")


@query("line_numbers", "SELECT o_orderkey, status, row_number() OVER (ORDER BY o_orderkey) AS line_no FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders) WHERE status IS NOT NULL")
def line_numbers(spark, sf_dir) -> DataFrame:
    return CB.numbered(_holes(spark, sf_dir), "o_orderkey", "status")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir) -> DataFrame:
    return windowed(V.table(spark, sf_dir, "events"))
