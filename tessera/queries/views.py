"""The test tables in the roles of records, and the same views as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import TOKEN_RE2, tokens
from tessera.operators import index as IX
from tessera.operators import search as S
from tessera.session import materialise, shared_dir

FIRST_LINE = r"^[^.\n]*"
TERMS = ["that", "with", "this"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the first sentence is the title, the source the company and the city, the language the industry."""
    chars = F.col("n_chars").cast("double")
    none = F.lit(None)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_extract("text", FIRST_LINE, 0).alias("title"), F.col("text").alias("body"), F.col("source").alias("company"), F.col("lang").alias("industry"), F.col("source").alias("city"),
        chars.alias("salary_min"), chars.alias("salary_max"), none.cast("string").alias("education"), none.cast("string").alias("experience"), none.cast("string").alias("category"), none.cast("date").alias("pub_date"), none.cast("date").alias("end_date"),
    )


def token_table(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tokens(F.col("title")).alias("title_tokens"), tokens(F.col("body")).alias("body_tokens"))


#: What was stored by this process for a folder: token table, postings, index.
_STORED: dict[tuple[str, str, str], object] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make, again: bool = False):
    """What make gives, once for each application and folder; like any stored table it shows the documents as they were."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if again or key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def token_rows(spark: SparkSession, sf_dir: str, again: bool = False) -> DataFrame:
    """The token table of the documents, written once: all term statistics and indexes start from it."""
    return stored(spark, sf_dir, "tokens", lambda: materialise(token_table(records(spark, sf_dir))), again)


def all_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IX.postings(token_rows(spark, sf_dir), ["body_tokens", "title_tokens"])


def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings, written once, ranged and sorted by term: a lookup of terms reads little more than their row groups."""
    return stored(spark, sf_dir, "postings", lambda: materialise(all_postings(spark, sf_dir).repartitionByRange("term").sortWithinPartitions("term")))


def n_documents(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "documents").count()


def index(spark: SparkSession, sf_dir: str, rebuild: bool = False) -> S.Index:
    """The search index of the documents, built from the token table, written, and read back as a new session would."""

    def make() -> S.Index:
        docs = records(spark, sf_dir)
        path = f"{shared_dir(spark)}/index"
        S.build(docs, token_rows(spark, sf_dir)).written(path)
        return S.Index.read(docs, path)

    return stored(spark, sf_dir, "index", make, rebuild)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: dates, amounts and categories without long texts."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    date = F.col("o_orderdate").cast("date")
    return rows.select(
        F.col("o_orderkey").alias("doc_id"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("industry"), F.col("n_name").alias("city"), F.col("o_orderpriority").alias("title"),
        F.col("o_totalprice").alias("salary_min"), (F.col("o_totalprice") * 1.5).alias("salary_max"), F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("body"), F.col("o_orderpriority").alias("education"),
        F.col("o_orderstatus").alias("experience"), F.col("o_orderstatus").alias("category"), date.alias("pub_date"), F.date_add(date, 60).alias("end_date"),
    )


# The same as SQL: strings to be put after WITH

WORDS = "list_filter(regexp_extract_all(lower({0}), '" + TOKEN_RE2.replace("{", "{{").replace("}", "}}") + "'), lambda w: length(w) >= 2)"
REC = r"""rec AS (SELECT doc_id, regexp_extract(text, '^[^.\n]*') AS title, text AS body, source AS company, lang AS industry, source AS city,
  CAST(n_chars AS DOUBLE) AS salary_min, CAST(n_chars AS DOUBLE) AS salary_max FROM documents)"""
TOK = f"{REC},\ntok AS (SELECT doc_id, {WORDS.format('title')} AS title_tokens, {WORDS.format('body')} AS body_tokens FROM rec)"
OCC = f"""{TOK},
occ AS (SELECT doc_id, unnest(every) AS term, CAST(unnest(range(len(every))) AS INTEGER) AS pos FROM (SELECT doc_id, list_concat(body_tokens, title_tokens) AS every FROM tok))"""
POST = f"""{OCC},
post AS (SELECT term, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM occ GROUP BY term, doc_id),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
n AS (SELECT count(*) AS n FROM documents)"""
MATRIX = f"""{POST},
scored_terms AS (SELECT doc_id, term, tf * ln(n / (df + 1)) AS w FROM post JOIN df USING (term), n),
matrix AS (SELECT doc_id, term, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS rk FROM scored_terms) WHERE rk <= 200),
norms AS (SELECT doc_id, CASE WHEN sqrt(sum(w * w)) < 1e-9 THEN 1.0 ELSE sqrt(sum(w * w)) END AS norm FROM matrix GROUP BY doc_id),
vocab AS (SELECT term, count(*) AS df FROM matrix GROUP BY term)"""
JOB = """job AS (SELECT o_orderkey AS doc_id, c_name AS company, c_mktsegment AS industry, n_name AS city, o_orderpriority AS title,
  o_totalprice AS salary_min, o_totalprice * 1.5 AS salary_max, o_orderpriority || ' ' || c_mktsegment AS body, o_orderpriority AS education,
  o_orderstatus AS experience, o_orderstatus AS category, CAST(o_orderdate AS DATE) AS pub_date, CAST(CAST(o_orderdate AS DATE) + 60 AS DATE) AS end_date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def quoted(terms: list[str]) -> str:
    return ", ".join(f"'{t}'" for t in terms)


def score_sql(terms: list[str], text: str = "", where: str = "true") -> str:
    """CTEs up to hits: the records above the threshold with their score."""
    bonus = f"CASE WHEN '{text}' <> '' AND (contains(lower(company), '{text}') OR contains('{text}', lower(company))) THEN 0.1 ELSE 0.0 END"
    return f"""{MATRIX},
q0 AS (SELECT term, ln(n / df) AS q FROM vocab, n WHERE term IN ({quoted(terms)})),
q AS (SELECT term, CASE WHEN sqrt(sum(q * q) OVER ()) > 0 THEN q / sqrt(sum(q * q) OVER ()) ELSE 0.0 END AS q FROM q0),
cos AS (SELECT doc_id, sum(w * q) / any_value(norm) AS cosine FROM matrix JOIN q USING (term) JOIN norms USING (doc_id) GROUP BY doc_id),
hits AS (SELECT * EXCLUDE (raw), round(raw * 50, 2) AS score FROM (
  SELECT rec.*, coalesce(cosine, 0.0) * power(2.0, len(list_intersect(title_tokens, [{quoted(terms)}]))) + {bonus} AS raw
  FROM rec JOIN tok USING (doc_id) LEFT JOIN cos USING (doc_id) WHERE {where}) WHERE raw > 0.0001)"""


def snippet_sql(text: str, most: int) -> str:
    """The snippet of a text around place (1 for the first character, 0 if nothing is found)."""
    lo, hi = f"greatest(place - 1 - {most // 2}, 0)", f"least(place - 1 + {most // 2}, length({text}))"
    around = f"(CASE WHEN {lo} > 0 THEN '...' ELSE '' END) || substring({text}, CAST({lo} + 1 AS BIGINT), CAST({hi} - {lo} AS BIGINT)) || (CASE WHEN {hi} < length({text}) THEN '...' ELSE '' END)"
    return f"CASE WHEN place = 0 THEN substring({text}, 1, {most}) ELSE {around} END"
