"""Command line: the offline build, search over what it stored, and evaluation of judged results.

    python -m tessera build RAW.csv OUT --aliases ALIASES.json --brand NAME
    python -m tessera search OUT "query" --city CITY --sort date
    python -m tessera template OUT SPECS.json TEMPLATE.json
    python -m tessera evaluate JUDGED.json --archive ARCHIVE.json
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluate as E
from tessera.operators import keywords as K
from tessera.operators import search as S
from tessera.operators.filters import Filters
from tessera.operators.ranking import global_rank
from tessera.operators.tokenise import tokens
from tessera.plans import corpus_build as CB
from tessera.plans import service as SV
from tessera.plans.query_parser import Vocabulary
from tessera.session import session
from tessera.sources import readers, writers

JUDGED = "query_id int, results array<struct<rank:int,relevant:int>>"


def build(spark: SparkSession, raw: str, out: str, aliases: dict[str, list[str]], brands: tuple[str, ...], words: set[str] = frozenset()) -> list[str]:
    """Raw records to processed, cleaned, tokenised and indexed tables, keywords and neighbours, each a stored table; returns the missing fields."""
    processed, missing = CB.preprocess(readers.read_csv(spark, raw), aliases)
    writers.write_table(processed, f"{out}/processed")
    cleaned = CB.clean(spark.read.parquet(f"{out}/processed"), brands)
    writers.write_table(global_rank(cleaned, "ext_id").withColumnRenamed("rank", "doc_id"), f"{out}/cleaned")
    docs = spark.read.parquet(f"{out}/cleaned")
    writers.write_table(docs.select("doc_id", tokens(F.col("title"), words).alias("title_tokens"), tokens(F.col("body"), words).alias("body_tokens")), f"{out}/tokens")
    rows = spark.read.parquet(f"{out}/tokens")
    index = S.build(docs, rows).written(f"{out}/index")
    writers.write_table(K.as_lists(K.tfidf(rows)), f"{out}/keywords")
    writers.write_table(S.similar_blocked(index.matrix, index.norms), f"{out}/similar")
    return missing


def service(spark: SparkSession, out: str, words: set[str] = frozenset()) -> SV.Service:
    """The service over a stored build."""
    docs = spark.read.parquet(f"{out}/cleaned")
    return SV.Service(S.Index.read(docs, f"{out}/index"), Vocabulary.of(docs), words, lists=spark.read.parquet(f"{out}/keywords"), similar=spark.read.parquet(f"{out}/similar"))


def judged(spark: SparkSession, path: str) -> DataFrame:
    """query_id, rank, rel of a template that was filled in."""
    rows = readers.read_json(spark, path, JUDGED).select("query_id", F.explode("results").alias("r"))
    return rows.select("query_id", F.col("r.rank").alias("rank"), F.col("r.relevant").alias("rel"))


def evaluate(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    kept = E.judged(judged(spark, path))
    return {"queries": E.per_query(kept), "means": E.averages(E.per_query(kept)), "curve": E.mean_curve(E.interpolated(kept))}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("raw")
    b.add_argument("out")
    b.add_argument("--aliases", required=True, help="JSON: field -> names that a column may have")
    b.add_argument("--brand", action="append", required=True, help="name of the collecting site (several times if need be)")
    s = sub.add_parser("search")
    s.add_argument("out")
    s.add_argument("text")
    for name in ("industry", "city", "education", "experience", "exclude"):
        s.add_argument(f"--{name}")
    s.add_argument("--salary-min", type=float)
    s.add_argument("--salary-max", type=float)
    s.add_argument("--sort", default="relevance")
    s.add_argument("--page", type=int, default=1)
    t = sub.add_parser("template")
    t.add_argument("out")
    t.add_argument("specs")
    t.add_argument("template")
    e = sub.add_parser("evaluate")
    e.add_argument("judged")
    e.add_argument("--archive")
    for x in (b, s, t):
        x.add_argument("--dictionary", help="file with a word a line, by which Han text is cut")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(args)
    spark = spark or session()
    words = {r.line for r in readers.read_lines(spark, a.dictionary).collect()} if getattr(a, "dictionary", None) else set()
    if a.command == "build":
        with open(a.aliases, encoding="utf-8") as file:
            missing = build(spark, a.raw, a.out, json.load(file), tuple(a.brand), words)
        print(json.dumps({"missing": missing}, ensure_ascii=False))
    elif a.command == "search":
        rules = Filters(**{k: getattr(a, k) for k in ("industry", "city", "education", "experience", "exclude", "salary_min", "salary_max") if getattr(a, k) is not None})
        found = service(spark, a.out, words).search(a.text, rules, a.sort, a.page)
        print(writers.text_table(found.rows.select("rank", "doc_id", "score", "title", "company", "city"), f"{found.total} hits, page {found.page} of {found.total_pages}; {' | '.join(found.hints)}"))
    elif a.command == "template":
        with open(a.specs, encoding="utf-8") as file:
            specs = json.load(file)
        writers.write_text(spark, writers.annotation_template(SV.annotation_hits(service(spark, a.out, words), specs), specs), a.template)
    else:
        parts = evaluate(spark, a.judged)
        print(writers.text_table(parts["means"], "Retrieval"))
        if a.archive:
            writers.write_json(spark, parts, a.archive)


if __name__ == "__main__":
    main()
