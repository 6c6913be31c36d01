"""Sinks: Parquet tables, CSV with a byte order mark, JSON and text reports.

Tables are written by Spark. Reports are small collected frames, formatted on the driver.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = {True: "✔", False: "⚠"}


def write_table(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_index(postings: DataFrame, path: str) -> None:
    """Postings sorted by term inside files that are ranged by term: statistics let a reader skip all files but a few."""
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose header starts with the byte order mark that spreadsheets look for; arrays become joined text."""
    flat = df.select(*(F.array_join(c, "/").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes))
    first = flat.columns[0]
    flat.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small report as one file, through Hadoop."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def rows(df: DataFrame, most: int = 10_000) -> list[dict]:
    """A report's rows; reports larger than the bound are refused, not cut."""
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has {most} rows at most")
    return [r.asDict(recursive=True) for r in found]


def json_report(parts: dict[str, object]) -> str:
    return json.dumps({k: rows(v) if isinstance(v, DataFrame) else v for k, v in parts.items()}, ensure_ascii=False, indent=2, default=str)


def write_json(spark: SparkSession, parts: dict[str, object], path: str) -> None:
    write_text(spark, json_report(parts), path)


def text_table(df: DataFrame, title: str = "") -> str:
    """Aligned columns with a title line."""
    body = [[("" if v is None else str(v)) for v in r.values()] for r in rows(df)]
    widths = [max(len(x) for x in col) for col in zip(df.columns, *body, strict=True)]
    out = ["  ".join(v.ljust(w) for v, w in zip(line, widths, strict=True)).rstrip() for line in [df.columns, *body]]
    return "\n".join(([title, "=" * len(title)] if title else []) + out) + "\n"


def html_report(df: DataFrame, checks: dict[str, tuple[bool, str]], shown: int = 5, columns: int = 8, width: int = 60) -> str:
    """Data quality page: a status line per check and the first rows, long cells cut for display."""
    cell = lambda v: html.escape(str("" if v is None else v)[:width])
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns[:columns])
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in df.select(df.columns[:columns]).limit(shown).collect())
    state = "".join(f"<li>{STATUS[ok]} {html.escape(k)}: {html.escape(v)}</li>" for k, (ok, v) in checks.items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Data quality</title></head><body><ul>{state}</ul><table><tr>{head}</tr>{body}</table></body></html>"


def annotation_template(hits: DataFrame, queries: list[dict]) -> str:
    """JSON to be judged by hand: per query its hits with a preview and an open verdict. hits: query_id, rank, doc_id, score, title, preview."""
    by_query: dict[int, list] = {}
    for r in sorted(rows(hits), key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append({k: r[k] for k in r if k != "query_id"} | {"relevant": None})
    return json.dumps([q | {"results": by_query.get(q["query_id"], [])} for q in queries], ensure_ascii=False, indent=2, default=str)


def archive(reports: dict[str, dict | None]) -> dict[str, dict]:
    """Merges the reports of the offline evaluations, without absent ones."""
    return {k: v for k, v in reports.items() if v is not None}
