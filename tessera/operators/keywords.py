"""Keyword extraction: TF-IDF, graph ranking, pooling, aggregation by dimension, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.numbers import idf
from tessera.operators import index as IX

TITLE_WEIGHT = 2.0
TOP = 10
CANDIDATES = 30
WINDOW = 5
DAMPING = 0.85


def tfidf(tokens: DataFrame, k: int = TOP, title_weight: float = TITLE_WEIGHT) -> DataFrame:
    """doc_id, term, score, rank of the k best terms; documents without body tokens are left out. tokens: title_tokens, body_tokens."""
    docs = tokens.where(F.size("body_tokens") > 0)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    tf = IX.term_counts(docs, {"title_tokens": title_weight, "body_tokens": 1.0})
    df = IX.document_frequency(IX.distinct_terms(docs, ["title_tokens", "body_tokens"])).crossJoin(F.broadcast(n))  # one row
    scored = tf.join(df, "term").select("doc_id", "term", (F.col("tf") * idf(F.col("n"), F.col("df"), "smooth")).alias("score"))
    return IX.top_features(scored, k, "score")


def cooccurrence(tokens: DataFrame, candidates: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, src, dst (src < dst), weight: how often two candidates stand within the window, in title and body together.

    Positions of a document are joined through a few lead columns instead of a range join.
    """
    occ = IX.occurrences(tokens, ["title_tokens", "body_tokens"]).join(candidates.select("doc_id", "term"), ["doc_id", "term"], "left_semi")
    # Only candidates remain, so a neighbour within the window is among the next window - 1 rows.
    order = W.partitionBy("doc_id").orderBy("pos")
    nexts = F.array(*(F.struct(F.lead("term", j).over(order).alias("t"), F.lead("pos", j).over(order).alias("p")) for j in range(1, window)))
    pairs = occ.withColumn("nexts", nexts).select("doc_id", "term", "pos", F.explode("nexts").alias("x")).where((F.col("x.p") - F.col("pos") < window) & (F.col("x.t") != F.col("term")))
    return pairs.groupBy("doc_id", F.least("term", "x.t").alias("src"), F.greatest("term", "x.t").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def _rank(terms: list[str], edges: list[dict], damping: float, rounds: int) -> np.ndarray:
    at = {t: i for i, t in enumerate(terms)}
    n = len(terms)
    m = np.zeros((n, n))
    for e in edges:
        i, j = at[e["src"]], at[e["dst"]]
        m[i, j] += e["weight"]
        m[j, i] += e["weight"]
    out = m.sum(1)
    loose = out == 0
    m = m / np.where(loose, 1, out)[:, None]
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        x = damping * (x @ m + x[loose].sum() / n) + (1 - damping) / n
    return x


def textrank(candidates: DataFrame, edges: DataFrame, k: int = TOP, damping: float = DAMPING, rounds: int = 50) -> DataFrame:
    """doc_id, term, score, rank by weighted PageRank; candidates without edges spread evenly.

    A document's graph (thirty nodes at most) travels as one row, so there is no group per
    document to start: graphs are ranked batch by batch.
    """
    nodes = candidates.groupBy("doc_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    links = edges.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("src", "dst", "weight")).alias("edges"))
    graphs = nodes.join(links, F.col("doc_id") == F.col("of"), "left").select("doc_id", "terms", "edges")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ids, terms, scores = [], [], []
            for doc, own, links in zip(pdf.doc_id, pdf.terms, pdf.edges, strict=True):
                x = _rank(list(own), links if links is not None else [], damping, rounds)
                ids += [doc] * len(own)
                terms += list(own)
                scores += x.tolist()
            yield pd.DataFrame({"doc_id": np.array(ids, np.int64), "term": terms, "score": np.array(scores, float)})

    return IX.top_features(graphs.mapInPandas(run, "doc_id long, term string, score double"), k, "score")


def as_lists(ranked: DataFrame, k: int = TOP) -> DataFrame:
    """doc_id, keywords in rank order."""
    rows = ranked.where(F.col("rank") <= k).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("r"))
    return rows.select("doc_id", F.col("r.term").alias("keywords"))


def pool(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id, keywords: sorted union of two lists, for documents that both have."""
    return a.join(b.select("doc_id", F.col("keywords").alias("others")), "doc_id").select("doc_id", F.array_sort(F.array_union("keywords", "others")).alias("keywords"))


def by_dimension(lists: DataFrame, docs: DataFrame, dimension: str, k: int = 20) -> DataFrame:
    """value, term, n, rank: the commonest keywords of each value of a dimension, blanks left out."""
    own = docs.where(F.col(dimension).isNotNull() & (F.trim(dimension) != "")).select("doc_id", F.col(dimension).alias("value"))
    counts = lists.select("doc_id", F.explode("keywords").alias("term")).join(own, "doc_id").groupBy("value", "term").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("value").orderBy(F.desc("n"), "term"))).where(F.col("rank") <= k)


def evaluate(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Macro precision, recall and F1 of keyword sets (doc_id, keywords) against gold sets, empty gold left out."""
    rows = gold.where(F.size("gold") > 0).join(predicted, "doc_id").select(F.array_distinct("keywords").alias("p"), F.array_distinct("gold").alias("g"))
    hit = F.size(F.array_intersect("p", "g"))
    precision = F.when(F.size("p") > 0, hit / F.size("p")).otherwise(0.0)
    recall = hit / F.size("g")
    f1 = F.when(hit > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(precision), 6).alias("p"), F.round(F.avg(recall), 6).alias("r"), F.round(F.avg(f1), 6).alias("f1"))


def best_method(scores: dict[str, float]) -> str:
    return max(sorted(scores), key=scores.__getitem__)


def best_lists(lists: dict[str, DataFrame], gold: DataFrame, most: int = 15) -> tuple[str, DataFrame]:
    """The method of greatest macro F1 against gold sets, and its lists of at most so many keywords for export."""
    scores = {name: evaluate(own, gold).first()["f1"] or 0.0 for name, own in lists.items()}
    name = best_method(scores)
    return name, lists[name].select("doc_id", F.slice("keywords", 1, most).alias("keywords"))
