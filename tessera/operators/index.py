"""Inverted index, weights and vectors, as long tables (term, doc_id, ...).

Input of all builders is a token table: doc_id and arrays of tokens per field. All tokens of a document stand
in one row, so its terms are counted where the row lies (by Arrow batch); what is shuffled are counts, not
occurrences.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.numbers import idf, log_tf, safe_norm
from tessera.session import small_batches


def occurrences(tokens: DataFrame, fields: list[str]) -> DataFrame:
    """doc_id, term, pos over the concatenation of the fields; positions count all tokens."""
    every = F.concat(*(F.coalesce(F.col(f), F.array().cast("array<string>")) for f in fields))
    return tokens.select("doc_id", F.posexplode(every).alias("pos", "term"))


#: Tokens that are counted at a time (a longer document alone).
TOKENS = 1 << 18


def _slices(batch: pa.RecordBatch, fields: list[str], tokens: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many tokens: what a worker holds depends neither on rows of a batch nor on the length of texts."""
    sizes = sum(pc.list_value_length(batch[f]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)
    upto = np.cumsum(sizes)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + tokens, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _counted(batch: pa.RecordBatch, fields: dict[str, float], least: int, stop: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of token rows: term and row of each posting, where it begins in the sorted occurrences, their positions and weights."""
    rows, positions, weights, flat = [], [], [], []
    before = np.zeros(batch.num_rows, np.int64)
    for f, weight in fields.items():
        n = pc.list_value_length(batch[f]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), n)
        rows.append(row)
        positions.append(np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + before[row])
        weights.append(np.full(len(row), weight))
        flat.append(batch[f].flatten())
        before += n
    encoded = pa.concat_arrays(flat).dictionary_encode()
    names, code = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
    wanted = pc.greater_equal(pc.utf8_length(names), least)
    if stop:
        wanted = pc.and_(wanted, pc.invert(pc.is_in(names, pa.array(stop, names.type))))
    keep = wanted.to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
    key = (np.concatenate(rows) * max(len(names), 1) + code)[keep]
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.flatnonzero(np.diff(key, prepend=-1))
    return names.take(pa.array(key[begins] % max(len(names), 1))), key[begins] // max(len(names), 1), begins, np.concatenate(positions)[keep][order], np.concatenate(weights)[keep][order]


def postings(tokens: DataFrame, fields: list[str], stop: list[str] = (), least: int = 2) -> DataFrame:
    """term, doc_id, tf, positions of the tokens that are long enough and no stop words. Positions count all tokens of the fields together."""
    small_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, fields, TOKENS)):
            terms, row, begins, position, _ = _counted(batch, dict.fromkeys(fields, 1.0), least, list(stop))
            ends = np.append(begins, len(position))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(position, pa.int32()))
            yield pa.RecordBatch.from_arrays([terms, batch["doc_id"].take(pa.array(row)), pa.array(np.diff(ends)), lists], ["term", "doc_id", "tf", "positions"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", *fields).mapInArrow(run, f"term string, doc_id {kind}, tf long, positions array<int>")


def term_counts(tokens: DataFrame, weight: dict[str, float], least: int = 0) -> DataFrame:
    """term, doc_id, tf with each field's occurrences counted at its weight."""
    small_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, list(weight), TOKENS)):
            terms, row, begins, _, weights = _counted(batch, weight, least, [])
            tf = np.add.reduceat(weights, begins) if len(begins) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([terms, batch["doc_id"].take(pa.array(row)), pa.array(tf)], ["term", "doc_id", "tf"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", *weight).mapInArrow(run, f"term string, doc_id {kind}, tf double")


def distinct_terms(tokens: DataFrame, fields: list[str]) -> DataFrame:
    """doc_id, term: each term of a document once. Document frequencies need no more, so nothing is counted for them."""
    every = F.concat(*(F.coalesce(F.col(f), F.array().cast("array<string>")) for f in fields))
    return tokens.select("doc_id", F.explode(F.array_distinct(every)).alias("term"))


def document_frequency(post: DataFrame) -> DataFrame:
    """term, df. post has a row per (term, doc_id)."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


#: Ids that one list of postings spans; a common term has several lists, so no row grows with the corpus.
SPAN = 1_000_000


def lexicon(post: DataFrame, span: int = SPAN) -> DataFrame:
    """The nested form: term, part, df and postings sorted by document, of the documents whose id is in the part-th span."""
    part = F.floor(F.col("doc_id") / span).cast("long").alias("part")
    return post.groupBy("term", part).agg(F.count(F.lit(1)).alias("df"), F.sort_array(F.collect_list(F.struct("doc_id", "tf", "positions"))).alias("postings"))


def index_stats(tokens: DataFrame, fields: list[str], post: DataFrame) -> DataFrame:
    """raw_tokens, valid_postings, terms, avg_df."""
    sizes = [F.greatest(F.size(f), F.lit(0)).cast("long") for f in fields]
    a = tokens.agg(F.coalesce(F.sum(sum(sizes[1:], sizes[0])), F.lit(0)).alias("raw_tokens"))
    b = document_frequency(post).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("valid_postings"), F.count(F.lit(1)).alias("terms"), F.round(F.avg("df"), 6).alias("avg_df"))
    return a.crossJoin(F.broadcast(b))  # one row each


def boolean_and(post: DataFrame, terms: list[str]) -> DataFrame:
    """Documents that have every term. Unknown terms and empty queries match nothing."""
    own = sorted(set(terms))
    return post.where(F.col("term").isin(own) if own else F.lit(False)).groupBy("doc_id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(own)).select("doc_id")


def boolean_or(post: DataFrame, terms: list[str]) -> DataFrame:
    return post.where(F.col("term").isin(sorted(set(terms))) if terms else F.lit(False)).select("doc_id").distinct()


def boolean_not(docs: DataFrame, post: DataFrame, terms: list[str]) -> DataFrame:
    return docs.select("doc_id").join(boolean_or(post, terms), "doc_id", "left_anti")


def sequential_and(tokens: DataFrame, fields: list[str], terms: list[str]) -> DataFrame:
    """The same by a scan of the token arrays."""
    from tessera.functions.text import contains_all

    every = F.concat(*(F.col(f) for f in fields))
    return tokens.where(contains_all(every, terms)).select("doc_id")


def timed(post: DataFrame, tokens: DataFrame, fields: list[str], terms: list[str], runs: int = 1) -> list[tuple[str, int, float]]:
    """(method, hits, mean seconds) of a conjunction by a scan of the tokens and by the postings; differing hits are an error."""
    out = []
    for name, hits in (("scan", sequential_and(tokens, fields, terms)), ("index", boolean_and(post, terms))):
        began = time.perf_counter()
        counts = {hits.count() for _ in range(runs)}
        out.append((name, counts.pop(), (time.perf_counter() - began) / runs))
    if out[0][1] != out[1][1]:
        raise ValueError(f"scan and index disagree: {out}")
    return out


def verify(post: DataFrame, tokens: DataFrame, fields: list[str], least: int = 2) -> DataFrame:
    """(term, doc_id) pairs on which index and scan disagree, with the side that has them. All terms are checked."""
    scan = occurrences(tokens, fields).where(F.length("term") >= least).select("term", "doc_id").distinct()
    own = post.select("term", "doc_id")
    return own.exceptAll(scan).withColumn("side", F.lit("index")).unionByName(scan.exceptAll(own).withColumn("side", F.lit("scan")))


def weights(post: DataFrame, n_docs: Column | int, scheme: str = "ltc", kind: str = "plain") -> DataFrame:
    """term, doc_id, w under a scheme: ltc (log tf, idf, unit length), nfc (tf, idf, unit length), bfx (binary idf), tfx (tf alone)."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    df = document_frequency(post)
    rows = post.select("term", "doc_id", "tf").join(df, "term")
    rarity = idf(n, F.col("df"), kind)
    raw = {"ltc": log_tf(F.col("tf")) * rarity, "nfc": F.col("tf") * rarity, "bfx": rarity, "tfx": F.col("tf").cast("double")}[scheme]
    rows = rows.select("term", "doc_id", raw.alias("w"))
    return unit_length(rows) if scheme in ("ltc", "nfc") else rows


def norms(vectors: DataFrame, w: str = "w") -> DataFrame:
    return vectors.groupBy("doc_id").agg(safe_norm(F.sum(F.col(w) * F.col(w))).alias("norm"))


def unit_length(vectors: DataFrame) -> DataFrame:
    return vectors.join(norms(vectors), "doc_id").select("term", "doc_id", (F.col("w") / F.col("norm")).alias("w"))


def scheme_stats(post: DataFrame, n_docs: int, kind: str = "plain") -> DataFrame:
    """Per scheme: stored weights, average per document, and how many are not zero. All schemes are columns of one pass."""
    rarity = idf(F.lit(n_docs), F.col("df"), kind)
    raw = {"ltc": log_tf(F.col("tf")) * rarity, "nfc": F.col("tf") * rarity, "bfx": rarity, "tfx": F.col("tf").cast("double")}
    rows = post.select("term", "doc_id", "tf").join(document_frequency(post), "term").select("doc_id", *(c.alias(s) for s, c in raw.items()))
    lengths = rows.groupBy("doc_id").agg(*(safe_norm(F.sum(F.col(s) * F.col(s))).alias(f"{s}_norm") for s in ("ltc", "nfc")))
    whole = rows.join(lengths, "doc_id")
    w = {s: F.col(s) / F.col(f"{s}_norm") if s in ("ltc", "nfc") else F.col(s) for s in raw}
    counts = whole.agg(F.count(F.lit(1)).alias("stored"), *(F.count_if(F.abs(c) > 1e-12).alias(s) for s, c in w.items()))
    each = F.array(*(F.struct(F.lit(s).alias("scheme"), F.col(s).alias("non_zero")) for s in raw))
    return counts.select("stored", F.round(F.col("stored") / F.lit(n_docs), 6).alias("avg_per_doc"), F.explode(each).alias("x")).select("stored", "avg_per_doc", "x.non_zero", "x.scheme")


def top_features(vectors: DataFrame, k: int, score: str = "w", digits: int = 9) -> DataFrame:
    """The k best terms of each document, ties by term, with their rank. Scores are compared rounded, so that engines agree."""
    order = W.partitionBy("doc_id").orderBy(F.desc(F.round(score, digits)), "term")
    # Written so that the planner doesn't cut before the exchange too: a document's terms lie in all tasks there, and a sort would cut nothing.
    return vectors.withColumn("rank", F.row_number().over(order)).where(F.col("rank") - k <= 0)


def tfidf_matrix(tokens: DataFrame, fields: list[str], n_docs: int, k: int = 200) -> DataFrame:
    """doc_id, term, w: raw tf times smooth idf, the k best of each document."""
    tf = term_counts(tokens, dict.fromkeys(fields, 1.0))
    df = document_frequency(distinct_terms(tokens, fields))
    scored = tf.join(df, "term").select("doc_id", "term", (F.col("tf") * idf(F.lit(n_docs), F.col("df"), "smooth")).alias("w"))
    return top_features(scored, k).select("doc_id", "term", "w")


def vocabulary(matrix: DataFrame) -> DataFrame:
    """term, df of the terms of a matrix."""
    return document_frequency(matrix)


def consistency(a: DataFrame, b: DataFrame) -> DataFrame:
    """n_a, n_b, n_both, only_a, only_b of two sets of terms."""
    both = a.select("term", F.lit(1).alias("a")).join(b.select("term", F.lit(1).alias("b")), "term", "full")
    return both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
