"""Word vectors, k-means with choice of k, agglomerative linkage, cluster quality, principal components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import drop, materialise

LEAST_DF = 10
WORDS = 800


def word_variance(tfidf: DataFrame, n_docs: int, least_df: int = LEAST_DF, words: int = WORDS) -> DataFrame:
    """term, df, variance: the words of greatest population variance over all documents (absent ones are zero)."""
    x = F.col("w")
    var = F.sum(x * x) / F.lit(n_docs) - F.pow(F.sum(x) / F.lit(n_docs), 2)
    return tfidf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.round(var, 9).alias("variance")).where(F.col("df") >= least_df).orderBy(F.desc("variance"), "term").limit(words)


def word_vectors(tfidf: DataFrame, chosen: DataFrame) -> DataFrame:
    """term, doc_id, w at unit length per term."""
    rows = tfidf.join(F.broadcast(chosen.select("term")), "term")  # at most WORDS rows
    length = rows.groupBy("term").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return rows.join(F.broadcast(length), "term").select("term", "doc_id", (F.col("w") / F.when(F.col("len") > 0, F.col("len")).otherwise(1.0)).alias("w"))


def _partial_gram(n: int, docs: int = 256):
    """Sums of the products of word pairs over the documents of a partition; rows (doc_id, i, w) are sorted by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block, at, last = np.zeros((n, n)), np.zeros((docs, n)), -1, None
        for batch in batches:
            for doc, i, w in zip(batch["doc_id"].to_pylist(), batch["i"].to_pylist(), batch["w"].to_pylist(), strict=True):
                if at < 0 or doc != last:
                    if at == docs - 1:
                        total += block.T @ block
                        block[:], at = 0.0, -1
                    at, last = at + 1, doc
                block[at, i] += w
        total += block.T @ block
        i, j = np.nonzero(np.triu(total))
        for k in range(0, len(i), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(i[part].astype(np.int32)), pa.array(j[part].astype(np.int32)), pa.array(total[i[part], j[part]])], ["i", "j", "x"])

    return run


def gram(vectors: DataFrame, most: int = WORDS) -> tuple[list[str], np.ndarray]:
    """The words in order and the inner products of their vectors over all documents; more words are refused, so the matrix is bounded."""
    vectors = materialise(vectors)
    terms = [r.term for r in vectors.select("term").distinct().orderBy("term").limit(most + 1).collect()]
    if len(terms) > most:
        raise ValueError(f"at most {most} words have a place in the matrix")
    out = np.zeros((len(terms), len(terms)))
    if not terms:
        return terms, out
    numbered = vectors.sparkSession.createDataFrame(list(zip(terms, range(len(terms)), strict=True)), "term string, i int")
    rows = vectors.join(F.broadcast(numbered), "term").select("doc_id", "i", "w").repartition("doc_id").sortWithinPartitions("doc_id", "i")
    sums = rows.mapInArrow(_partial_gram(len(terms)), "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    for batch in sums.toArrow().to_batches():
        i, j, x = (batch[c].to_numpy() for c in ("i", "j", "x"))
        out[i, j] = out[j, i] = np.round(x, 12)  # the order of the sum doesn't show
    drop(vectors)
    return terms, out


@dataclass
class Words:
    """Words as points on the driver: at most WORDS of them, whatever the corpus."""

    spark: SparkSession
    terms: list[str]
    x: np.ndarray

    @staticmethod
    def of(vectors: DataFrame, most: int = WORDS) -> Words:
        """Points with exactly the inner products of the word vectors over all documents.

        With G = V L V^T the Gram matrix, the rows of V sqrt(L) have G as theirs, so that
        distances, linkage, k-means and principal components are those of the full vectors.
        """
        terms, g = gram(vectors, most)
        values, axes = np.linalg.eigh(g) if terms else (np.zeros(0), g)
        return Words(vectors.sparkSession, terms, axes[:, ::-1] * np.sqrt(np.maximum(values[::-1], 0.0)))

    def labelled(self, labels: np.ndarray) -> DataFrame:
        """term, cluster."""
        return self.spark.createDataFrame([(t, int(c)) for t, c in zip(self.terms, labels, strict=True)], "term string, cluster int")


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def kmeans_labels(x: np.ndarray, k: int, starts: int = 10, seed: int = 42, rounds: int = 300) -> np.ndarray:
    """Labels of k clusters: the best of several runs from centres drawn in proportion to their squared distance."""
    rng = np.random.default_rng(seed)
    best, least = np.zeros(len(x), np.int64), np.inf
    for _ in range(starts):
        centres = x[[int(rng.integers(len(x)))]]
        while len(centres) < k:
            far = square_distances(x, centres).min(1)
            at = int(rng.choice(len(x), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(x)))
            centres = np.vstack([centres, x[at]])
        label = None
        for _ in range(rounds):
            far = square_distances(x, centres)
            new = far.argmin(1)
            if label is not None and (new == label).all():
                break
            label = new
            sizes = np.bincount(label, minlength=k)
            sums = np.zeros_like(centres)
            np.add.at(sums, label, x)
            # An empty cluster takes the point that is farthest from its centre.
            centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], x[far.min(1).argmax()])
        cost = float(square_distances(x, centres)[np.arange(len(x)), label].sum())
        if cost < least - 1e-12:
            best, least = label, cost
    return best


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean over the points of (b - a) / max(a, b): a the mean distance inside the own cluster, b that to the nearest other; 0 for a cluster of one."""
    d = np.sqrt(square_distances(x, x))
    np.fill_diagonal(d, 0)
    own, sizes = np.unique(labels, return_inverse=True)[1], np.unique(labels, return_counts=True)[1]
    if len(sizes) < 2:
        return -1.0
    sums = np.stack([d[:, own == c].sum(1) for c in range(len(sizes))], 1)
    rows = np.arange(len(x))
    a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
    others = sums / sizes
    others[rows, own] = np.inf
    b = others.min(1)
    s = np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(s.mean())


def kmeans(words: Words, ks: range = range(6, 13), seed: int = 42) -> tuple[np.ndarray, int]:
    """Labels for the k of best silhouette, and that k."""
    if not words.terms:
        return np.zeros(0, np.int64), 0
    runs = {k: kmeans_labels(words.x, k, seed=seed) for k in ks if k <= len(words.terms)} or {1: np.zeros(len(words.terms), np.int64)}
    best = max(runs, key=lambda k: (silhouette(words.x, runs[k]), -k))
    return runs[best], best


def linkage(x: np.ndarray, k: int, method: str = "ward") -> np.ndarray:
    """Labels of k clusters by Lance-Williams updates over a few hundred points (driver side, quadratic memory)."""
    n = len(x)
    d = np.sqrt(square_distances(x, x))
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    label = np.arange(n)
    live = np.ones(n, bool)
    for _ in range(n - k):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        di, dj, dij = d[i], d[j], d[i, j]
        if method == "single":
            new = np.minimum(di, dj)
        elif method == "complete":
            new = np.where(np.isinf(di) | np.isinf(dj), np.inf, np.maximum(di, dj))
        else:
            with np.errstate(invalid="ignore"):
                new = np.sqrt(np.maximum(((size[i] + size) * di**2 + (size[j] + size) * dj**2 - size * dij**2) / (size[i] + size[j] + size), 0))
        new[~live] = np.inf
        new[[i, j]] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        live[j] = False
        size[i] += size[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def hierarchical(words: Words, k: int, method: str = "ward") -> np.ndarray:
    """Labels of k clusters by agglomeration."""
    return linkage(words.x, min(k, len(words.terms)), method) if words.terms else np.zeros(0, np.int64)


def quality(vectors: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per cluster size and mean cosine of its pairs; and overall intra (mean of clusters of two or more) and inter (1 - mean cosine of centroids).

    vectors: item, dim, w at unit length; labels: item, cluster. The mean over the pairs of a cluster comes
    from the length of its sum, |s|^2 = n + 2 * sum of pair cosines, so no pair is built.
    """
    rows = vectors.join(labels, "item")
    size = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    sums = rows.groupBy("cluster", "dim").agg(F.sum("w").alias("s"))
    own = rows.groupBy("cluster").agg(F.sum(F.col("w") * F.col("w")).alias("self"))
    square = sums.groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    per = size.join(own, "cluster").join(square, "cluster")
    n = F.col("size")
    per = per.select("cluster", "size", F.round(F.when(n > 1, (F.col("square") - F.col("self")) / (n * (n - 1))).otherwise(0.0), 6).alias("intra"))
    unit = sums.join(square, "cluster").select("cluster", "dim", (F.col("s") / F.sqrt("square")).alias("u"))
    k = F.count(F.lit(1))
    total = unit.groupBy("dim").agg(F.sum("u").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("square"))
    inter = total.crossJoin(F.broadcast(size.agg(k.alias("k")))).select(F.round(F.when(F.col("k") > 1, 1 - (F.col("square") - F.col("k")) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0), 6).alias("inter"))  # one row
    return per, per.where("size > 1").agg(F.round(F.coalesce(F.avg("intra"), F.lit(0.0)), 6).alias("intra")).crossJoin(F.broadcast(inter))


def agreement(labels: DataFrame) -> DataFrame:
    """purity and entropy (bits) of clusters against classes. labels: cluster, label."""
    cells = labels.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    per = cells.groupBy("cluster").agg(F.max("n").alias("most"), F.sum("n").alias("size"), F.sum(F.col("n") * F.log2("n")).alias("x"))
    entropy = F.log2("size") - F.col("x") / F.col("size")
    return per.agg(F.round(F.sum("most") / F.sum("size"), 6).alias("purity"), F.round(F.sum(entropy * F.col("size")) / F.sum("size"), 6).alias("entropy"))


def overlap(labels: DataFrame) -> DataFrame:
    """a, b, overlap for each pair of clusterings: the share of items that lie in the commonest b of their a. labels: item, method, cluster."""
    other = labels.select("item", F.col("method").alias("b"), F.col("cluster").alias("of_b"))
    both = labels.select("item", F.col("method").alias("a"), F.col("cluster").alias("of_a")).join(other, "item").where("a < b")
    cells = both.groupBy("a", "b", "of_a", "of_b").agg(F.count(F.lit(1)).alias("n"))
    most = cells.groupBy("a", "b", "of_a").agg(F.max("n").alias("most"), F.sum("n").alias("size"))
    return most.groupBy("a", "b").agg(F.round(F.sum("most") / F.sum("size"), 6).alias("overlap"))


def pca(words: Words, k: int = 2) -> tuple[np.ndarray, list[float]]:
    """Coordinates on the first k principal components of the centred points, and the share of the variance that each explains. Signs are such that a component's greatest coordinate is positive."""
    if not words.terms:
        return np.zeros((0, k)), [0.0] * k
    u, s, _ = np.linalg.svd(words.x - words.x.mean(0), full_matrices=False)
    out = u[:, :k] * s[:k]
    out = np.pad(out, ((0, 0), (0, k - out.shape[1])))
    signs = np.sign(out[np.abs(out).argmax(0), np.arange(k)])
    total = float((s**2).sum())
    shares = [float(x) / total if total else 0.0 for x in np.pad(s**2, (0, max(0, k - len(s))))[:k]]
    return out * np.where(signs == 0, 1, signs), shares


def names(labels: DataFrame, word: str = "term", n: int = 3) -> DataFrame:
    """cluster, size, name: its first words joined."""
    rows = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.slice(F.sort_array(F.collect_list(word)), 1, n).alias("first"))
    return rows.select("cluster", "size", F.array_join("first", " · ").alias("name"))


def vectors_of_embeddings(df: DataFrame, key: str, column: str) -> DataFrame:
    """item, dim, w at unit length from an array column."""
    length = F.sqrt(F.aggregate(F.transform(column, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    return df.select(F.col(key).alias("item"), F.posexplode(F.transform(column, lambda x: x.cast("double") / length)).alias("dim", "w"))
