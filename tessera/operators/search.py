"""Ranked retrieval: query vector, cosine, boosts, threshold, order, pages, facets, similar items.

A search is one lazy plan. Filters stand before scoring and reach the scan; postings are
cut to the terms of the query (an IN list that Parquet can push down), so scoring
touches the documents of these postings alone. Only company bonuses and queries without terms need
all documents that pass the filters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import matches_either_way
from tessera.operators import filters as FL
from tessera.operators import index as IX
from tessera.session import drop, materialise, small_batches

PAGE = 20
TITLE_WEIGHT = 2.0
COMPANY_BONUS = 0.1
THRESHOLD = 0.0001
DISPLAY = 50


def query_vector(vocabulary: DataFrame, terms: list[str], n_docs: int, kind: str = "plain") -> DataFrame:
    """term, q: idf of the distinct query terms that the vocabulary (term, df) has, at unit length. At most len(terms) rows."""
    from tessera.functions.numbers import idf

    own = vocabulary.where(F.col("term").isin(sorted(set(terms))) if terms else F.lit(False)).select("term", idf(F.lit(n_docs), F.col("df"), kind).alias("q"))
    length = F.sqrt(F.sum(F.col("q") * F.col("q")).over(W.partitionBy(F.lit(1))))  # over the query's terms
    return own.withColumn("length", length).select("term", F.when(F.col("length") > 0, F.col("q") / F.col("length")).otherwise(0.0).alias("q"))


def cosine(matrix: DataFrame, query: DataFrame, norms: DataFrame) -> DataFrame:
    """doc_id, cosine of the documents that share a term with the query. query is broadcast: it has a row a query term."""
    dot = matrix.join(F.broadcast(query), "term").groupBy("doc_id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    return dot.join(norms, "doc_id").select("doc_id", (F.col("dot") / F.col("norm")).alias("cosine"))


def title_hits(titles: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, hits: distinct query terms in the title (titles: doc_id, title_tokens)."""
    own = F.array(*map(F.lit, sorted(set(terms)))) if terms else F.array().cast("array<string>")
    return titles.select("doc_id", F.size(F.array_intersect("title_tokens", own)).alias("hits")).where("hits > 0")


def final_score(cos: Column, hits: Column, bonus: Column) -> Column:
    return cos * F.pow(F.lit(TITLE_WEIGHT), hits) + bonus


@dataclass
class Index:
    """The tables that a search reads."""

    docs: DataFrame  # role columns
    titles: DataFrame  # doc_id, title_tokens
    matrix: DataFrame  # doc_id, term, w
    norms: DataFrame  # doc_id, norm
    vocabulary: DataFrame  # term, df
    n_docs: int
    kind: str = "plain"

    def written(self, path: str) -> Index:
        """The index as Parquet tables below path, read back: searches start from them and survive lost executors.

        The matrix is ranged and sorted by term, so that row group statistics leave a search
        little more than the postings of its terms to read.
        """
        rows = materialise(self.matrix)  # ranges are drawn from a sample, for which the weights would be made twice
        rows.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/matrix")
        drop(rows)
        matrix = self.docs.sparkSession.read.schema(self.matrix.schema).parquet(f"{path}/matrix")
        self.titles.write.parquet(f"{path}/titles")
        IX.norms(matrix).write.parquet(f"{path}/norms")
        IX.vocabulary(matrix).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/vocabulary")
        self.docs.sparkSession.createDataFrame([(self.n_docs, self.kind)], "n_docs long, kind string").write.parquet(f"{path}/parameters")
        return Index.read(self.docs, path)

    @staticmethod
    def read(docs: DataFrame, path: str) -> Index:
        """A stored index, with the table of the records that it was built from."""
        spark = docs.sparkSession
        titles, matrix, norms, vocabulary = (spark.read.parquet(f"{path}/{name}") for name in ("titles", "matrix", "norms", "vocabulary"))
        own = spark.read.parquet(f"{path}/parameters").first()
        return Index(docs, titles, matrix, norms, vocabulary, own["n_docs"], own["kind"])


def build(docs: DataFrame, tokens: DataFrame, features: int = 200) -> Index:
    """Index over tokens (doc_id, title_tokens, body_tokens)."""
    n = tokens.count()
    matrix = IX.tfidf_matrix(tokens, ["title_tokens", "body_tokens"], n, features)
    return Index(docs, tokens.select("doc_id", "title_tokens"), matrix, IX.norms(matrix), IX.vocabulary(matrix), n)


@dataclass
class Request:
    terms: list[str]
    text: str = ""
    filters: FL.Filters = field(default_factory=FL.Filters)
    sort_by: str = "relevance"
    page: int = 1
    page_size: int = PAGE


def scored(ix: Index, r: Request) -> DataFrame:
    """The documents that pass the filters and the threshold, with score (display scale, two digits)."""
    docs = FL.apply(ix.docs, r.filters)
    if not r.terms:
        return docs.withColumn("score", F.lit(float(DISPLAY)))
    cos = cosine(ix.matrix, query_vector(ix.vocabulary, r.terms, ix.n_docs, ix.kind), ix.norms)
    hits = title_hits(ix.titles, r.terms)
    bonus = F.when(matches_either_way(F.col("company"), F.lit(r.text)), COMPANY_BONUS).otherwise(0.0)
    rows = docs.join(cos, "doc_id", "left").join(hits, "doc_id", "left")
    score = final_score(F.coalesce("cosine", F.lit(0.0)), F.coalesce("hits", F.lit(0)), bonus)
    return FL.above(rows.withColumn("raw", score), "raw", THRESHOLD).withColumn("score", F.round(F.col("raw") * DISPLAY, 2)).drop("cosine", "hits", "raw")


def order_columns(sort_by: str) -> list[Column]:
    """Newest first among equal scores; the id settles the rest. Unknown keys keep the order of ids."""
    c = F.col
    return {
        "relevance": [F.desc("score"), F.desc_nulls_last("pub_date"), c("doc_id")],
        "date": [F.desc_nulls_last("pub_date"), c("doc_id")],
        "salary_min": [F.desc(F.coalesce("salary_min", F.lit(0.0))), c("doc_id")],
        "salary_max": [F.desc(F.coalesce("salary_max", F.lit(0.0))), c("doc_id")],
    }.get(sort_by, [c("doc_id")])


def page(hits: DataFrame, r: Request) -> DataFrame:
    """The rows of a page with their rank, by a bounded sort."""
    start = max(0, (r.page - 1) * r.page_size)
    top = hits.orderBy(*order_columns(r.sort_by)).limit(start + r.page_size)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order_columns(r.sort_by)))).where(F.col("rank") > start)  # of the top rows only


def page_count(total: int, size: int = PAGE) -> int:
    return -(-total // size)


def page_window(current: int, pages: int, around: int = 2) -> list[int]:
    return list(range(max(1, current - around), min(pages, current + around) + 1))


def search(ix: Index, r: Request) -> DataFrame:
    return page(scored(ix, r), r)


def field_counts(docs: DataFrame, tops: dict[str, int | None]) -> DataFrame:
    """field, value, n of several fields from one pass: the commonest values, as many as asked for, of ties the first by value."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in tops))
    counts = docs.select(F.explode(each).alias("x")).select("x.*").where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    bounds = {f: n for f, n in tops.items() if n is not None}
    if not bounds:
        return counts
    # Ranked by value, among the distinct values of a field.
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("field").orderBy(F.desc("n"), "value")))
    most = F.element_at(F.create_map(*(x for f, n in bounds.items() for x in (F.lit(f), F.lit(n)))), F.col("field"))
    return ranked.where(most.isNull() | (F.col("rank") <= most)).drop("rank")


def facets(docs: DataFrame, top: int = 30) -> DataFrame:
    """field, value, n: the commonest industries and cities, all educations and experiences."""
    return field_counts(docs, {"industry": top, "city": top, "education": None, "experience": None})


def similar_pairs(matrix: DataFrame, norms: DataFrame, only: list[int] | None = None) -> DataFrame:
    """i, j, score of document pairs that share a term, self left out. only: left documents, for single lookups."""
    unit = matrix.join(norms, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("u"))
    left = unit.where(F.col("doc_id").isin(only)) if only is not None else unit
    a = left.select(F.col("doc_id").alias("i"), "term", F.col("u").alias("ui"))
    b = unit.select(F.col("doc_id").alias("j"), "term", F.col("u").alias("uj"))
    return a.join(b, "term").where("i <> j").groupBy("i", "j").agg(F.sum(F.col("ui") * F.col("uj")).alias("score"))


def top_similar(pairs: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """i, rank, j, score of the k best positive neighbours."""
    rounded = pairs.withColumn("score", F.round("score", digits)).where("score > 0")
    return rounded.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy(F.desc("score"), "j"))).where(F.col("rank") <= k)


#: Documents of a block, and blocks of a partition: a task multiplies the blocks of two partitions.
BLOCK, BLOCKS = 2000, 16
#: Pairs of occurrences of a term in two blocks up to which they are multiplied one by one, and pairs or terms at a time.
FEW, PAIRS, TERMS = 4000, 1 << 22, 256

#: A block of sparse rows by term: ids of its rows, its terms as UTF-8 with their ends, where each term's entries end, row and value of each entry.
_PARTS = {"ids": np.int64, "words": np.uint8, "ends": np.int32, "upto": np.int32, "rows": np.int32, "us": np.float64}


def _packed_block(docs: pa.Table) -> dict[str, np.ndarray]:
    """A block of the rows doc_id, terms, us, in order of their ids."""
    docs = docs.take(pc.sort_indices(docs, [("doc_id", "ascending")])).combine_chunks()
    sizes = pc.list_value_length(docs["terms"]).to_numpy()
    coded = pc.list_flatten(docs["terms"]).combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    text = [w.encode() for w in coded.dictionary.to_pylist()]
    return {
        "ids": docs["doc_id"].to_numpy().astype(np.int64), "words": np.frombuffer(b"".join(text), np.uint8), "ends": np.cumsum([len(t) for t in text], dtype=np.int64).astype(np.int32),
        "upto": np.cumsum(np.bincount(code, minlength=len(text))).astype(np.int32), "rows": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order], "us": pc.list_flatten(docs["us"]).to_numpy().astype(np.float64)[order],
    }


def _words(block: dict[str, np.ndarray]) -> pa.Array:
    ends = np.concatenate([np.zeros(1, np.int32), block["ends"]])
    return pa.StringArray.from_buffers(len(block["ends"]), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(block["words"])))


def _product(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """The products of the rows of two blocks: rare terms pair by pair, frequent ones as dense columns."""
    n_a, n_b = len(a["ids"]), len(b["ids"])
    of_a = pc.index_in(_words(b), value_set=_words(a))
    shared = pc.is_valid(of_a).to_numpy(zero_copy_only=False)
    ta, tb = of_a.drop_null().to_numpy().astype(np.int64), np.flatnonzero(shared)
    at_a, at_b = (np.concatenate([[0], x["upto"][:-1]]).astype(np.int64)[t] for x, t in ((a, ta), (b, tb)))
    na, nb = a["upto"][ta] - at_a, b["upto"][tb] - at_b
    cost = na * nb
    out = np.zeros(n_a * n_b)
    rare = np.flatnonzero(cost <= FEW)
    for part in np.split(rare, np.flatnonzero(np.diff(np.cumsum(cost[rare]) // PAIRS)) + 1):
        if not len(part):
            continue
        of = np.repeat(part, cost[part])
        k = np.arange(len(of)) - np.repeat(np.cumsum(cost[part]) - cost[part], cost[part])
        x, y = at_a[of] + k // nb[of], at_b[of] + k % nb[of]
        out += np.bincount(a["rows"][x].astype(np.int64) * n_b + b["rows"][y], a["us"][x] * b["us"][y], n_a * n_b)
    out = out.reshape(n_a, n_b)
    many = np.flatnonzero(cost > FEW)
    for lo in range(0, len(many), TERMS):
        part = many[lo : lo + TERMS]
        sides = []
        for block, at, n, size in ((a, at_a[part], na[part], n_a), (b, at_b[part], nb[part], n_b)):
            entries = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
            dense = np.zeros((size, len(part)))
            dense[block["rows"][entries], np.repeat(np.arange(len(part)), n)] = block["us"][entries]
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """x in units of the last digit, rounded as Spark rounds: half up by the shortest decimal that names the number."""
    scaled = x * 10.0**digits
    out = np.floor(scaled + 0.5).astype(np.int64)
    for at in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[at] = int(Decimal(repr(float(x[at]))).scaleb(digits).to_integral_value(ROUND_HALF_UP))
    return out


class _Best:
    """The k best right rows of each row of a block so far: by rounded product, ties by id."""

    def __init__(self, ids: np.ndarray, k: int, digits: int) -> None:
        self.ids, self.k, self.digits = ids, k, digits
        self.score, self.j = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.product = np.zeros((len(ids), k))

    def add(self, sims: np.ndarray, j: np.ndarray) -> None:
        """sims: a product for each row and each of the ids j."""
        k, unit = self.k, 10.0**-self.digits
        least = (self.score[:, -1] - 0.6) * unit
        if (open_ := np.flatnonzero(self.score[:, -1] == 0)).size:
            least[open_] = np.partition(sims[open_], -k, axis=1)[:, -k] - 1.1 * unit if sims.shape[1] > k else 0.0
        r, c = np.nonzero(sims >= np.maximum(least, np.finfo(float).tiny)[:, None])
        if not len(r):
            return
        rows = np.unique(r)
        row = np.concatenate([np.repeat(rows, k), r])
        product = np.concatenate([self.product[rows].ravel(), sims[r, c]])
        score = np.concatenate([self.score[rows].ravel(), _rounded(sims[r, c], self.digits)])
        ids = np.concatenate([self.j[rows].ravel(), j[c]])
        order = np.lexsort((ids, -score, row))
        row, product, score, ids = row[order], product[order], score[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, rows)[np.searchsorted(rows, row)]
        kept = place < k
        at = row[kept], place[kept]
        self.product[at], self.score[at], self.j[at] = product[kept], score[kept], ids[kept]

    def rows(self) -> pa.RecordBatch:
        r, c = np.nonzero(self.j < np.iinfo(np.int64).max)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[r]), pa.array(self.j[r, c]), pa.array(self.product[r, c])], ["i", "j", "score"])


def best_products(rows: DataFrame, k: int, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """i, j, score: for each left row candidates that hold its k best right rows by rounded product, ties by id, by block multiplication.

    rows: doc_id, term, u and, if left and right differ, side (0 left, 1 right); without side all
    rows meet all others. Rows are dealt into blocks of bounded size, which are written once. Every
    pair of blocks is one sparse product, once for both directions; a task reads the blocks of two partitions
    where they were written and keeps the best of each of their rows, so neither the blocks nor the
    products are shuffled. Work is quadratic in the documents, as all-pairs products are, but even and in bounded memory.
    """
    spark = rows.sparkSession
    small_batches(spark)
    two = "side" in rows.columns
    own = rows if two else rows.withColumn("side", F.lit(0))
    packed = materialise(own.groupBy("doc_id", "side").agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("u").cast("double")).alias("us")))
    n = {r.side: r.n for r in packed.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = {s: max(1, -(-n.get(s, 0) // block)) for s in (0, 1)}
    dealt = packed.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.when(F.col("side") == 1, cuts[1]).otherwise(cuts[0])).cast("int"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        parts = _packed_block(table)
        return pa.table({"side": pa.array([key[0].as_py()], pa.int32()), "b": pa.array([key[1].as_py()], pa.int32()), **{name: pa.array([x.tobytes()], pa.binary()) for name, x in parts.items()}})

    # As many partitions as blocks: each is written to a file of its own, small tables are multiplied by all cores too.
    in_blocks = dealt.repartition(2 * sum(cuts.values()), "side", "b").groupBy("side", "b").applyInArrow(pack, f"side int, b int, {', '.join(f'{name} binary' for name in _PARTS)}")
    blocks = materialise(in_blocks)
    drop(packed)

    def parts(side: int, prefix: str) -> DataFrame:
        out = blocks.where(F.col("side") == side).select(*(F.col(c).alias(f"{prefix}{c}") for c in ("b", *_PARTS)))
        return out.coalesce(max(spark.sparkContext.defaultParallelism, -(-cuts[side] // BLOCKS)))

    left, right = parts(0, "a_"), parts(1 if two else 0, "b_")
    pairs = left.crossJoin(right) if two else left.join(right, F.col("a_b") <= F.col("b_b"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                p, q = (batch[f"{side}b"][row].as_py() for side in ("a_", "b_"))
                a, b = ({name: np.frombuffer(batch[f"{side}{name}"][row].as_buffer(), kind) for name, kind in _PARTS.items()} for side in ("a_", "b_"))
                sims = _product(a, b)
                if not two and p == q:
                    np.fill_diagonal(sims, 0.0)
                for at, of, values, ids in ((p, a, sims, b["ids"]), (q, b, sims.T, a["ids"]))[: 1 if two or p == q else 2]:
                    if at not in best:
                        best[at] = _Best(of["ids"].copy(), k, digits)
                    best[at].add(values, ids)
        for x in best.values():
            yield x.rows()

    return pairs.mapInArrow(multiply, "i long, j long, score double")


def similar_blocked(matrix: DataFrame, norms: DataFrame, k: int = 5, block: int = BLOCK, digits: int = 6) -> DataFrame:
    """i, rank, j, score of the k best neighbours of every document, by block multiplication: a join on terms would grow with the squares of their document frequencies."""
    unit = matrix.join(norms, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("u"))
    return top_similar(best_products(unit, k, digits, block), k, digits)


def record_view(docs: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """Records as clients see them: no nulls, whole salaries, keywords beside."""
    from tessera.functions.dates import iso
    from tessera.functions.text import safe_int, safe_str

    out = docs.select("doc_id", *(safe_str(F.col(c)).alias(c) for c in ("title", "company", "industry", "city", "education", "experience", "category", "body")), safe_int(F.col("salary_min")).alias("salary_min"), safe_int(F.col("salary_max")).alias("salary_max"), F.coalesce(iso(F.col("pub_date")), F.lit("")).alias("pub_date"), F.coalesce(iso(F.col("end_date")), F.lit("")).alias("end_date"))
    if keywords is None:
        return out.withColumn("keywords", F.array().cast("array<string>"))
    return out.join(keywords.select("doc_id", "keywords"), "doc_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def records(view: DataFrame, ids: list[int]) -> DataFrame:
    """The records of ids in their order; unknown ids give a row of nulls."""
    asked = view.sparkSession.createDataFrame([(i, k) for i, k in enumerate(ids)], "at int, asked long")
    return asked.join(view, F.col("asked") == F.col("doc_id"), "left").orderBy("at")


def similar_records(similar: DataFrame, view: DataFrame, doc_id: int) -> DataFrame:
    """rank, score and record of the neighbours of a document."""
    own = similar.where(F.col("i") == doc_id).select("j", "rank", F.round("score", 4).alias("score"))
    return own.join(view, F.col("j") == F.col("doc_id")).drop("j").orderBy("rank")
