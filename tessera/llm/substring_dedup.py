"""Exact removal of repeated word windows (substring dedup) by super-k-mer partitioning.

Consecutive windows that share a minimiser (the least hash of their
``MINIMISER``-word grams) form a super-k-mer. It travels as one packed string to
the bucket of its minimiser, where sorting counts windows exactly. Equal windows
have equal minimisers, so no pair is missed.

What keeps the shuffles small and even:

* Minimisers are counted first, 16 bytes each and pre-aggregated. A minimiser that
  occurs once rules all its windows out, so unique text never travels as strings.
* Equal super-k-mers (copies, common passages) are folded by digest before their
  string travels, and a bucket with a single distinct super-k-mer needs no string.
* A bucket of more than ``BUCKET`` distinct super-k-mers is not gathered: its windows
  are counted by digest with map-side sums instead. Such buckets are known by a count, and their
  keys are broadcast while they are few, so that their super-k-mers stay where they lie.
* Joins from many occurrences to one verdict are left to adaptive skew splitting.

Defined results: null text has no words; rows are told apart by doc_id and text, and
repeated rows count as separate documents, so that all their windows recur; a null
doc_id is kept like any other; texts shorter than the window lose nothing; an empty
table gives an empty result. Only doc_id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm import superkmer_kernel as S
from tessera.llm.common import materialise, other_key, small_batches

#: Distinct super-k-mers that one task gathers for a bucket.
BUCKET = 2048
#: Keys of larger buckets that are broadcast (8 bytes each); more are joined by a shuffle.
MOST_KEYS = 1 << 20

_ROW = "doc_id long, text_hash long"
_KMER = "array<struct<bucket:long,digest:binary,packed:binary,start:int,n:int>>"


def _minimisers(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, a, offsets in K.runs(batch["text"]):
                starts, ends, first = K.words(a, offsets)
                hashes = K.word_hash(a, starts, ends)
                row, at, n, key = S.super_kmers(hashes, first, window)
                if len(row):
                    weight = 1 + S.repeats_inside(hashes, at, n, key, window).astype(np.int32)
                    take = pa.array(row + i)
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].take(take), batch["text_hash"].take(take), pa.array(key.view(np.int64)), pa.array(weight, pa.int32())], ["doc_id", "text_hash", "bucket", "weight"])

    return run


def _pack(window: int):
    """One row per document: final if no bucket of its is shared, else its text and shared super-k-mers."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("packed_text", pa.binary()), ("kmers", pa.list_(pa.struct([("bucket", pa.int64()), ("digest", pa.binary()), ("packed", pa.binary()), ("start", pa.int32()), ("n", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for i, j, a, offsets in K.runs(batch["text"]):
                starts, ends, first = K.words(a, offsets)
                row, at, n, key = S.super_kmers(K.word_hash(a, starts, ends), first, window)
                spans = np.searchsorted(row, np.arange(j - i + 1))
                out: dict[str, list] = {name: [] for name in schema.names[2:]}
                for r in range(j - i):
                    words = a[offsets[r] : offsets[r + 1]].tobytes().split()
                    shared = batch["shared"][i + r].values
                    out["n_words"].append(len(words))
                    joined = b" ".join(words)
                    if shared is None:
                        out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                        out["packed_text"].append(None)
                        out["kmers"].append([])
                        continue
                    out["kept_sha256"].append(None)
                    out["packed_text"].append(squeeze.compress(joined))
                    own = slice(spans[r], spans[r + 1])
                    mine = []
                    for k in np.flatnonzero(np.isin(key[own].view(np.int64), shared.to_numpy())) + own.start:
                        start = int(at[k] - first[r])
                        packed = b" ".join(words[start : start + int(n[k]) + window - 1])
                        mine.append({"bucket": int(key[k].view(np.int64)), "digest": hashlib.blake2b(packed, digest_size=16).digest(), "packed": packed, "start": start, "n": int(n[k])})
                    out["kmers"].append(mine)
                arrays = [batch["doc_id"].slice(i, j - i), batch["text_hash"].slice(i, j - i), *(pa.array(out[name], schema.field(name).type) for name in schema.names[2:])]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _windows(packed: bytes, window: int) -> list[bytes]:
    words = packed.split(b" ")
    return [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]


def _judge_bucket(rows: list[tuple[bytes, bytes, int]], window: int) -> list[tuple[bytes, int, int]]:
    """Sorts the windows of a bucket; digest and span of those that occur twice. rows: digest, packed, copies.

    Places are sorted, not copies of the windows: by a hash of their bytes first, and where
    hashes are equal the bytes themselves decide.
    """
    texts = [packed for _, packed, _ in rows]
    a = np.frombuffer(b" ".join(texts), np.uint8)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, ends, first = K.words(a, np.minimum(at, len(a)))
    n = np.maximum(np.diff(first) - window + 1, 0)
    row = np.repeat(np.arange(len(rows)), n)
    word = first[:-1][row] + K.concat(n)
    lo, hi = starts[word], ends[word + window - 1]
    key = K.span_hash(K.prefix_sums(a), lo, hi)
    raw = a.tobytes()
    copies = np.array([c for *_, c in rows])
    twice = copies[row] > 1
    order = np.argsort(key, kind="stable")
    begins = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] ^ np.uint64(1)))
    sizes = np.diff(np.append(begins, len(order)))
    for at, size in zip(begins[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        own: dict[bytes, list[int]] = defaultdict(list)
        for k in order[at : at + size].tolist():
            own[raw[lo[k] : hi[k]]].append(k)
        for same in own.values():
            if len(same) > 1:
                twice[same] = True
    inside = word - first[:-1][row]
    hit = np.flatnonzero(twice)
    parts = np.split(hit, np.flatnonzero((np.diff(hit) != 1) | (np.diff(row[hit]) != 0)) + 1) if len(hit) else []
    return [(rows[row[x[0]]][0], int(inside[x[0]]), int(inside[x[-1]]) + 1) for x in parts]


_VERDICT = pa.schema([("digest", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())])


def _verdicts(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _VERDICT.types, strict=True)], schema=_VERDICT)


def _judge(window: int):
    """Rows come sorted by bucket; a bucket may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows, out = None, [], []
        for batch in batches:
            for b, digest, packed, copies in zip(*(batch[c].to_pylist() for c in ("bucket", "digest", "packed", "copies")), strict=True):
                if b != bucket:
                    out += _judge_bucket(rows, window)
                    bucket, rows = b, []
                rows.append((digest, packed, copies))
            if len(out) > 1000:
                yield _verdicts(out)
                out = []
        out += _judge_bucket(rows, window)
        if out:
            yield _verdicts(out)

    return run


def _single_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, packed, copies in zip(*(batch[c].to_pylist() for c in ("digest", "packed", "copies")), strict=True):
                own = [hashlib.blake2b(w, digest_size=16).digest() for w in _windows(packed, window)]
                yield pa.RecordBatch.from_arrays([pa.array([digest] * len(own), pa.binary()), pa.array(range(len(own)), pa.int32()), pa.array(own, pa.binary()), pa.array([copies] * len(own), pa.int64())], ["digest", "lo", "window", "copies"])

    return run


def _apply(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            removed, sha, kept = [], [], []
            for packed, spans in zip(batch["packed_text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                words = expand.decompress(packed).split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    gone[s["lo"]] += 1
                    gone[s["hi"] + window - 1] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_words"], pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    return run


def _keys(buckets: DataFrame, name: str) -> DataFrame:
    """The keys of some buckets, broadcast if they are few enough by count."""
    keys = buckets.select(F.col("bucket").alias(name))
    return F.broadcast(keys) if keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS else keys


def repeated_spans(documents: DataFrame, window: int = S.WINDOW) -> tuple[DataFrame, DataFrame]:
    """The documents (one row each, with text where anything may go) and, by doc_id and text_hash, the spans of repeated windows."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    minimisers = docs.mapInArrow(_minimisers(window), f"{_ROW}, bucket long, weight int")
    shared = materialise(minimisers.groupBy("bucket").agg(F.sum("weight").alias("weight")).where("weight > 1").select(F.col("bucket").alias("shared_bucket")))
    of_doc = minimisers.join(shared, F.col("bucket") == F.col("shared_bucket")).groupBy("doc_id", "text_hash").agg(F.collect_set("bucket").alias("shared"))
    of_doc = of_doc.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash"), "shared")
    packed = materialise(
        docs.join(of_doc, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_hash")), "left")
        .select("doc_id", "text_hash", "text", "shared")
        .mapInArrow(_pack(window), f"{_ROW}, n_words long, kept_sha256 string, packed_text binary, kmers {_KMER}")
    )
    kmers = packed.where(F.size("kmers") > 0).select("doc_id", "text_hash", F.explode("kmers").alias("k")).select("doc_id", "text_hash", "k.*")
    distinct = materialise(kmers.groupBy("bucket", "digest").agg(F.count(F.lit(1)).alias("copies"), F.first("packed").alias("packed"), F.first("n").alias("n")))
    # Aggregates alone tell what a bucket holds; no join sends a hot bucket's super-k-mers to one task.
    per_bucket = materialise(distinct.groupBy("bucket").agg(F.count(F.lit(1)).alias("distinct"), F.max("copies").alias("copies"), F.first("digest").alias("digest"), F.first("n").alias("n")))
    alone = per_bucket.where("distinct = 1 and copies > 1").select("digest", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    hot = _keys(per_bucket.where(F.col("distinct") > BUCKET), "hot")
    done = per_bucket.where("distinct = 1 and copies > 1").select(other_key(F.col("bucket").cast("string")).alias("done"))
    open_ = distinct.join(hot, F.col("bucket") == F.col("hot"), "left_anti").join(done, other_key(F.col("bucket").cast("string")) == F.col("done"), "left_anti")
    gathered = open_.select("bucket", "digest", "packed", "copies").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_judge(window), "digest binary, lo int, hi int")
    single = distinct.join(hot, F.col("bucket") == F.col("hot"), "left_semi").select("digest", "packed", "copies").mapInArrow(_single_windows(window), "digest binary, lo int, window binary, copies long")
    twice = single.groupBy("window").agg(F.sum("copies").alias("total")).where("total > 1").select(other_key(F.hex("window")).alias("other"))
    hot_hits = single.join(twice, other_key(F.hex("window")) == F.col("other")).select("digest", "lo", (F.col("lo") + 1).alias("hi"))
    verdicts = alone.unionByName(gathered).unionByName(hot_hits).select(F.col("digest").alias("judged"), "lo", "hi")
    spans = kmers.select("doc_id", "text_hash", "digest", "start").join(verdicts, F.col("digest") == F.col("judged"))
    spans = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))).alias("spans"))
    return packed, spans


def remove_repeats(documents: DataFrame, window: int = S.WINDOW, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, unless keep_text is false, the kept words (null where nothing went) of every document."""
    packed, spans = repeated_spans(documents, window)
    spans = spans.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash"), "spans")
    whole = packed.where("packed_text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    cut = (
        packed.where("packed_text is not null")
        .select("doc_id", "text_hash", "n_words", "packed_text")
        .join(spans, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_hash")), "left")
        .select("doc_id", "n_words", "packed_text", "spans")
        .mapInArrow(_apply(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    )
    out = whole.unionByName(cut)
    return out if keep_text else out.drop("kept_text")
