"""SimHash near-dedup with bit-sliced comparison.

A fingerprint has a bit set where more than half of the XXH64 hashes (seed 42) of a
document's shingles have it. Fingerprints at ``bit_sliced.RADIUS`` or fewer differing
bits are linked, and links are closed into components.

Candidates are exact: with the 64 bits in five bands, two fingerprints that differ in
at most three bits agree on two bands at least, so each of the ten band pairs is a
bucket key of 25 or 26 bits. Distinct fingerprints alone travel (copies fold in
a groupBy first), and only from buckets that hold two. A bucket of more than ``BUCKET``
is cut into parts that meet pairwise in separate tasks. In a bucket, fingerprints
are compared bit-sliced and only the links of a spanning forest leave.

``one_of_each`` (the pipeline's stage) removes near copies by exact similarity: radius
and MinHash bands over five-word shingles only propose them (see ``near_copies``).

Defined results: A-Z are lower-cased; null, empty and blank texts have fingerprint zero
and are linked like any other; repeated rows get the same component; component_id is the
least doc_id of the component (null only if all its doc_ids are null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import bit_sliced as B
from tessera.llm import kernel as K
from tessera.llm import near_copies as N
from tessera.llm.common import materialise, small_batches
from tessera.llm.components import connected_components

SEED = 42
SHINGLE = 3
#: Words of a shingle where near copies are removed (op2's contract has its own).
COPY_SHINGLE = 5
#: Fingerprints that a task gathers of one bucket, or of one half of a cut bucket.
BUCKET = 4096
BANDS = (13, 13, 13, 13, 12)
#: Fingerprints whose small groups are compared together.
TOGETHER = 1 << 15


def shingle_hashes(text: bytes, shingle: int = SHINGLE, at_once: int = 1 << 16) -> np.ndarray:
    """Hashes of the shingles in their order, so many at a time; a text of fewer words is one shingle, one without words has none."""
    words = text.translate(K.LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    out = np.empty(len(words) - shingle + 1, np.uint64)
    for k in range(0, len(out), at_once):
        part = words[k : k + at_once + shingle - 1]
        out[k : k + at_once] = [digest(b" ".join(g), SEED) for g in zip(*(part[i:] for i in range(shingle)), strict=False)]
    return out


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, j, a, offsets in K.runs(batch["text"]):
                raw = a.tobytes()
                found += [fingerprint(raw[offsets[r] : offsets[r + 1]], shingle) for r in range(j - i)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(np.array(found, np.uint64).view(np.int64))], [*keep, "fp"])

    return run


def _masks() -> list[int]:
    bands, at = [], 0
    for width in BANDS:
        bands.append(((1 << width) - 1) << at)
        at += width
    masks = [a | b for a, b in combinations(bands, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bucket_keys(fp: Column) -> Column:
    """Array of the ten (table, masked bits) keys of a fingerprint."""
    return F.array(*(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(_masks())))


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.uint64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, c]).view(np.int64)) for c in (0, 1)], schema=_LINKS)


def compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group (t, bits, p, q) with fp; a spanning forest of the links within each group."""
    group, parts, small, held = None, [], [], 0
    found: list[tuple[int, int]] = []

    def close() -> None:
        nonlocal held
        own = np.unique(np.concatenate(parts))
        if len(own) > B.LANES:
            found.extend(B.large_group(own))
        elif len(own) > 1:
            small.append(own)
            held += len(own)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[c].to_numpy() for c in ("t", "bits", "p", "q")], 1).astype(np.int64)
        fps = batch["fp"].to_numpy().view(np.uint64)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if (key := tuple(keys[lo])) != group:
                if parts:
                    close()
                group, parts = key, []
            parts.append(fps[lo:hi])
        if held > TOGETHER:
            found += B.small_groups(small)
            small, held = [], 0
        if found:
            yield _links(found)
            found.clear()
    if parts:
        close()
    found += B.small_groups(small)
    if found:
        yield _links(found)


def fingerprint_links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links u, v that join all fingerprints (column fp, distinct) within the radius into their components."""
    keyed = distinct.select("fp", F.explode(bucket_keys(F.col("fp"))).alias("k")).select("fp", "k.t", "k.bits")
    sizes = keyed.groupBy("t", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select(F.col("t").alias("of_t"), F.bitwise_not("bits").alias("not_bits"), F.ceil(F.col("n") / bucket).cast("int").alias("cuts"))
    met = keyed.join(sizes, (F.col("t") == F.col("of_t")) & (F.bitwise_not("bits") == F.col("not_bits"))).withColumn("part", F.pmod(F.xxhash64("fp"), "cuts").cast("int"))
    pairs = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select("t", "bits", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "fp")
    group = ["t", "bits", "p", "q"]
    return pairs.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare_groups, "u long, v long")


def components_of(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """fp, component_id for each distinct fingerprint of rows (doc_id, fp) that two rows share or that is linked."""
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")))
    roots = connected_components(fingerprint_links(distinct.select("fp"), bucket))
    rooted = distinct.join(roots.select(F.col("node"), "root"), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted.select("fp", "root", "least_id", "n"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1")
    least = least.select(F.bitwise_not("root").alias("not_root"), "component_id")
    return rooted.join(least, F.bitwise_not("root") == F.col("not_root")).select("fp", "component_id")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp (signed long) and component_id of every document."""
    small_batches(documents.sparkSession)
    rows = materialise(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(fingerprints(shingle), "doc_id long, fp long"))
    of_fp = materialise(components_of(rows, bucket)).select(F.col("fp").alias("of_fp"), "component_id")
    return rows.join(of_fp, F.col("fp") == F.col("of_fp"), "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, fps, keys = [], [], []
        for i, j, a, offsets in K.runs(batch["text"]):
            raw = a.tobytes()
            for r in range(j - i):
                hashes = shingle_hashes(raw[offsets[r] : offsets[r + 1]], COPY_SHINGLE)
                own = np.unique(hashes)
                sets.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                fps.append(majority(hashes))
                keys.append(N.bands(own))
        columns = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sets, fps)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_key"], *columns, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "row_key", "set", "fp", "keys"])


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, a, offsets in K.runs(batch["text"]):
            raw = a.tobytes()
            sets = [np.unique(shingle_hashes(raw[offsets[r] : offsets[r + 1]], COPY_SHINGLE)).tobytes() for r in range(j - i)]
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*(part[c] for c in ("root", "cuts", "set", "keys")), pa.array(sets, pa.binary())], ["root", "cuts", "set", "keys", "shingles"])


def _star(rows: DataFrame, key: str) -> DataFrame:
    """Links u, v from each set of a group to its least; linear in the rows however large a group is."""
    least = rows.groupBy(key).agg(F.min("set").alias("v"), F.max("set").alias("most")).where("v <> most").select(F.bitwise_not(key).alias("not_key"), "v")
    return rows.join(least, F.bitwise_not(key) == F.col("not_key")).where("set <> v").select(F.col("set").alias("u"), "v")


def copies(documents: DataFrame, part: int = N.PART) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, row_key, set) of all documents, and set, root for each set whose component's least set is another one.

    Sets of five-word shingles that are proposed by equal MinHash bands or by
    fingerprints within the radius form groups; in a group, sets that share a band, a
    fingerprint or a link are compared exactly, and linked at similarity 0.8 or more.
    """
    small_batches(documents.sparkSession)
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_key"), "text")
    rows = materialise(keyed.mapInArrow(_described, "doc_id long, row_key long, set long, fp long, keys array<long>"))
    sets = materialise(rows.groupBy("set").agg(F.first("row_key").alias("row_key"), F.first("fp").alias("fp"), F.first("keys").alias("keys")).where("size(keys) > 0"))
    linked = materialise(fingerprint_links(sets.select("fp").distinct()))
    # A key of the link itself goes to both of its fingerprints, so that their sets are compared.
    ends = linked.select(F.explode(F.array("u", "v")).alias("of_fp"), F.xxhash64("u", "v").alias("key"))
    by_link = sets.select("set", "fp").join(ends, F.col("fp") == F.col("of_fp")).select("key", "set")
    by_key = materialise(sets.select(F.explode(F.concat("keys", F.array(F.xxhash64("fp")))).alias("key"), "set").unionByName(by_link))
    groups = materialise(connected_components(materialise(_star(by_key, "key").distinct())))
    if groups.isEmpty():
        return rows, groups.select(F.col("node").alias("set"), "root")
    member = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    of_set = by_link.groupBy("set").agg(F.collect_set("key").alias("more")).select(F.bitwise_not("set").alias("not_set"), "more")
    proposed = sets.join(member, F.col("set") == F.col("node")).select("set", "row_key", "root", F.concat("keys", F.array(F.xxhash64("fp"))).alias("keys"))
    proposed = proposed.join(of_set, F.bitwise_not("set") == F.col("not_set"), "left").withColumn("keys", F.concat("keys", F.coalesce("more", F.array().cast("array<long>"))))
    proposed = materialise(proposed.select("set", F.col("row_key").alias("of_row"), "root", "keys"))
    texts = keyed.join(proposed, F.col("row_key") == F.col("of_row")).dropDuplicates(["row_key"])
    # A text has at most half as many words as characters.
    weights = texts.select("root", F.length("text").alias("n")).groupBy("root").agg(F.ceil(F.sum("n") / 2 / part).cast("int").alias("cuts"))
    weights = weights.select(F.bitwise_not("root").alias("not_root"), F.greatest("cuts", F.lit(1)).alias("cuts"))
    texts = texts.join(weights, F.bitwise_not("root") == F.col("not_root")).select("root", "cuts", "set", "keys", "text")
    held = materialise(texts.mapInArrow(_with_shingles, "root long, cuts int, set long, keys array<long>, shingles binary"))
    held = held.withColumn("part", F.pmod(F.xxhash64("set"), "cuts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    group = ["root", "p", "q"]
    held = held.select("root", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "set", "keys", "shingles")
    links = held.repartition(*group).sortWithinPartitions(*group).mapInArrow(N.compare, "u long, v long")
    return rows, connected_components(links).select(F.col("node").alias("set"), "root")


def one_of_each(documents: DataFrame, part: int = N.PART) -> DataFrame:
    """The documents, one row of each component of near copies. Columns are unchanged.

    Near copies share four fifths of their five-word shingles. Texts without words are
    copies of each other. The row with the least doc_id stays (null comes last), of
    several the one with the least hash of id and text: rows are known by both, so ids
    may repeat or be null.
    """
    rows, roots = copies(documents, part)
    roots = roots.select(F.bitwise_not("set").alias("not_set"), "root")
    rooted = rows.join(roots, F.bitwise_not("set") == F.col("not_set"), "left").select("doc_id", "row_key", F.coalesce("root", "set").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    names = documents.columns
    # The added key is under a name of its own, whatever the documents' are.
    key = "_" * (1 + max(map(len, names)))
    stay = materialise(rooted.groupBy("root").agg(first.alias("first")).select(F.col("first.row_key").alias(key)))
    keyed = documents.withColumn(f"{key}k", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    return keyed.join(stay, F.col(f"{key}k") == F.col(key), "left_semi").dropDuplicates([f"{key}k"]).select(*names)
