"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items form one automaton. Document tokens stream through it while
the longest match is tracked; where it reaches ``WINDOW`` tokens, or a whole item
that is shorter, the matched words are hit and the automaton's state tells the items. Only
stretches of tokens that all occur in the items, and are long enough for a window, are
streamed; numpy finds them.

No shuffle takes place. Automata go to the executors as broadcasts of bounded size: at most
``BLOCK_WORDS`` item words each, about 100 bytes a word. A larger benchmark has several. Then one
pass over the documents finds those that hold the hash of some window (8 bytes a
benchmark word in each worker), and these alone, a table of their own, meet the automata one after
another; hits of all blocks are merged before anything is judged or cut, so that
the size of the blocks doesn't show.

Defined results: A-Z are lower-cased; words are runs of a-z, 0-9 and non-ASCII bytes;
null or empty texts have no words, no hits and are clean; items without words (null
included) never occur; equal item ids count once; repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernel as K
from tessera.llm.common import materialise, small_batches
from tessera.llm.suffix_automaton import SuffixAutomaton

WINDOW = 13
#: Least percentage of a document's words that must be hit to make it contaminated.
COVERAGE = 5
#: Words of the items in one automaton, more only for a single longer item; about 1 KB a word where it is built, 100 bytes where it is used.
BLOCK_WORDS = 200_000

#: Bytes that end a word: ASCII but digits and letters (upper case goes to lower first).
BREAKS = np.ones(256, bool)
BREAKS[48:58] = BREAKS[97:123] = BREAKS[128:] = False


class Matcher:
    """The automaton of some items with what is needed to stream documents through it."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str] = []
        sequences: list[list[int]] = []
        for item, text in items:
            tokens = tokens_of(text)
            if tokens:
                self.items.append(str(item))
                sequences.append([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in tokens])
        automaton = SuffixAutomaton()
        for s in sequences:
            automaton.add(s)
        self.automaton = automaton.packed(sequences, window)
        self.window = window
        self.shortest = min([window, *self.automaton.windows])
        known = list(self.vocabulary)
        at = np.cumsum([0, *map(len, known)])
        hashes = K.word_hash(np.frombuffer(b"".join(known), np.uint8), at[:-1], at[1:]) if known else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        own = [hashes[np.array(s)] for s in sequences]
        self.windows = {n: np.unique(np.concatenate([grams(h, n) for h in own if min(window, len(h)) == n])) for n in self.automaton.windows}

    def token_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words in the items' vocabulary, -1 for others. A hash only proposes an id; its bytes decide where stretches are streamed."""
        if not len(self.hashes) or not len(hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)

    def stream(self, tokens: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (half-open, may overlap) and the items with occurring windows."""
        sa, spans, found = self.automaton, [], set()
        state = matched = 0
        for i, token in enumerate(tokens):
            state, matched = sa.step(state, matched, token) if token >= 0 else (0, 0)
            if matched >= self.shortest:
                for n, items in sa.found(state, matched):
                    spans.append((i + 1 - n, i + 1))
                    found.update(items)
        return spans, found


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words."""
    out = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(out)]
    return K.mix(out)


def tokens_of(text: str | None) -> list[bytes]:
    a = np.frombuffer((text or "").encode().translate(K.LOWER), np.uint8)
    starts, ends, _ = K.words(a, np.array([0, len(a)]), BREAKS)
    raw = a.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def _stretches(known: np.ndarray, row: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Spans of at least so many consecutive known words of one row."""
    edge = np.ones(len(known) + 1, bool)
    edge[1:-1] = (known[1:] != known[:-1]) | (row[1:] != row[:-1])
    cuts = np.flatnonzero(edge)
    keep = known[cuts[:-1]] & (np.diff(cuts) >= shortest) if len(known) else np.zeros(0, bool)
    return list(zip(cuts[:-1][keep].tolist(), cuts[1:][keep].tolist(), strict=True))


def matches(batch_text: pa.Array, matcher: Matcher) -> Iterator[tuple[int, np.ndarray, list[list[tuple[int, int]]], list[set[int]], np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of rows: first row, words per row, merged hit spans (in words of the row) and items per row, byte starts and ends, first words."""
    for i, j, a, offsets in K.runs(batch_text):
        low = K.LOWER_ARRAY[a]
        starts, ends, first = K.words(low, offsets, BREAKS)
        n = np.diff(first)
        row = np.repeat(np.arange(j - i), n)
        raw = low.tobytes()
        ids = matcher.token_ids(K.word_hash(low, starts, ends))
        hits: list[list[tuple[int, int]]] = [[] for _ in range(j - i)]
        items: list[set[int]] = [set() for _ in range(j - i)]
        for lo, hi in _stretches(ids >= 0, row, matcher.shortest):
            tokens = [matcher.vocabulary.get(raw[s:e], -1) for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
            spans, found = matcher.stream(tokens)
            if spans:
                r = int(row[lo])
                items[r] |= found
                hits[r] += [(s + lo - int(first[r]), e + lo - int(first[r])) for s, e in spans]
        yield i, n, [merged(h) for h in hits], items, starts, ends, first


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of bounded size, one at a time: one, unless the benchmark is larger than the bound."""
    items = benchmark.select("item_id", "text").distinct()
    size = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    cuts = max(1, -(-int(size) // block_words))
    for k in range(cuts):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(cuts)) == k).collect()]


def _broadcast(documents: DataFrame, benchmark: DataFrame, window: int, block_words: int):
    """Broadcasts of the automata, and if there are several of the hashes of all windows by their length."""
    context = documents.sparkSession.sparkContext
    matchers, windows = [], {}
    for items in blocks(benchmark, block_words):
        matcher = Matcher(items, window)
        for n, own in matcher.windows.items():
            windows[n] = np.union1d(windows[n], own) if n in windows else own
        matcher.windows = {}
        matchers.append(context.broadcast(matcher))
    return matchers, context.broadcast(windows) if len(matchers) > 1 else None


def _may_hit(text: pa.Array, windows: dict[int, np.ndarray]) -> np.ndarray:
    """Which rows hold the hash of a window."""
    out = np.zeros(len(text), bool)
    for i, j, a, offsets in K.runs(text):
        low = K.LOWER_ARRAY[a]
        starts, ends, first = K.words(low, offsets, BREAKS)
        hashes = K.word_hash(low, starts, ends)
        row = np.repeat(np.arange(j - i), np.diff(first))
        for n, known in windows.items():
            own = grams(hashes, n)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = np.flatnonzero(known[at] == own)
            hit = hit[row[hit] == row[hit + n - 1]]
            out[i + row[hit]] = True
    return out


def _split(windows, text_at: int, near: bool):
    """The rows that may be hit, or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_may_hit(batch.column(text_at), windows.value) == near))

    return run


_HITS = "n_words long, spans array<struct<lo:int,hi:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _hits(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for _, n, hits, found, *_ in matches(batch["text"], matcher):
                n_words += n.tolist()
                spans += [[{"lo": lo, "hi": hi} for lo, hi in h] for h in hits]
                items += [sorted(matcher.items[k] for k in x) for x in found]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], [*keep, "n_words", "spans", "items"])

    return run


def _digest(items: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items.to_pylist()], pa.string())


def _verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit = [sum(hi - lo for lo, hi in merged([(s["lo"], s["hi"]) for s in x])) for x in batch["spans"].to_pylist()]
        items = [sorted(set(x)) for x in batch["items"].to_pylist()]
        n_words = batch["n_words"].to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["n_words"], pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()), _digest(pa.array(items, pa.list_(pa.string()))), pa.array([h > 0 and 100 * h >= COVERAGE * n for h, n in zip(n_hit, n_words, strict=True)], pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    verdict = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    matchers, windows = _broadcast(documents, benchmark, window, block_words)
    if windows is None:
        return docs.mapInArrow(_hits(matchers[0], ["doc_id"]), f"doc_id long, {_HITS}").mapInArrow(_verdict, verdict)
    near = materialise(docs.mapInArrow(_split(windows, 1, True), docs.schema).withColumn("row_no", F.monotonically_increasing_id()))
    parts = [near.mapInArrow(_hits(m, ["doc_id", "row_no"]), f"doc_id long, row_no long, {_HITS}") for m in matchers]
    whole = reduce(DataFrame.unionByName, parts).groupBy("row_no").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    clean = docs.mapInArrow(_split(windows, 1, False), docs.schema).mapInArrow(_unhit, f"doc_id long, {_HITS}")
    return whole.select("doc_id", "n_words", "spans", "items").unionByName(clean).mapInArrow(_verdict, verdict)


def _unhit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words = [n for _, _, a, offsets in K.runs(batch["text"]) for n in np.diff(K.words(K.LOWER_ARRAY[a], offsets, BREAKS)[2]).tolist()]
        none = [[]] * len(n_words)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(none, _SPANS), pa.array(none, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "items"])


def _cut(raw: bytes, spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> str:
    """The text without the words of the spans; starts and ends are those of its words, from any common base."""
    base, out, at = int(starts[0]) - _lead(raw), [], 0
    for lo, hi in spans:
        out.append(raw[at : int(starts[lo]) - base])
        at = int(ends[hi - 1]) - base
    return b"".join([*out, raw[at:]]).decode()


def _without_hits(hits_of, text_at: int, length_at: int | None, schema: pa.Schema, coverage: int):
    """hits_of gives runs of a batch as matches() does; rows of the schema leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], batch.column(text_at).to_pylist()
            lengths = None if length_at is None else batch.column(length_at).to_pylist()
            for i, n, hits, _, starts, ends, first in hits_of(batch):
                for r, spans in enumerate(hits):
                    hit = sum(hi - lo for lo, hi in spans)
                    keep.append(not hit or 100 * hit < coverage * int(n[r]))
                    if hit and keep[-1]:
                        texts[i + r] = _cut(texts[i + r].encode(), spans, starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]])
                        if lengths is not None:
                            lengths[i + r] = len(texts[i + r])
            arrays = list(batch.columns)[: len(schema)]
            arrays[text_at] = pa.array(texts, schema.field(text_at).type)
            if lengths is not None:
                arrays[length_at] = pa.array(lengths, schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=schema).filter(pa.array(keep, pa.bool_()))

    return run


def _held_hits(batch: pa.RecordBatch) -> Iterator[tuple]:
    """As matches(), with the spans of all blocks that the last column holds."""
    held = batch.column(batch.num_columns - 1).to_pylist()
    text = batch.column(batch.schema.names.index("text"))
    for i, j, a, offsets in K.runs(text):
        starts, ends, first = K.words(K.LOWER_ARRAY[a], offsets, BREAKS)
        hits = [merged([(s["lo"], s["hi"]) for s in x or []]) for x in held[i:j]]
        yield i, np.diff(first), hits, None, starts, ends, first


def _lead(raw: bytes) -> int:
    """Bytes before the first word."""
    inside = ~BREAKS[np.frombuffer(raw.translate(K.LOWER), np.uint8)]
    return int(np.argmax(inside))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without benchmark passages; columns unchanged.

    A document whose hit words reach the coverage limit goes; from others the hit
    spans go (they exceed the length limit), and n_chars, if there, follows the text.
    """
    small_batches(documents.sparkSession)
    types = {f.name: f.dataType for f in documents.schema.fields}
    schema = pa.schema([(f.name, _arrow_type(f.dataType)) for f in documents.schema.fields])
    names = list(types)
    same = T.StructType([T.StructField(f.name, f.dataType) for f in documents.schema.fields])
    at = names.index("text"), names.index("n_chars") if "n_chars" in types else None
    matchers, windows = _broadcast(documents, benchmark, window, block_words)
    if windows is None:
        return documents.mapInArrow(_without_hits(lambda batch: matches(batch.column(at[0]), matchers[0].value), *at, schema, coverage), same)
    # Each block is matched against the original text; all spans are judged and cut at once. The
    # added columns stand last and under names of their own, whatever the documents' are.
    key = "_" * (1 + max(map(len, names)))
    near = materialise(documents.mapInArrow(_split(windows, at[0], True), same).withColumn(key, F.monotonically_increasing_id()))
    texts = near.select(F.col(key).alias("row_no"), "text")
    parts = [texts.mapInArrow(_hits(m, ["row_no"]), f"row_no long, {_HITS}").where("size(spans) > 0").select("row_no", "spans") for m in matchers]
    every = reduce(DataFrame.unionByName, parts).groupBy("row_no").agg(F.flatten(F.collect_list("spans")).alias(f"{key}s")).withColumnRenamed("row_no", f"{key}k")
    hit = near.join(every, F.col(key) == F.col(f"{key}k"), "left").select(*names, f"{key}s")
    clean = documents.mapInArrow(_split(windows, at[0], False), same)
    return hit.mapInArrow(_without_hits(_held_hits, *at, schema, coverage), same).unionByName(clean)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
