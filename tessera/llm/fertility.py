"""Quality rules by tokeniser fertility.

Public vocabularies (byte-level BPE ranks, read from a folder that is a parameter) measure
each whole text that passes the base rules: characters per token, share of tokens that are no
whole characters (the fallback to bytes), and the entropy of its tokens, as a share of the most
that so many tokens can have, taken in blocks of ``BLOCK`` tokens and averaged. A document is kept if each
vocabulary finds it inside the bands of its language: characters per token around the
language's median, byte share not far above its median, relative entropy not below a floor.
Medians are exact ones over all documents that pass the base, of values rounded to three
digits, so that the groupBy holds a bounded number of them and reruns agree. The base rules reject
texts that are short or repeat themselves.

Long texts go to the tokenisers in pieces that end where their pattern always splits, which
changes no token; runs of white space that the pattern matcher can't take are encoded as the single
piece that they are.

Defined results: null text has no words and fails the base; a text that fails the base has no
measures (null) and is not kept; a null language is a language of its
own; a language is measured against its own documents alone, however few; repeated rows are judged
alike; an empty table gives no rows. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import ast
import base64
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.common import materialise, small_batches

FOLDER = "/opt/tokenizers"
VOCABULARIES = ("byte_bpe_multi_50k", "byte_bpe_50k")
#: Characters per token, as factors of the language's median.
PER_TOKEN = (0.82, 1.3)
#: Byte share beyond the language's median.
BYTE_SHARE = 0.1
#: Least relative entropy, and the tokens of a block.
ENTROPY = 0.65
BLOCK = 512
LEAST_WORDS = 50
REPEATED = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
#: Characters that go to a tokeniser at a time, about, and the white space of its pattern in runs that it can't match.
PIECE = 1 << 16
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def read_vocabulary(folder: str, name: str) -> tuple[str, dict[bytes, int]]:
    """Pattern and ranks of a byte-level vocabulary, read on the driver. The pattern is the text that the folder's __init__.py gives PATTERN; nothing of it is run."""
    with open(f"{folder}/__init__.py") as file:
        tree = ast.parse(file.read())
    pattern = next(ast.literal_eval(x.value) for x in tree.body if isinstance(x, ast.Assign) and x.targets[0].id == "PATTERN")
    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        return pattern, {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[str, bool]]:
    """The text in pieces, each with whether it is a single piece of white space. A piece ends before white space that follows something else, where the pattern always splits."""
    at = 0
    while at < len(text):
        gap = _GAP.match(text, at)
        if gap:
            # All but the last character of the run, which the pattern leaves to what follows.
            end = gap.end() if gap.end() == len(text) else gap.end() - 1
            yield text[at:end], True
            at = end
            continue
        cut = _CUT.search(text, at + size)
        end = cut.start() if cut else len(text)
        gap = _GAP.search(text, at, end)
        # A run at the start of which nothing else stands is taken above.
        end = gap.start() if gap and gap.start() > at else end
        yield text[at:end], False
        at = end


def relative_entropy(tokens: np.ndarray, block: int = BLOCK) -> float:
    """Entropy over its greatest value for so many tokens, averaged over near equal blocks by their tokens."""
    n = len(tokens)
    blocks = -(-n // block)
    of = np.arange(n) * blocks // n
    pairs, times = np.unique(of.astype(np.int64) << 32 | tokens, return_counts=True)
    sizes = np.bincount(of, minlength=blocks)
    own = sizes[pairs >> 32]
    bits = np.bincount(pairs >> 32, times / own * np.log2(own / times), blocks)
    return float((bits / np.log2(np.maximum(sizes, 2)) * sizes).sum() / n)


class Meter:
    """Measures texts by one vocabulary."""

    def __init__(self, name: str, pattern: str, ranks: dict[bytes, int]) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.partial = np.zeros(max(ranks.values()) + 1, bool)
        for token, rank in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.partial[rank] = True

    def tokens(self, text: str) -> np.ndarray:
        if len(text) <= PIECE and not _GAP.search(text):
            return np.array(self.encoding.encode_ordinary(text), np.int64)
        parts = [np.array(self.encoding._encode_single_piece(part) if single else self.encoding.encode_ordinary(part), np.uint32) for part, single in pieces(text)]
        return np.concatenate(parts).astype(np.int64)

    def __call__(self, text: str) -> tuple[float, float, float]:
        """Characters per token, share of byte tokens, relative entropy; zeros without tokens."""
        if not text:
            return 0.0, 0.0, 0.0
        tokens = self.tokens(text)
        return len(text) / len(tokens), float(np.count_nonzero(self.partial[tokens]) / len(tokens)), relative_entropy(tokens)


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.int64)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        out[filled] = np.add.reduceat(flags, offsets[filled], dtype=np.int64)
    return out


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    _, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[inverse] > 1


def base_counts(a: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base measures of a run of texts."""
    rows = len(offsets) - 1
    starts, ends, first = K.words(a, offsets)
    n = np.diff(first)
    inside = ~K.SPACE[a]
    out = {"n_words": n, "word_chars": _per_row(inside & ((a & 0xC0) != 0x80), offsets), "n_symbols": _per_row(_SYMBOL[a], offsets)}
    l_starts, l_ends, l_first = K.words(a, offsets, _LINE)
    worded = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)
    row = np.repeat(np.arange(rows), np.diff(l_first))[worded]
    salt = np.arange(rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    lines = K.mix(K.word_hash(a, l_starts[worded], l_ends[worded]) + salt[row])
    distinct = np.unique(lines, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(row, minlength=rows) - np.bincount(row[distinct], minlength=rows)
    hashes = K.word_hash(a, starts, ends)
    covered = np.zeros(len(hashes), bool)
    row = np.repeat(np.arange(rows), n)
    at = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    if len(at):
        grams = (hashes[at] * np.uint64(3) + hashes[at + 1]) * np.uint64(0xD6E8FEB86659FD93) + hashes[at + 2]
        twice = at[_repeats(K.mix(grams + salt[row[at]]))]
        for k in range(3):
            covered[twice + k] = True
    out["n_repeat_words"] = _per_row(covered, first)
    return out


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > REPEATED * n_words)


_MEASURES = ("per_token", "byte_share", "entropy")


def measures(documents: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES, folder: str = FOLDER) -> DataFrame:
    """doc_id, lang, the base counts, base_failed and per vocabulary k: per_token_k, byte_share_k, entropy_k (null if the base fails)."""
    spark: SparkSession = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast([(name, *read_vocabulary(folder, name)) for name in vocabularies])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meters = [Meter(*v) for v in shared.value]
        for batch in batches:
            counts = [base_counts(a, offsets) for _, _, a, offsets in K.runs(batch["text"])]
            columns = {name: np.concatenate([c[name] for c in counts]).astype(np.int64) if counts else np.zeros(0, np.int64) for name in _BASE}
            failed = base_failed(columns["n_words"], columns["n_repeat_words"])
            columns["base_failed"] = failed
            for k, meter in enumerate(meters):
                found = np.array([(0.0, 0.0, 0.0) if f else meter(t.as_py()) for t, f in zip(batch["text"], failed, strict=True)]).reshape(-1, 3)
                columns |= {f"{name}_{k}": pa.array(np.ascontiguousarray(found[:, i]), mask=failed) for i, name in enumerate(_MEASURES)}
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], *(x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values())], ["doc_id", "lang", *columns])

    fields = [f"{n} long" for n in _BASE] + ["base_failed boolean"] + [f"{n}_{k} double" for k in range(len(vocabularies)) for n in _MEASURES]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, f"doc_id long, lang string, {', '.join(fields)}")


def judge(documents: DataFrame, vocabularies: tuple[str, ...] = VOCABULARIES, folder: str = FOLDER) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the measures of every document."""
    n = len(vocabularies)
    rows = materialise(measures(documents, vocabularies, folder))
    middle = [F.percentile(F.round(f"{name}_{k}", 3), 0.5).alias(f"mid_{name}_{k}") for k in range(n) for name in ("per_token", "byte_share")]
    own = rows.where("not base_failed").groupBy("lang").agg(*middle).withColumnRenamed("lang", "of_lang")
    banded = rows.join(own, F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    bands = []
    for k in range(n):
        mid, share = F.col(f"mid_per_token_{k}"), F.col(f"mid_byte_share_{k}")
        bands += [F.col(f"per_token_{k}").between(PER_TOKEN[0] * mid, PER_TOKEN[1] * mid), F.col(f"byte_share_{k}") <= share + BYTE_SHARE, F.col(f"entropy_{k}") >= ENTROPY]
    inside = reduce(lambda a, b: a & b, bands)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(False)))
    return banded.select("doc_id", *_BASE, "base_failed", kept.alias("kept"), *(f"{name}_{k}" for k in range(n) for name in _MEASURES))
