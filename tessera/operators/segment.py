"""Word segmentation of CJK text: dictionary matching, HMM, bigram and linear-chain models, and their evaluation.

Decoders are sequential, so they run as Arrow functions over batches; training counts
and evaluation are DataFrame aggregations.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import CJK, align_form, bies_tags, decode_tokens

STATES = "BIES"
_LOW = -1e100
_HAN = re.compile(f"[{CJK}]+")
_BLOCK = re.compile(f"([{CJK}]+)")

Segmenter = Callable[[str], list[str]]


def dictionary(gold: DataFrame, column: str = "gold") -> DataFrame:
    """word: the distinct words of gold lines without numbers."""
    return gold.select(F.explode(decode_tokens(F.col(column))).alias("word")).where(~F.col("word").rlike(r"^[0-9]+(\.[0-9]+)?%?$")).distinct()


def forward(text: str, words: set[str], longest: int) -> list[str]:
    out, i = [], 0
    while i < len(text):
        n = next((n for n in range(min(longest, len(text) - i), 1, -1) if text[i : i + n] in words), 1)
        out.append(text[i : i + n])
        i += n
    return out


def backward(text: str, words: set[str], longest: int) -> list[str]:
    out, j = [], len(text)
    while j:
        n = next((n for n in range(min(longest, j), 1, -1) if text[j - n : j] in words), 1)
        out.append(text[j - n : j])
        j -= n
    return out[::-1]


def bidirectional(text: str, words: set[str], longest: int) -> list[str]:
    """Fewer words, then fewer single characters, then the backward result."""
    f, b = forward(text, words, longest), backward(text, words, longest)
    cost = lambda x: (len(x), sum(len(w) == 1 for w in x))
    return f if cost(f) < cost(b) else b


def fewest(text: str, words: set[str], longest: int) -> list[str]:
    """Fewest words; of equal splits the one whose last cut lies first."""
    best, cut = [0] * (len(text) + 1), [0] * (len(text) + 1)
    for j in range(1, len(text) + 1):
        best[j] = len(text) + 1
        for i in range(max(0, j - max(longest, 1)), j):
            if (j - i == 1 or text[i:j] in words) and best[i] + 1 < best[j]:
                best[j], cut[j] = best[i] + 1, i
    return _cut_back(text, cut)


def _cut_back(text: str, cut: list[int]) -> list[str]:
    out, j = [], len(text)
    while j > 0:
        out.append(text[cut[j] : j])
        j = cut[j]
    return out[::-1]


def words_of_tags(text: str, tags: str | list[str]) -> list[str]:
    """A word ends with each E or S; what is left at the end is a word too."""
    out, start = [], 0
    for i, t in enumerate(tags):
        if t in "ES":
            out.append(text[start : i + 1])
            start = i + 1
    return out + ([text[start:]] if start < len(text) else [])


# Training counts as aggregations


def gold_words(gold: DataFrame, column: str = "gold") -> DataFrame:
    """line, pos, word of the CJK words of gold lines (line_no, gold)."""
    words = F.filter(decode_tokens(F.col(column)), lambda w: w.rlike(f"^[{CJK}]+$"))
    return gold.select(F.col("line_no").alias("line"), F.posexplode(words).alias("pos", "word"))


def tag_counts(gold: DataFrame, column: str = "gold") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, n) of line starts, (state, next, n) transitions, (state, char, n) emissions."""
    words = F.filter(decode_tokens(F.col(column)), lambda w: w.rlike(f"^[{CJK}]+$"))
    chars = gold.select(F.col("line_no").alias("line"), F.arrays_zip(F.filter(F.split(F.array_join(words, ""), ""), lambda c: c != "").alias("char"), bies_tags(words).alias("state")).alias("z"))
    rows = chars.select("line", F.posexplode("z").alias("pos", "x")).select("line", "pos", F.col("x.char").alias("char"), F.col("x.state").alias("state"))
    before = F.lag("state").over(W.partitionBy("line").orderBy("pos"))
    starts = rows.where("pos = 0").groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    moves = rows.withColumn("before", before).where("before is not null").groupBy(F.col("before").alias("state"), F.col("state").alias("next")).agg(F.count(F.lit(1)).alias("n"))
    return starts, moves, rows.groupBy("state", "char").agg(F.count(F.lit(1)).alias("n"))


class Hmm:
    """Viterbi over maximum likelihood counts; a text ends with E or S."""

    def __init__(self, starts: DataFrame, moves: DataFrame, emissions: DataFrame) -> None:
        a, b, c = starts.collect(), moves.collect(), emissions.collect()  # bounded by states and characters
        seen = {s: sum(r.n for r in c if r.state == s) for s in STATES}
        total = sum(r.n for r in a)
        self.start = {s: -math.inf for s in STATES} | {r.state: math.log(r.n / total) for r in a}
        self.move = {(s, t): -math.inf for s in STATES for t in STATES} | {(r.state, r.next): math.log(r.n / seen[r.state]) for r in b}
        self.emit = {(r.state, r.char): math.log(r.n / seen[r.state]) for r in c}

    def __call__(self, text: str) -> list[str]:
        if not text:
            return []
        v = {s: self.start[s] + self.emit.get((s, text[0]), _LOW) for s in STATES}
        back = []
        for ch in text[1:]:
            step = {t: max((v[s] + self.move[s, t], s) for s in STATES) for t in STATES}
            back.append({t: step[t][1] for t in STATES})
            v = {t: step[t][0] + self.emit.get((t, ch), _LOW) for t in STATES}
        tags = [max((v[s], s) for s in "ES")[1]]
        for b in reversed(back):
            tags.append(b[tags[-1]])
        return words_of_tags(text, tags[::-1])


class Bigram:
    """Best path over known words and single characters under add-one bigrams."""

    def __init__(self, words: DataFrame, longest: int = 10) -> None:
        from tessera.operators.ranking import adjacent_pairs

        self.one = {r.word: r.n for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a training vocabulary
        self.two = {(r.left, r.right): r.n for r in adjacent_pairs(words).collect()}
        self.longest = longest

    def _cost(self, a: str, b: str) -> float:
        return math.log((self.two.get((a, b), 0) + 1) / (self.one.get(a, 0) + max(len(self.one), 1)))

    def __call__(self, text: str) -> list[str]:
        best, cut, last = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1), ["<S>"] + [""] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - self.longest), j):
                w = text[i:j]
                if (j - i == 1 or w in self.one) and (p := best[i] + self._cost(last[i], w)) > best[j]:
                    best[j], cut[j], last[j] = p, i, w
        return _cut_back(text, cut)


class Chain:
    """Linear-chain tagger on characters around each place, trained as an averaged structured perceptron.

    It stands in for a conditional random field (no such library is here): the same features and
    decoding, another training rule, so results are alike and not equal.
    """

    def __init__(self, lines: list[list[str]], rounds: int = 8) -> None:
        self.w: dict[tuple, np.ndarray] = {}
        self.t = np.zeros((4, 4))
        total: dict[tuple, np.ndarray] = {}
        total_t, step = np.zeros((4, 4)), 0
        data = []
        for words in lines:
            text = "".join(words)
            tags = [STATES.index(c) for w in words for c in ("S" if len(w) == 1 else "B" + "I" * (len(w) - 2) + "E")]
            if text:
                data.append((self._features(text), tags))
        for _ in range(rounds):
            for features, gold in data:
                step += 1
                guess = self._decode(features)
                if guess == gold:
                    continue
                for i, (g, x) in enumerate(zip(gold, guess, strict=True)):
                    if g != x:
                        for f in features[i]:
                            for y, d in ((g, 1.0), (x, -1.0)):
                                self.w.setdefault(f, np.zeros(4))[y] += d
                                total.setdefault(f, np.zeros(4))[y] += d * step
                    if i:
                        for path, d in ((gold, 1.0), (guess, -1.0)):
                            self.t[path[i - 1], path[i]] += d
                            total_t[path[i - 1], path[i]] += d * step
        if step:
            self.w = {f: v - total[f] / (step + 1) for f, v in self.w.items()}
            self.t -= total_t / (step + 1)

    @staticmethod
    def _features(text: str) -> list[list[tuple]]:
        t = f"\x02{text}\x03"
        return [[(0, t[i]), (1, t[i - 1]), (2, t[i + 1]), (3, t[i - 1 : i + 1]), (4, t[i : i + 2])] for i in range(1, len(t) - 1)]

    def _decode(self, features: list[list[tuple]]) -> list[int]:
        zero = np.zeros(4)
        v, back = None, []
        for fs in features:
            e = sum((self.w.get(f, zero) for f in fs), zero)
            if v is None:
                v = e + np.array([0.0, -1e9, -1e9, 0.0])
            else:
                m = v[:, None] + self.t
                back.append(m.argmax(0))
                v = m.max(0) + e
        if v is None:
            return []
        out = [int(np.argmax(v + np.array([-1e9, -1e9, 0.0, 0.0])))]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def __call__(self, text: str) -> list[str]:
        return words_of_tags(text, [STATES[k] for k in self._decode(self._features(text))])


def segment_line(line: str, segmenter: Segmenter) -> list[str]:
    """CJK blocks are segmented; what is between them passes whole."""
    return [w for b in _BLOCK.split(line) if b for w in (segmenter(b) if _HAN.fullmatch(b) else [b])]


def by_dictionary(method: Callable[[str, set[str], int], list[str]], words: set[str]) -> Segmenter:
    longest = max(map(len, words), default=1)
    return lambda text: method(text, words, longest)


def segment(df: DataFrame, columns: dict[str, str], segmenter: Segmenter) -> DataFrame:
    """Adds token arrays: column -> name of its tokens. Null text has no tokens."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: segment_line(t, segmenter) if t else [])

    for column, name in columns.items():
        df = df.withColumn(name, run(F.col(column)))
    return df


def _intervals(words: Column) -> Column:
    """Array of (begin, end) of the words, from 1."""
    ends = F.aggregate(words, F.array().cast("array<int>"), lambda a, w: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(w))))
    return F.transform(F.arrays_zip(words.alias("w"), ends.alias("e")), lambda x: F.struct((x["e"] - F.length(x["w"]) + 1).alias("b"), x["e"].alias("e")))


def per_line(lines: DataFrame) -> DataFrame:
    """Adds aligned, p, r, f1, tags_equal, n_tags, tags_right to rows with gold and test (joined by /)."""
    g, t = (decode_tokens(F.regexp_replace(c, r"[\s 　]", "")) for c in ("gold", "test"))
    rows = lines.withColumn("aligned", align_form(F.col("gold")) == align_form(F.col("test"))).withColumn("gw", g).withColumn("tw", t)
    rows = rows.withColumn("gi", _intervals(F.col("gw"))).withColumn("ti", _intervals(F.col("tw"))).withColumn("gt", bies_tags(F.col("gw"))).withColumn("tt", bies_tags(F.col("tw")))
    hit = F.size(F.array_intersect("gi", "ti"))
    p = F.when(F.size("ti") > 0, hit / F.greatest(F.size("ti"), F.lit(1))).otherwise(0.0)
    r = F.when(F.size("gi") > 0, hit / F.greatest(F.size("gi"), F.lit(1))).otherwise(0.0)
    same = F.size("gt") == F.size("tt")
    right = F.size(F.filter(F.arrays_zip("gt", "tt"), lambda x: x["gt"] == x["tt"]))
    out = rows.withColumn("p", p).withColumn("r", r).withColumn("f1", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    return out.select(*lines.columns, "aligned", "p", "r", "f1", (F.col("gt") == F.col("tt")).alias("tags_equal"), F.when(same, F.size("gt")).otherwise(0).alias("n_tags"), F.when(same, right).otherwise(0).alias("tags_right"), same.alias("comparable"))


def evaluate(lines: DataFrame, by: str = "method") -> DataFrame:
    """Per method: aligned, macro p, r, f1 (%), classic f1 of the averages, exact-line and tag accuracy over comparable lines."""
    pct = lambda x: F.round(F.round(100 * x, 8), 2)  # noqa: E731  (twice, so that the order of a sum does not decide a tie)
    rows = per_line(lines).groupBy(by).agg(
        F.bool_and("aligned").alias("aligned"), F.avg("p").alias("p"), F.avg("r").alias("r"), F.avg("f1").alias("f1"), F.count_if(F.col("comparable")).alias("n"), F.count_if(F.col("tags_equal")).alias("exact"), F.sum("n_tags").alias("tags"), F.sum("tags_right").alias("right")
    )
    classic = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    share = lambda a, b: F.when(F.col(b) > 0, pct(F.col(a) / F.greatest(F.col(b), F.lit(1)))).otherwise(0.0)
    return rows.select(by, "aligned", pct(F.col("p")).alias("p_macro"), pct(F.col("r")).alias("r_macro"), pct(F.col("f1")).alias("f1_macro"), pct(classic).alias("f1_classic"), share("exact", "n").alias("exact_lines"), share("right", "tags").alias("tag_accuracy"))


def best(results: DataFrame, by: str = "method") -> DataFrame:
    """The aligned method of greatest classic F1, ties by name."""
    return results.where("aligned").orderBy(F.desc("f1_classic"), by).limit(1).select(by, "f1_classic")
