"""Factorization machine over hashed terms, as numpy: training on a sample, scoring of any text.

Terms are the words of a chunk of ``CHUNK`` words (A-Z lower-cased) and their prefixes,
hashed to ``BITS`` bits. A chunk's score is linear weights plus pairwise
interactions of factors, so a pair such as insult and group mention can count for
more than its parts. Chunks overlap by half, so that no pair within half a chunk is cut
apart. A document has the score of its highest chunk: a short insult in
a long text is not diluted. Training alternates between choosing the highest
chunk of each positive document and descending on the chosen chunks.

Texts longer than a run are scored piece by piece, with the same chunks as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tessera.llm import kernel as K

BITS = 18
FACTORS = 8
CHUNK = 64
STEP = CHUNK // 2
PREFIXES = (4, 5, 6)
#: Score from which a document counts as positive.
THRESHOLD = 0.7
#: Texts of the sample whose terms are taken together, and pairs whose factors are gathered at a time.
TOGETHER = 32
PAIRS = 1 << 18
#: Documents of the sample that a term must occur in to be a feature.
LEAST_DOCUMENTS = 4

BREAKS = np.ones(256, bool)
BREAKS[48:58] = BREAKS[97:123] = BREAKS[128:] = False
_SALTS = [np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)]


def word_terms(a: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, words) buckets of the words of a run, and the number of words of each row."""
    low = K.LOWER_ARRAY[a]
    starts, ends, first = K.words(low, offsets, BREAKS)
    keys = [K.word_hash(low, starts, ends)]
    keys += [K.mix(K.word_hash(low, starts, np.minimum(ends, starts + p)) ^ salt) for p, salt in zip(PREFIXES, _SALTS, strict=True)]
    return np.stack([(k >> np.uint64(64 - BITS)).astype(np.int32) for k in keys]), np.diff(first)


def in_chunks(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and the second chunk of each word (often two, at the ends one and the same), and the row of each chunk; n: words per row. Every row has a chunk at least."""
    chunks = np.maximum(1, -(-n // STEP) - 1)
    base = np.cumsum(chunks) - chunks
    block = K.concat(n) // STEP
    last = np.repeat(chunks - 1, n)
    at = np.repeat(base, n)
    return at + np.maximum(np.minimum(block, last + 1) - 1, 0), at + np.minimum(block, last), np.repeat(np.arange(len(n)), chunks)


def distinct(buckets: np.ndarray, first: np.ndarray, second: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (chunk, bucket) pairs of the wanted buckets, in order."""
    keep = wanted[buckets]
    both = [np.broadcast_to(chunk, buckets.shape)[keep].astype(np.int64) << BITS | buckets[keep] for chunk in (first, second)]
    pairs = np.unique(np.concatenate(both))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.active = (self.linear != 0) | self.factors.any(1)

    def chunk_scores(self, chunk: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Scores of n chunks from their sorted (chunk, bucket) pairs, so many pairs at a time."""
        total = np.full(n, self.bias)
        sums, squares = np.zeros((n, self.factors.shape[1])), np.zeros(n)
        for k in range(0, len(chunk), PAIRS):
            own, b = chunk[k : k + PAIRS], bucket[k : k + PAIRS]
            lo, hi = int(own[0]), int(own[-1]) + 1
            own = own - lo
            total[lo:hi] += np.bincount(own, self.linear[b], hi - lo)
            for f in range(self.factors.shape[1]):
                v = self.factors[b, f]
                sums[lo:hi, f] += np.bincount(own, v, hi - lo)
                squares[lo:hi] += np.bincount(own, v * v, hi - lo)
        return total + 0.5 * ((sums**2).sum(1) - squares)

    def raw_scores(self, a: np.ndarray, offsets: np.ndarray, run_bytes: int = K.RUN_BYTES) -> np.ndarray:
        if len(offsets) == 2 and len(a) > 2 * run_bytes:
            return np.array([self._long_score(a, run_bytes)])
        buckets, n = word_terms(a, offsets)
        return self._of_words(buckets, n)

    def _of_words(self, buckets: np.ndarray, n: np.ndarray) -> np.ndarray:
        first, second, row = in_chunks(n)
        scores = self.chunk_scores(*distinct(buckets, first, second, self.active), len(row))
        return np.maximum.reduceat(scores, np.searchsorted(row, np.arange(len(n)))) if len(row) else np.zeros(0)

    def _long_score(self, a: np.ndarray, run_bytes: int) -> float:
        """The score of one text, whose words come piece by piece; words of chunks that aren't whole yet are held."""
        best, at, held = -np.inf, 0, None
        while at < len(a):
            end = min(at + run_bytes, len(a))
            while end < len(a) and not BREAKS[K.LOWER_ARRAY[a[end]]]:
                end += 1
            part, _ = word_terms(a[at:end], np.array([0, end - at]))
            held = part if held is None else np.concatenate([held, part], axis=1)
            whole = held.shape[1] // STEP - 1
            if whole > 0:
                best = max(best, float(self._of_words(held[:, : (whole + 1) * STEP], np.array([(whole + 1) * STEP]))[0]))
                held = held[:, whole * STEP :]
            at = end
        if best == -np.inf or held.shape[1] > STEP:
            best = max(best, float(self._of_words(held, np.array([held.shape[1]]))[0]))
        return best

    def scores(self, a: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.raw_scores(a, offsets) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def train(texts: list[bytes], labels: np.ndarray, rounds: int = 4, epochs: int = 6, rate: float = 0.1, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Fits a machine to labelled texts. Without both labels, the score is the constant share of label 1."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    if not len(texts) or labels.min() == labels.max():
        share = float(labels.mean()) if len(texts) else 0.0
        return Machine(0.0, np.zeros(size), np.zeros((size, FACTORS)), 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    seen, positive = np.zeros(size), np.zeros(size)
    for k in range(0, len(texts), TOGETHER):
        part = texts[k : k + TOGETHER]
        buckets, n = word_terms(*joined(part))
        of_doc = np.unique(np.broadcast_to(np.repeat(np.arange(len(part)), n), buckets.shape).astype(np.int64) << BITS | buckets)
        b = of_doc & (size - 1)
        seen += np.bincount(b, minlength=size)
        positive += np.bincount(b, labels[k : k + TOGETHER][of_doc >> BITS], size)
    usable = seen >= LEAST_DOCUMENTS
    n_pos, n_neg = labels.sum(), (1 - labels).sum()
    linear = np.where(usable, np.log((positive + 0.5) / (n_pos + 1)) - np.log((seen - positive + 0.5) / (n_neg + 1)), 0.0)
    # A term that says little starts at nought, which leaves the noise of long texts out.
    linear[np.abs(linear) < 1.5] = 0
    factors = np.where(usable[:, None], rng.normal(0, 0.02, (size, FACTORS)), 0.0)
    chunk, bucket, row = _all_terms(texts, usable)
    ends = np.searchsorted(chunk, np.arange(len(row) + 1))
    rows = np.searchsorted(row, np.arange(len(texts) + 1))
    test = rng.random(len(texts)) < 0.2
    machine = Machine(-3.0, linear, factors)
    square = [np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), np.array([1e-2])]
    for _ in range(rounds):
        scores = machine.chunk_scores(chunk, bucket, len(row))
        chosen, target = [], []
        for d in np.flatnonzero(~test):
            own = scores[rows[d] : rows[d + 1]]
            best = rows[d] + int(own.argmax())
            chosen.append(best)
            target.append(labels[d])
            if not labels[d] and len(own) > 1:
                chosen.append(rows[d] + int(rng.integers(len(own))))
                target.append(0)
        chosen, target = np.array(chosen), np.array(target, float)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // 256)):
                _descend(machine, square, [bucket[ends[c] : ends[c + 1]] for c in chosen[part]], target[part], rate, decay)
    weak = (np.abs(machine.linear) < 0.1) & (np.abs(machine.factors).max(1) < 0.1)
    machine.linear[weak] = 0
    machine.factors[weak] = 0
    machine = Machine(machine.bias, machine.linear, machine.factors)
    final = np.maximum.reduceat(machine.chunk_scores(chunk, bucket, len(row)), rows[:-1])
    _calibrate(machine, final[test], labels[test])
    return machine


def _all_terms(texts: list[bytes], usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    chunks, buckets, rows, n_chunks = [], [], [], 0
    for k in range(0, len(texts), TOGETHER):
        words, n = word_terms(*joined(texts[k : k + TOGETHER]))
        first, second, row = in_chunks(n)
        chunk, bucket = distinct(words, first, second, usable)
        chunks.append((chunk + n_chunks).astype(np.int32))
        buckets.append(bucket.astype(np.int32))
        rows.append((row + k).astype(np.int32))
        n_chunks += len(row)
    return np.concatenate(chunks), np.concatenate(buckets), np.concatenate(rows)


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows with each place; at is sorted."""
    out = np.zeros((n, values.shape[1]))
    cut = np.flatnonzero(np.diff(at, prepend=-1))
    if len(cut):
        out[at[cut]] = np.add.reduceat(values, cut, axis=0)
    return out


def _descend(machine: Machine, square: list[np.ndarray], sets: list[np.ndarray], target: np.ndarray, rate: float, decay: float) -> None:
    """One Adagrad step on a batch of chunks."""
    sizes = [len(s) for s in sets]
    chunk, bucket = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    v = machine.factors[bucket]
    sums, squares = _sums(v, chunk, len(sets)), _sums(v * v, chunk, len(sets))
    score = machine.bias + np.bincount(chunk, machine.linear[bucket], len(sets)) + 0.5 * (sums**2 - squares).sum(1)
    slope = (sigmoid(score) - target) / len(sets)
    used, at = np.unique(bucket, return_inverse=True)
    g_linear = np.bincount(at, slope[chunk]) + decay * machine.linear[used]
    order = np.argsort(at, kind="stable")
    g_factors = _sums((slope[chunk, None] * (sums[chunk] - v))[order], at[order], len(used)) + decay * machine.factors[used]
    square[0][used] += g_linear**2
    square[1][used] += g_factors**2
    square[2] += slope.sum() ** 2
    machine.linear[used] -= rate * g_linear / np.sqrt(square[0][used])
    machine.factors[used] -= rate * 0.3 * g_factors / np.sqrt(square[1][used])
    machine.bias -= float(rate * slope.sum() / np.sqrt(square[2][0]))


def _calibrate(machine: Machine, raw: np.ndarray, labels: np.ndarray, at: float = THRESHOLD) -> None:
    """Scales by a logistic fit on the rows left out of training, and shifts so that the cut of best F0.5 there (precision weighs double) scores ``at``."""
    if not len(raw) or labels.min() == labels.max():
        return
    order = np.argsort(-raw, kind="stable")
    hits = np.cumsum(labels[order])
    f05 = 1.25 * hits / (np.arange(1, len(raw) + 1) + 0.25 * labels.sum())
    f05[:-1][raw[order][:-1] == raw[order][1:]] = -1
    best = int(np.flatnonzero(f05 == f05.max())[-1])
    ranked = raw[order]
    cut = (ranked[best] + ranked[best + 1]) / 2 if best + 1 < len(raw) else ranked[best]
    slope = 8.0 / max(1e-6, raw[labels > 0].mean() - raw[labels == 0].mean())
    machine.scale, machine.shift = slope, float(np.log(at / (1 - at)) - slope * cut)
