"""Super-k-mers of a run of texts: consecutive windows that share a minimiser."""

from __future__ import annotations

import numpy as np

from tessera.llm import kernel as K

WINDOW = 35
MINIMISER = 8
#: A super-k-mer is cut after so many windows; its parts still meet in the same bucket.
MOST_WINDOWS = 256


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least value of every n consecutive ones, by doubling."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def super_kmers(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, minimiser: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window (a word index in the run), number of windows and minimiser hash of every super-k-mer.

    hashes: of the words; first: index of each row's first word, and one more.
    """
    n = np.maximum(np.diff(first) - window + 1, 0)
    none = np.zeros(0, np.int64)
    if not n.sum():
        return none, none, none, none.astype(np.uint64)
    minimiser = min(minimiser, window)
    grams = np.zeros(len(hashes) - minimiser + 1, np.uint64)
    for j in range(minimiser):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(grams)]
    least = sliding_min(K.mix(grams), window - minimiser + 1)
    row = np.repeat(np.arange(len(n)), n)
    at = first[:-1][row] + K.concat(n)
    key = least[at]
    begins = np.ones(len(at), bool)
    begins[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    group = np.flatnonzero(begins)
    sizes = np.diff(np.append(group, len(at)))
    if sizes.max() > MOST_WINDOWS:
        begins[np.flatnonzero(K.concat(sizes) % MOST_WINDOWS == 0)] = True
        group = np.flatnonzero(begins)
        sizes = np.diff(np.append(group, len(at)))
    return row[group], at[group], sizes, key[group]


def repeats_inside(hashes: np.ndarray, at: np.ndarray, n: np.ndarray, key: np.ndarray, window: int = WINDOW, minimiser: int = MINIMISER) -> np.ndarray:
    """Whether the minimiser stands at two places of a super-k-mer, as it must if one of its windows recurs inside."""
    minimiser = min(minimiser, window)
    grams = np.zeros(max(len(hashes) - minimiser + 1, 0), np.uint64)
    for j in range(minimiser):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(grams)]
    grams = K.mix(grams)
    span = window - minimiser + 1
    seen = np.zeros(len(at), np.int64)
    for j in range(2 * span - 1):
        inside = np.flatnonzero(n + span - 1 > j) if j >= span else slice(None)
        seen[inside] += grams[at[inside] + j] == key[inside]
    return (n > span) | (seen > 1)
