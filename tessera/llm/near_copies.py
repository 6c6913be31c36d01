"""Near copies: sets of word shingles that are alike, confirmed by their exact similarity.

A text's set holds the XXH64 hashes of its shingles, its digest is the set's name. Two
sets are near copies when their Jaccard similarity is ``ALIKE`` or more. Candidates are
sets that share one of ``BANDS`` bands of ``ROWS`` MinHash values: a pair at similarity
s is missed with a chance of (1 - s^4)^20, 3e-5 at 0.8. Whatever is proposed, only pairs
whose sets were compared element by element are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ALIKE = (4, 5)
BANDS, ROWS = 20, 4
#: Shingles of one part of a candidate group; larger groups are cut into parts that meet pairwise.
PART = 1 << 22
#: Shingles whose MinHash values are taken at a time, and compared at a time.
AT_ONCE = 1 << 12
COMPARED = 1 << 20

_random = np.random.default_rng(20250311)
_TIMES = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) << np.uint64(1) | np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_MIX = _random.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) << np.uint64(1) | np.uint64(1)
_SALT = _random.integers(0, 1 << 63, BANDS, np.uint64)


def bands(shingles: np.ndarray) -> np.ndarray:
    """The band keys of a set (distinct uint64); none if it is empty."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), AT_ONCE):
        least = np.minimum(least, (shingles[None, i : i + AT_ONCE] * _TIMES + _PLUS).min(1))
    least ^= least >> np.uint64(31)
    keys = (least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64) + _SALT
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def alike(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the others (sorted distinct arrays, not empty) are near copies of own."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    shared = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return ALIKE[1] * shared >= ALIKE[0] * (sizes + len(own) - shared)


def group_links(names: list[int], sets: list[np.ndarray], keys: list[list[int]]) -> list[tuple[int, int]]:
    """Links that join the near copies among sets that share a key into their components.

    Sets found leave the unvisited ones and become later queries, so that a dense
    group is compared about once; every pair that shares a key and is not joined
    already is compared.
    """
    of_key: dict[int, list[int]] = {}
    for i, own in enumerate(keys):
        for k in own:
            of_key.setdefault(k, []).append(i)
    links, visited = [], [False] * len(names)
    for start in range(len(names)):
        if visited[start]:
            continue
        visited[start], frontier = True, [start]
        while frontier:
            q = frontier.pop()
            near: set[int] = set()
            for k in keys[q]:
                of_key[k] = [i for i in of_key[k] if not visited[i]]
                near.update(of_key[k])
            n = len(sets[q])
            todo = sorted(i for i in near if ALIKE[1] * min(n, len(sets[i])) >= ALIKE[0] * max(n, len(sets[i])))
            while todo:
                size, part = 0, []
                while todo and size < COMPARED:
                    part.append(todo.pop())
                    size += len(sets[part[-1]])
                for i, yes in zip(part, alike(sets[q], [sets[i] for i in part]).tolist(), strict=True):
                    if yes:
                        visited[i] = True
                        frontier.append(i)
                        links.append((names[q], names[i]))
    return links


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group (root, p, q) with set, keys and shingles; the links within each group."""
    group, rows = None, {}

    def close() -> pa.RecordBatch:
        links = group_links(list(rows), [s for s, _ in rows.values()], [k for _, k in rows.values()])
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], ["u", "v"])

    for batch in batches:
        own = [batch[c].to_pylist() for c in ("root", "p", "q", "set", "keys")]
        for r, (root, p, q, name, keys) in enumerate(zip(*own, strict=True)):
            if (root, p, q) != group:
                if rows:
                    yield close()
                group, rows = (root, p, q), {}
            rows[name] = (np.frombuffer(batch["shingles"][r].as_py(), np.uint64), keys)
    if rows:
        yield close()
