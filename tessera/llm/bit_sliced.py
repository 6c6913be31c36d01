"""Bit-sliced Hamming comparison of 64-bit fingerprints.

Fingerprints are stored vertically: word b of a block holds bit b of 64
fingerprints (its lanes). One XOR then compares a bit of a query with 64
fingerprints, and carry-save counters (ones, twos, and a sticky four-or-more) add
the difference to 64 distances at once. After every ``STRIDE`` planes, blocks whose
lanes all exceed the radius are abandoned.
"""

from __future__ import annotations

import numpy as np

LANES = 64
STRIDE = 8
#: Queries whose hits are spread out at a time, and block pairs compared at a time.
QUERIES = 128
BLOCKS = 512
RADIUS = 3

_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes(lanes: np.ndarray) -> np.ndarray:
    """(64, blocks) bit planes of (blocks, 64) fingerprints."""
    bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(len(lanes), LANES, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64).reshape(64, len(lanes))


def within(queries: np.ndarray, vertical: np.ndarray) -> np.ndarray:
    """(queries, blocks) masks of the lanes at RADIUS (3) or fewer differing bits.

    queries: (queries, blocks) or (queries, 1) fingerprints; vertical: (64, blocks).
    """
    shape = np.broadcast_shapes(queries.shape, (1, vertical.shape[1]))
    out = np.zeros(shape, np.uint64)
    q, b = (x.ravel() for x in np.indices(shape))
    own = np.broadcast_to(queries, shape)[q, b]
    ones, twos, over = (np.zeros(len(q), np.uint64) for _ in range(3))
    for bit in range(64):
        differ = vertical[bit, b] ^ (_ALL * ((own >> np.uint64(bit)) & _ONE))
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        if bit % STRIDE == STRIDE - 1:
            live = np.flatnonzero(over != _ALL)
            if not len(live):
                return out
            if len(live) < len(q):
                q, b, own, ones, twos, over = (x[live] for x in (q, b, own, ones, twos, over))
    out[q, b] = ~over
    return out


def _spread(masks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Indices of the set bits of an array of masks, with the lane as the last one."""
    hit = np.nonzero(masks)
    bits = np.unpackbits(np.ascontiguousarray(masks[hit]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, lane = np.nonzero(bits)
    return *(x[k] for x in hit), lane


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index in the component of each of n nodes joined by the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (label[a], label[b], a, b):
            np.minimum.at(new, x, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def small_groups(groups: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the components of groups of at most 64 fingerprints; several groups share a block."""
    blocks: list[list[int]] = [[]]
    for g in groups:
        if len(blocks[-1]) + len(g) > LANES:
            blocks.append([])
        blocks[-1] += g.tolist()
    links = []
    for k in range(0, len(blocks), BLOCKS):
        part = blocks[k : k + BLOCKS]
        lanes = np.zeros((len(part), LANES), np.uint64)
        filled = np.array([len(x) for x in part])
        for i, x in enumerate(part):
            lanes[i, : len(x)] = x
            lanes[i, len(x) :] = x[0] if x else 0
        masks = within(lanes.T, planes(lanes))
        lane_a, block, lane_b = _spread(masks)
        keep = (lane_a < filled[block]) & (lane_b < filled[block]) & (lane_a < lane_b)
        flat = lanes.ravel()
        a, b = (block * LANES + lane_a)[keep], (block * LANES + lane_b)[keep]
        if len(a):
            label = least_labels(lanes.size, a, b)
            moved = np.flatnonzero(label != np.arange(lanes.size))
            links += zip(flat[moved].tolist(), flat[label[moved]].tolist(), strict=True)
    return links


def large_group(group: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components of one group of any size.

    Queries come in batches. A batch meets itself and all lanes that are not queried
    yet; only lanes known to be in the batch's own component are left out, so a dense
    group is scanned about once. Links are folded into labels batch by batch, so no
    pairs pile up.
    """
    label = np.arange(len(group))
    unvisited = np.arange(len(group))
    frontier = np.zeros(0, np.int64)
    while len(unvisited) or len(frontier):
        if len(frontier):
            frontier = frontier[np.argsort(label[frontier], kind="stable")]
            batch, frontier = frontier[:QUERIES], frontier[QUERIES:]
        else:
            batch, unvisited = unvisited[:QUERIES], unvisited[QUERIES:]
        others = np.concatenate([batch, frontier, unvisited])
        if (label[batch] == label[batch[0]]).all():
            others = others[label[others] != label[batch[0]]]
        if not len(others):
            continue
        pad = -len(others) % LANES
        lanes = group[np.append(others, np.repeat(others[:1], pad))].reshape(-1, LANES)
        found = []
        for k in range(0, len(lanes), BLOCKS):
            q, block, lane = _spread(within(group[batch][:, None], planes(lanes[k : k + BLOCKS])))
            at = (block + k) * LANES + lane
            keep = at < len(others)
            found.append((batch[q[keep]], others[at[keep]]))
        q, hit = (np.concatenate(x) for x in zip(*found, strict=True))
        linked = np.flatnonzero(label != np.arange(len(group)))
        label = least_labels(len(group), np.concatenate([linked, q]), np.concatenate([label[linked], hit]))
        new = np.intersect1d(hit, unvisited)
        unvisited = np.setdiff1d(unvisited, new, assume_unique=True)
        frontier = np.concatenate([frontier, new])
    moved = np.flatnonzero(label != np.arange(len(group)))
    return list(zip(group[moved].tolist(), group[label[moved]].tolist(), strict=True))
