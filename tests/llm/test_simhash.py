import random

import numpy as np
import pytest
import xxhash

from tessera.llm import bit_sliced as B
from tessera.llm import simhash as S
from tests.llm.conftest import ODD


def fingerprint(text):
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def clustered(n, seed=1):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n // 8)]
    return list(dict.fromkeys(x ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) & (2**64 - 1) for _ in range(8) for x in base))


def test_within_is_exact():
    fps = np.array(clustered(256)[:192], np.uint64)
    masks = B.within(fps[:, None], B.planes(fps.reshape(-1, 64)))
    for i, q in enumerate(fps.tolist()):
        for j, x in enumerate(fps.tolist()):
            assert bool(int(masks[i, j // 64]) >> (j % 64) & 1) == ((q ^ x).bit_count() <= 3)


@pytest.mark.parametrize("how", ["small", "large"])
def test_groups_keep_components(how):
    fps = clustered(400)
    if how == "large":
        links = B.large_group(np.array(fps, np.uint64))
        groups = [fps]
    else:
        groups = [fps[k : k + 30] for k in range(0, len(fps), 30)]
        links = B.small_groups([np.array(g, np.uint64) for g in groups])
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    for g in groups:
        at = {f: i for i, f in enumerate(g)}
        want = components(g)
        own = [(at[a], at[b]) for a, b in links if a in at and b in at]
        got = B.least_labels(len(g), np.array([a for a, _ in own], int), np.array([b for _, b in own], int))
        assert len(set(zip(want, got.tolist(), strict=True))) == len(set(want)) == len(set(got.tolist()))


def test_large_group_compares_found_lanes():
    """Two seeds of one batch that meet only through the lanes they find: those are linked to each other as well."""
    r = random.Random(2)
    fps = [r.getrandbits(63) for _ in range(48)]
    for x in (r.getrandbits(63) for _ in range(40)):
        fps += [x, x ^ 0b11110, x ^ 0b00010 ^ 1 << 63, x ^ 0b11010 ^ 1 << 63]
    fps.sort()
    assert sum(f < 1 << 63 for f in fps) == B.QUERIES
    at = {f: i for i, f in enumerate(fps)}
    links = [(at[a], at[b]) for a, b in B.large_group(np.array(fps, np.uint64))]
    got = B.least_labels(len(fps), np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert got.tolist() == components(fps)
    assert len(set(got.tolist())) == 48 + 40


def check(df, rows, **kw):
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in S.near_duplicates(df, **kw).collect()), key=str)
    fps = [fingerprint(t) for _, t in rows]
    root = components(fps)
    least = {c: min((rows[i][0] for i in range(len(rows)) if root[i] == c and rows[i][0] is not None), default=None) for c in set(root)}
    assert got == sorted(((rows[i][0], fps[i], least[root[i]]) for i in range(len(rows))), key=str)


def test_odd_rows(make):
    check(make(ODD, extra=True), ODD)


@pytest.mark.parametrize("bucket", [4096, 4])
def test_near_copies(make, bucket):
    r = random.Random(5)
    rows = []
    for k in range(12):
        w = [f"W{r.randrange(10**6)}" for _ in range(300)]
        for c in range(7):
            v = list(w)
            for _ in range(c):
                v[r.randrange(len(v))] = "changed"
            rows.append((100 * k + c, " ".join(v)))
    check(make(rows), rows, bucket=bucket)


def test_one_of_each(make):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, "quite another text here"), (4, None), (5, "")]
    df = make(rows)
    out = S.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_empty_table(make):
    assert S.near_duplicates(make([])).count() == 0


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


@pytest.mark.parametrize("part", [1 << 22, 400])
def test_one_of_each_finds_all_near_copies(make, part):
    r = random.Random(11)
    rows = []
    for k in range(20):
        w = [f"w{r.randrange(10**6)}" for _ in range(200)]
        for c in range(8):
            v = list(w)
            for _ in range(c):
                v[r.randrange(len(v))] = f"new{r.randrange(10**6)}"
            rows.append((100 * k + c, " ".join(v)))
    sets = [shingle_set(t) for _, t in rows]
    label, wide = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                wide += (fingerprint(rows[i][1]) ^ fingerprint(rows[j][1])).bit_count() > 3
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert wide > 20 and len(set(label)) > 20
    got = sorted(x.doc_id for x in S.one_of_each(make(rows), part).collect())
    assert got == sorted(rows[i][0] for i in set(label))


def test_one_of_each_loses_no_text(make):
    near = " ".join(f"w{i}" for i in range(100))
    rows = [(None, "one text of null id here"), (None, "some other text of null id"), (None, near + " more"), (1, near), (2, "shared id first text is this"), (2, "second text under that id"), (3, near + " again"), (3, "alone under an id of a copy"), (None, None), (None, "")]
    out = S.one_of_each(make(rows, extra=True))
    got = sorted((x.doc_id or 0, x.text or "") for x in out.collect())
    assert got == sorted([(0, rows[0][1]), (0, rows[1][1]), (1, near), (2, rows[4][1]), (2, rows[5][1]), (3, rows[7][1]), (0, "")])
