import hashlib
import random
from collections import Counter

import pytest

from tessera.llm import substring_dedup as D
from tests.llm.conftest import ODD


def brute(rows, window):
    words = [((text or "").encode().split()) for _, text in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def run(df, window):
    return Counter(tuple(r)[:4] for r in D.remove_repeats(df, window).collect())


@pytest.mark.parametrize("bucket", [2048, 3])
def test_against_brute_force(make, monkeypatch, bucket):
    monkeypatch.setattr(D, "BUCKET", bucket)
    r = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for k in range(120):
        w = [f"w{r.randrange(400)}" for _ in range(r.randrange(0, 150))]
        if k % 3 == 0:
            at = r.randrange(len(w) + 1)
            lo = r.randrange(10)
            w[at:at] = passage[lo : lo + 45]
        rows.append((k, " ".join(w)))
    rows += [(500, "x " * 400), (501, rows[4][1]), (502, rows[4][1]), (502, rows[4][1])]
    assert run(make(rows), 35) == brute(rows, 35)


def test_odd_rows(make):
    assert run(make(ODD, extra=True), 5) == brute(ODD, 5)


def test_empty_table(make):
    assert D.remove_repeats(make([])).count() == 0


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert run(spark.read.parquet(f"{sf_dir}/documents.parquet"), 35) == brute(rows, 35)


def test_bucket_against_plain_count():
    r = random.Random(7)
    for window in (2, 3, 35):
        for _ in range(30):
            rows = [(bytes([k]), " ".join(r.choice(["a", "b", "ab", "é"]) for _ in range(r.randrange(window, window + 9))).encode(), r.choice([1, 1, 1, 2])) for k in range(r.randrange(1, 9))]
            seen = Counter()
            for _, packed, copies in rows:
                for w in D._windows(packed, window):
                    seen[w] += copies
            want = {(d, i) for d, packed, _ in rows for i, w in enumerate(D._windows(packed, window)) if seen[w] > 1}
            assert {(d, i) for d, lo, hi in D._judge_bucket(rows, window) for i in range(lo, hi)} == want


def test_many_hot_keys(make, monkeypatch):
    """Where the keys of hot buckets are too many to be broadcast, a shuffle gives the same."""
    monkeypatch.setattr(D, "BUCKET", 2)
    monkeypatch.setattr(D, "MOST_KEYS", 0)
    r = random.Random(1)
    passage = [f"p{i}" for i in range(50)]
    rows = [(k, " ".join([f"w{r.randrange(99)}" for _ in range(r.randrange(60))] + passage[k % 7 :] + [f"u{k}"] * (k % 3))) for k in range(60)]
    assert run(make(rows), 35) == brute(rows, 35)
