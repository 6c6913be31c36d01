import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import factorization as FM
from tessera.llm import toxicity as T
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def world():
    r = random.Random(4)
    words = [f"neutral{i}" for i in range(300)]
    rows, marks = [], []
    for k in range(900):
        w = [r.choice(words) for _ in range(r.randrange(5, 300))]
        bad = r.random() < 0.3
        if bad:
            w[r.randrange(len(w))] = r.choice(["grumpf", "zilch", "blorgs"])
        rows.append((k, " ".join(w)))
        marks.append((k, 1, int(bad)))
    return rows, marks


def test_held_out_accuracy(spark, make, world):
    rows, marks = world
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = T.held_out_scores(make(rows, extra=True), labels).collect()
    assert len(got) == len(rows)
    toxic = {d: t for d, _, t in marks}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == toxic[r.doc_id] for r in held]) > 0.97


def test_pairs_count_beyond_their_parts():
    """Insult and group mention are harmless alone; only their pair is toxic, which no additive score can tell."""
    r = random.Random(1)
    texts, marks = [], []
    for k in range(1200):
        a, b = k & 1, k >> 1 & 1
        w = [f"n{r.randrange(40)}" for _ in range(20)] + ["insult"] * a + ["group"] * b
        r.shuffle(w)
        texts.append(" ".join(w).encode())
        marks.append(a & b)
    machine = FM.train(texts[:900], np.array(marks[:900]), rounds=4, epochs=20)
    got = machine.scores(*FM.joined(texts[900:])) >= FM.THRESHOLD
    assert np.mean(got == np.array(marks[900:])) > 0.95


def test_odd_rows_and_tables(spark, make, world):
    rows, marks = world
    labels = spark.createDataFrame([*marks, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    odd = make(ODD + rows)
    got = T.held_out_scores(odd, labels)
    assert got.count() == len(ODD) + len(rows)
    assert got.where("score is null or predicted is null or held_out is null").count() == 0
    none = labels.limit(0)
    assert T.held_out_scores(make([]), none).count() == 0
    assert {r.score for r in T.held_out_scores(make(ODD), none).collect()} and T.held_out_scores(make(ODD), none).count() == len(ODD)


def test_reject_keeps_columns(spark, make, world):
    rows, marks = world
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    df = make(rows, extra=True)
    machine = T.train(df, labels, F.lit(True))
    out = T.reject(df, machine)
    assert out.columns == df.columns
    kept = {r.doc_id for r in out.collect()}
    toxic = {d for d, _, t in marks if t}
    assert len(kept & toxic) <= 0.03 * len(toxic) and len(kept - toxic) >= 0.98 * (len(rows) - len(toxic))


def plain_score(machine, text):
    """The factorization machine as written down: every pair of the terms of every 64 words, starting at every 32nd."""
    words = [w for w in re.findall(rb"[a-z0-9\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text))]
    best = None
    for at in range(0, max(1, len(words) - FM.STEP), FM.STEP):
        part = b" ".join(words[at : at + FM.CHUNK])
        own = sorted(set(FM.word_terms(np.frombuffer(part, np.uint8), np.array([0, len(part)]))[0].ravel().tolist()))
        score = machine.bias + sum(machine.linear[b] for b in own)
        score += sum(machine.factors[a] @ machine.factors[b] for i, a in enumerate(own) for b in own[:i])
        best = score if best is None else max(best, score)
    return best


def random_machine():
    rng = np.random.default_rng(3)
    size = 1 << FM.BITS
    linear, factors = rng.normal(0, 1, size), rng.normal(0, 0.3, (size, FM.FACTORS))
    off = rng.random(size) < 0.3
    linear[off], factors[off] = 0, 0
    return FM.Machine(-1.0, linear, factors)


def test_against_plain_formula(monkeypatch):
    machine = random_machine()
    r = random.Random(5)
    texts = [" ".join(r.choice(["Ab", "cé", "DDDDDDDD", "e", "ffffff", "g9"]) + str(r.randrange(30)) * r.randrange(2) for _ in range(n)).encode() for n in (0, 1, 31, 32, 33, 63, 64, 65, 96, 97, 200)]
    want = [plain_score(machine, t) for t in texts]
    assert np.allclose(machine.raw_scores(*FM.joined(texts)), want)
    monkeypatch.setattr(FM, "PAIRS", 50)
    assert np.allclose(machine.raw_scores(*FM.joined(texts)), want)
    assert np.allclose([machine.raw_scores(*FM.joined([t]), run_bytes=1)[0] for t in texts if t], [w for t, w in zip(texts, want, strict=True) if t])


def test_pieces_of_long_texts():
    machine = random_machine()
    r = random.Random(8)
    for n in (1, 33, 64, 65, 5000):
        text = " ".join(f"w{r.randrange(500)}" for _ in range(n)).encode() + b"  "
        whole = machine.raw_scores(*FM.joined([text]))
        for size in (1, 7, 300, 4000):
            assert np.allclose(machine.raw_scores(*FM.joined([text]), run_bytes=size), whole)
    assert np.isfinite(machine.raw_scores(*FM.joined([b"x" * 100_000]), run_bytes=1000)).all()


def test_pairs_across_a_cut_interact():
    """Wherever they stand, two terms within half a chunk are in one chunk."""
    for at in range(140):
        words = [f"n{i}" for i in range(200)]
        words[at], words[at + 20] = "insult", "group"
        buckets, n = FM.word_terms(*FM.joined([" ".join(words).encode()]))
        first, second, _ = FM.in_chunks(n)
        assert {first[at], second[at]} & {first[at + 20], second[at + 20]}


def test_documents(spark):
    """Held-out labels of a real table."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = T.held_out_scores(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert got.predicted[got.toxic == 1].mean() > 0.6 and got.predicted[got.toxic == 0].mean() < 0.03
