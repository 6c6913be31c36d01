import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_cnn as C
from tessera.llm import labelled as L
from tessera.llm import quality as Q
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def world():
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    rows, marks = [], []
    for k in range(700):
        w = [r.choice(words) for _ in range(r.randrange(20, 200))]
        good = r.random() < 0.6
        if not good:
            w = [x + r.choice(["###", "$$$", "!!"]) if r.random() < 0.7 else x.upper() for x in w]
        rows.append((k, " ".join(w)))
        marks.append((k, int(good), 0))
    return rows, marks


def test_held_out_accuracy(spark, make, world):
    rows, marks = world
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = Q.held_out_scores(make(rows, extra=True), labels).collect()
    good = {d: q for d, q, _ in marks}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == good[r.doc_id] for r in got if r.held_out]) > 0.97


def test_scores_do_not_depend_on_neighbours():
    net = C.Network.fresh(3)
    r = random.Random(1)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 7, 8, 9, 127, 128, 300, 5000, 2)]
    together = net.scores(*C.joined(texts))
    alone = [net.scores(*C.joined([t]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def test_gradients():
    net = C.Network.fresh(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = random.Random(1)
    texts = [bytes(r.randrange(97, 105) for _ in range(n)) for n in (30, 400, 900)]
    marks = np.array([1, 0, 1])
    logit, kept = net.forward(*C.joined(texts), keep=True)
    slope = 1 / (1 + np.exp(-logit)) - marks
    got = net.backward(kept, slope)

    def loss():
        x = net.forward(*C.joined(texts))[0]
        return float(np.sum(np.log1p(np.exp(x)) - marks * x))

    for name, values in net.p.items():
        for at in [np.unravel_index(r.randrange(values.size), values.shape) for _ in range(6)]:
            before = values[at]
            values[at] = before + 1e-4
            up = loss()
            values[at] = before - 1e-4
            down = loss()
            values[at] = before
            assert abs((up - down) / 2e-4 - got[name][at]) < 2e-2 * max(1, abs(got[name][at])), name


def test_odd_rows_and_tables(spark, make, world):
    rows, marks = world
    labels = spark.createDataFrame([*marks, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    got = Q.held_out_scores(make(ODD + rows), labels)
    assert got.count() == len(ODD) + len(rows)
    assert got.where("score is null or predicted is null or held_out is null").count() == 0
    none = labels.limit(0)
    assert Q.held_out_scores(make([]), none).count() == 0
    assert {r.score for r in Q.held_out_scores(make(ODD), none).collect()} == {0.5}


def test_every_byte_is_seen():
    """Texts that differ in one byte, the first, the last or any other, have windows that differ."""
    net = C.Network.fresh(3)
    for n in (1, 2, 7, 8, 9, 10, 11, 127, 128, 129, 263):
        text = bytes(97 + i % 23 for i in range(n))
        for at in {0, n // 2, n - 1}:
            other = text[:at] + b"Z" + text[at + 1 :]
            a, b = (C._padded(*C.joined([t])) for t in (text, other))
            starts, count, *_ = C._layout(np.array([0, n]))
            seen = {s + C.STRIDE * k + j for s, m in zip(starts, count, strict=True) for k in range(m) for j in range(C.WIDTH)}
            assert seen >= set(range(n)) and max(seen) < len(a)
            assert (a != b).sum() == 1
    assert net.scores(*C.joined([b"abcdefghi"]))[0] != net.scores(*C.joined([b"abcdefghZ"]))[0]
    assert net.scores(*C.joined([b"a"]))[0] != net.scores(*C.joined([b"b"]))[0]


def test_slices_do_not_show(monkeypatch):
    net = C.Network.fresh(5)
    r = random.Random(2)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 40_000, 3, 900, 0, 129)]
    whole = net.scores(*C.joined(texts))
    monkeypatch.setattr(C, "SLICE", 7)
    assert np.allclose(whole, net.scores(*C.joined(texts)), atol=1e-6)


def plain_logit(net, text):
    """The network as written down: one window, one chunk, one text at a time."""
    p = net.p
    padded = text + bytes(C.WIDTH)
    n = max(1, -(-(len(text) - C.WIDTH) // C.STRIDE) + 1) if text else 0
    per = C.CHUNK // 2 // C.STRIDE
    blocks = [[np.concatenate([p["embed"][b] for b in padded[C.STRIDE * k : C.STRIDE * k + C.WIDTH]]) @ p["filters"] + p["filter_bias"] for k in range(lo, min(n, lo + per))] for lo in range(0, max(n, 1), per)]
    pooled = [np.maximum(np.max(b, axis=0), 0) if b else np.zeros(C.FILTERS) for b in blocks]
    chunks = [np.maximum(x, y) for x, y in zip(pooled, [*pooled[1:], pooled[-1]], strict=True)]
    hidden = [np.maximum(c @ p["hidden"] + p["hidden_bias"], 0) for c in chunks]
    return float(np.concatenate([np.mean(hidden, axis=0), np.max(hidden, axis=0)]) @ p["out"] + p["out_bias"][0])


def test_against_plain_network():
    net = C.Network.fresh(9)
    r = random.Random(6)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 8, 9, 128, 129, 700)]
    got = net.forward(*C.joined(texts))[0]
    assert np.allclose(got, [plain_logit(net, t) for t in texts], atol=1e-4)


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_documents(spark):
    """Held-out labels of a real table."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = Q.held_out_scores(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert len(got) > 50 and auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.85
    assert (got.predicted == got.quality).mean() > 0.85


def test_sample_is_bounded_and_reproducible(spark, make):
    rows = [(1, "a" * 50), (1, "b" * 10), (2, "c" * 10), (2, "c" * 10), (3, None), (4, "d" * 10**5), (None, "x")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, 1, 0), (4, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    runs = [L.sample(make(rows).repartition(n), labels, "quality", F.lit(True), {0: 5, 1: 5}, 1000) for n in (1, 4)]
    (texts, marks), (again, _) = runs
    assert texts == again and len(texts) == 2 and marks.tolist() == [1, 1] and texts[1] == b"c" * 10 and texts[0] in (b"a" * 50, b"b" * 10)
    assert L.sample(make(rows), labels, "quality", F.lit(True), {0: 5, 1: 5}, 5)[0] == []
