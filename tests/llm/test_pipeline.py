"""The five stages against a plain run of each over the same rows."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import decontamination as D
from tessera.llm import factorization as FM
from tessera.llm import mixing as M
from tessera.llm import toxicity as T
from tessera.llm.common import table

INSULTS = ("trash", "idiot", "moron", "scum")


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Tables with toxic documents, exact and near copies, benchmark passages, null and empty texts and a hot source."""
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, labels = [], []
    for k in range(400):
        words = [r.choice(vocabulary) for _ in range(r.randrange(30, 220))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(INSULTS)
        rows.append([k, " ".join(words), "en", ["hot", "hot", "a", "b", None][k % 5 if k % 7 else 0], 0])
        if k < 300:
            labels.append((k, 1, int(toxic)))
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([8, 13, 20])))) for k in range(12)]
    for k in range(1, 400, 9):
        words = rows[k][1].split()
        words[5:5] = items[k % 12][1].upper().split()
        rows[k][1] = " ".join(words)
    rows += [[1000 + k, rows[k][1], "en", "copies", 0] for k in range(0, 400, 11)]
    for k in range(3, 400, 13):
        words = rows[k][1].split()
        words[len(words) // 2] = "changed"
        rows.append([2000 + k, " ".join(words), "en", "near", 0])
    rows += [[3000, None, "en", "a", None], [3001, "", "en", "a", 0], [3002, " \n", None, "b", 2], [None, "text without an id " * 3, "en", "b", 0], [3003, "one " * 40, "en", "a", 0], [3003, "two " * 40, "en", "a", 0]]
    rows = [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s, _ in rows]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    return f"file://{folder}", rows, items


def without_toxic(spark, folder, rows):
    machine = T.train(table(spark, folder, "documents"), table(spark, folder, "labels"), F.lit(True))
    return [x for x in rows if machine.scores(*FM.joined([(x[1] or "").encode()]))[0] < FM.THRESHOLD]


def shingles(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def without_copies(rows):
    sets = [shingles(x[1]) for x in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    groups = defaultdict(list)
    for x, c in zip(rows, label, strict=True):
        groups[c].append(x)
    return [min(own, key=lambda x: (x[0] is None, x[0])) for own in groups.values()]


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def without_benchmark(rows, items):
    lower = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
    windows = set()
    for _, text in items:
        words = WORD.findall(lower(text))
        windows |= {tuple(words[i : i + 13]) for i in range(max(1, len(words) - 12))}
    out = []
    for d, text, lang, source, n in rows:
        found = list(WORD.finditer(lower(text or "")))
        words = [m.group() for m in found]
        hit = [False] * len(words)
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit[i : i + size] = [True] * size
        if sum(hit) and 20 * sum(hit) >= len(words):
            continue
        if sum(hit):
            raw, kept, at = text.encode(), [], 0
            for k, m in enumerate(found):
                if hit[k] and not (k and hit[k - 1]):
                    kept.append(raw[at : m.start()])
                if hit[k]:
                    at = m.end()
            text = b"".join([*kept, raw[at:]]).decode()
            n = len(text)
        out.append((d, text, lang, source, n))
    return out


def mixed(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(d, t, s) for d, t, _, s, _ in rows])
    sizes = con.execute("SELECT doc_id, size, taken FROM (" + M.oracle() + ")").fetchall()
    out = Counter()
    for d, size, taken in sizes:
        if size:
            out[d, size] += taken // size
    return out


def near(spark, df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_each_stage(spark, world):
    folder, rows, items = world
    kept = [*rows]
    docs = table(spark, folder, "documents")
    plain = {
        "toxicity": lambda x: without_toxic(spark, folder, x),
        "simhash_near_dedup": without_copies,
        "benchmark_decontamination": lambda x: without_benchmark(x, items),
    }
    for name, stage in P.STAGES[:3]:
        own = plain[name](kept)
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns
        assert near(spark, got) == sorted(own, key=repr), name
        assert 0 < len(own) < len(kept)
        docs, kept = P.materialise(got), own
    got = P.STAGES[3][1](spark, docs, folder)
    assert got.columns == docs.columns
    counts = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in got.collect())
    assert {k: n for k, n in counts.items() if k[1]} == {k: n for k, n in mixed(kept).items() if n}
    assert {(r.doc_id, r.text) for r in got.collect()} <= {(d, t) for d, t, *_ in kept}


def test_run(spark, world):
    folder, rows, items = world
    kept = without_benchmark(without_copies(without_toxic(spark, folder, rows)), items)
    out = P.run(spark, folder).collect()
    wanted = mixed(kept)
    counts = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in out)
    assert {k: n for k, n in counts.items() if k[1]} == {k: n for k, n in wanted.items() if n}
    loads, slots = defaultdict(int), defaultdict(list)
    for r in out:
        loads[r.shard] += len((r.text or "").encode()) + 8
        slots[r.shard].append(r.slot)
    most = max(len((r.text or "").encode()) + 8 for r in out)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(loads[k] - sum(loads.values()) / 24) <= 2 * most for k in range(24))
    toxic = {d for d, t, *_ in rows if t and set(t.split()) & set(INSULTS)}
    assert len(toxic & {r.doc_id for r in out}) <= 0.05 * len(toxic)


def test_given_tables(spark, sf_dir):
    """On a given table: benchmark windows are gone, and of texts alike one is left."""
    out = P.run(spark, sf_dir)
    assert out.columns == [*table(spark, sf_dir, "documents").columns, "shard", "slot"]
    rows = out.select("doc_id", "text").distinct()
    assert rows.count() > 50
    again = D.contamination(rows, table(spark, sf_dir, "benchmark"))
    assert again.where("contaminated").count() == 0
    texts = [r.text for r in rows.collect()]
    sets = [shingles(t) for t in texts]
    assert not any(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i))
