import hashlib
import pickle
import random
import re
from collections import Counter

import pytest

from tessera.llm import decontamination as D
from tessera.llm.suffix_automaton import SuffixAutomaton
from tests.llm.conftest import ODD


def tokens(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, window=13):
    windows = {}
    for item, text in items:
        w = tokens(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w = tokens(text)
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
                    found |= windows[tuple(w[i : i + n])]
        h = sum(hit)
        out.append((doc, len(w), h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0 and 20 * h >= len(w)))
    return Counter(out)


@pytest.fixture(scope="module")
def world():
    r = random.Random(2)
    words = [f"v{i}" for i in range(60)] + ["Ünï", "x9"]
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([3, 5, 12, 13, 14, 40])))) for k in range(30)] + [(90, None), (91, "?!"), (92, "")]
    rows = []
    for k in range(150):
        w = [r.choice(words) if r.random() < 0.7 else f"other{r.randrange(99)}" for _ in range(r.randrange(200))]
        if k % 3 == 0:
            item = items[r.randrange(30)][1].upper().split()
            at = r.randrange(len(w) + 1)
            w[at:at] = item[r.randrange(3) :]
        rows.append((k, "; ".join(w)))
    return rows, items


@pytest.mark.parametrize("block", [200_000, 60])
def test_against_brute_force(spark, make, world, block):
    rows, items = world
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(map(tuple, D.contamination(make(rows), bench, block_words=block).collect()))
    assert got == brute(rows, items)


@pytest.mark.parametrize("block", [200_000, 20])
def test_odd_rows(spark, make, block):
    items = [(1, "a"), (1, "a"), (2, "word " * 20), (3, "é é"), (4, " ".join(f"z{i}" for i in range(90)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(map(tuple, D.contamination(make(ODD, extra=True), bench, block_words=block).collect()))
    assert got == brute(ODD, items)


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert Counter(map(tuple, D.contamination(make(ODD), none).collect())) == brute(ODD, [])
    assert D.contamination(make([]), none).count() == 0


def test_spans_go_and_clean_texts_stay(spark, make):
    item = " ".join(f"q{i}" for i in range(20))
    filler = " ".join(f"f{i}" for i in range(600))
    rows = [(1, f"  Héllo, {item.upper()}! then {filler}"), (2, item), (3, filler), (4, None), (5, "")]
    df = make(rows, extra=True)
    out = D.decontaminate(df, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {1, 3, 4, 5}
    assert got[1].text == f"  Héllo, ! then {filler}" and got[1].n_chars == len(got[1].text)
    assert got[3].text == filler and got[4].text is None and got[5].text == ""


def test_documents(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows, items = ([tuple(r) for r in df.collect()] for df in (docs.select("doc_id", "text"), bench.select("item_id", "text")))
    assert Counter(map(tuple, D.contamination(docs, bench).collect())) == brute(rows, items)


@pytest.mark.parametrize("block", [60, 15])
def test_blocks_decontaminate_as_one(spark, make, world, block):
    rows, items = world
    r = random.Random(4)
    # Passages of several items that lie apart or overlap, some under the limit each but not together.
    long = [(200 + k, " ".join(f"p{k + i}" for i in range(20))) for k in range(0, 40, 8)]
    for k in range(60):
        w = [f"other{r.randrange(99)}" for _ in range(r.choice([300, 450, 900]))]
        for _ in range(r.randrange(1, 4)):
            lo = r.randrange(30)
            w[(at := r.randrange(len(w))) : at] = [f"p{i}" for i in range(lo, lo + r.choice([14, 20, 27]))]
        rows = [*rows, (1000 + k, " ".join(w))]
    rows = [*rows, *ODD, (2000, long[0][1] + " " + " ".join(f"z{i}" for i in range(500)))]
    bench = spark.createDataFrame(long + [(300, " ".join(f"q{i}" for i in range(25)))], "item_id long, text string")
    df = make(rows, extra=True)
    one = Counter(map(tuple, D.decontaminate(df, bench).collect()))
    parts = D.decontaminate(df, bench, block_words=block)
    assert parts.columns == df.columns
    assert Counter(map(tuple, parts.collect())) == one
    assert sum(one.values()) < len(rows)


def test_coverage_over_blocks(spark, make):
    """Two items of 13 words each cover 5 % of a document together; however small the blocks, it goes."""
    items = [(k, " ".join(f"i{k}x{j}" for j in range(13))) for k in range(2)]
    words = [f"f{i}" for i in range(460)]
    words[300:300], words[100:100] = items[1][1].split(), items[0][1].split()
    rows = [(1, " ".join(words)), (2, " ".join(words[:200]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (10, 1000):
        got = D.contamination(make(rows), bench, block_words=block).orderBy("doc_id").collect()
        assert [(r.n_hit, r.n_items, r.contaminated) for r in got] == [(26, 2, True), (13, 1, True)]
        assert D.decontaminate(make(rows), bench, block_words=block).count() == 0


def test_automaton_against_plain_search():
    r = random.Random(9)
    for window in (3, 5):
        for _ in range(40):
            seqs = [[r.randrange(4) for _ in range(r.randrange(1, 14))] for _ in range(r.randrange(1, 6))]
            automaton = SuffixAutomaton()
            for s in seqs:
                automaton.add(s)
            packed = pickle.loads(pickle.dumps(automaton.packed(seqs, window)))
            stream = [r.randrange(5) for _ in range(60)]
            state = matched = 0
            for i, token in enumerate(stream):
                state, matched = packed.step(state, matched, token)
                ending = [stream[i + 1 - n : i + 1] for n in range(1, i + 2)]
                longest = max((len(x) for x in ending if any(x == s[k : k + len(x)] for s in seqs for k in range(len(s)))), default=0)
                assert matched == longest
                want = {}
                for k, s in enumerate(seqs):
                    n = min(window, len(s))
                    if i + 1 >= n and any(stream[i + 1 - n : i + 1] == s[j : j + n] for j in range(len(s) - n + 1)):
                        want.setdefault(n, set()).add(k)
                assert {n: set(x) for n, x in packed.found(state, matched)} == want
