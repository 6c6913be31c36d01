import math
import random
import re
import statistics
from collections import Counter

import numpy as np
import pytest

from tessera.llm import fertility as R
from tests.llm.conftest import ODD

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


TEXTS = [t for _, t in ODD] + ["a b c\na b c\n a b c\n\n\n \na b c", "x y z x y z", "é ü# $$ <b>|", "\n\n", "a\x85b c d\xa0e", "one two one two one two\nx"]


def test_base_counts():
    raw = [(t or "").encode() for t in TEXTS]
    got = R.base_counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    rows = list(zip(*(got[n].tolist() for n in R._BASE), strict=True))
    assert rows == [brute(t) for t in TEXTS]


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = R.judge(docs).toPandas().set_index("doc_id")
    for r in docs.collect():
        assert tuple(got.loc[r.doc_id, R._BASE]) == brute(r.text)
    failed = (got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)
    assert (failed == got.base_failed).all() and not (got.kept & failed).any()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id")
    both = got.join(labels, how="inner")
    good = both[(both.quality == 1) & ~both.base_failed]
    bad = both[both.quality == 0]
    assert good.kept.mean() > 0.97 and bad.kept.mean() < 0.6


@pytest.fixture(scope="module")
def meters():
    return [R.Meter("m", *R.read_vocabulary(R.FOLDER, v)) for v in R.VOCABULARIES]


def plain_measures(meter, text):
    """The measures as written down, by a loop over tokens."""
    tokens = meter.encoding.encode_ordinary(text)
    byte = sum(b"\xef\xbf\xbd" in meter.encoding.decode_single_token_bytes(t).decode(errors="replace").encode() for t in tokens)
    blocks = -(-len(tokens) // R.BLOCK)
    bits = 0.0
    for b in range(blocks):
        own = [t for i, t in enumerate(tokens) if i * blocks // len(tokens) == b]
        h = -sum(c / len(own) * math.log2(c / len(own)) for c in Counter(own).values())
        bits += h / math.log2(max(2, len(own))) * len(own)
    return len(text) / len(tokens), byte / len(tokens), bits / len(tokens)


def test_measures(meters):
    for meter in meters:
        assert meter("") == (0.0, 0.0, 0.0)
        for text in ("hello hello hello hello", "\U0001fbb4\U0001fbb5", "a", "Wörter und é " * 700, "one two three " * 300 + " tail\n\n"):
            assert np.allclose(meter(text), plain_measures(meter, text))
        # An unbroken run is measured as it is: nothing is put in between.
        run = "ab" * 5000
        assert meter(run)[0] == len(run) / len(meter.encoding.encode_ordinary(run))
        assert meter("x" * 300_000)[0] > 0 and meter(" " * 2_000_000 + "x")[0] > 0


def test_pieces_change_no_token(meters):
    r = random.Random(3)
    parts = ["word", " ", "  ", "\n", "\n \n", "\u3000", "é", "1234", "!!", " don't", "\xa0", "中文字", "\x1c", "\t"]
    for size in (1, 5, 40):
        for _ in range(60):
            text = "".join(r.choice(parts) for _ in range(120))
            cut = list(R.pieces(text, size))
            assert "".join(p for p, _ in cut) == text and len(cut) > 1
            for m in meters:
                assert [t for p, _ in cut for t in m.encoding.encode_ordinary(p)] == m.encoding.encode_ordinary(text)
    for text in ("a" + " " * 20_000 + "b", " " * 12_000 + "\nb", "a" + "\n" * 15_000, "a " + " \n" * 9_000 + "é c"):
        for m in meters:
            assert m.tokens(text).tolist() == m.encoding.encode_ordinary(text)


def test_verdict_against_plain_rules(spark, sf_dir, meters):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()] + [(-1, "One document of no language: " + docs.where("length(text) between 2000 and 4000").orderBy("doc_id").first().text, None)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in R.judge(more.repartition(3)).collect()}
    found = {}
    for doc, text, lang in rows:
        n_words, *_, repeats = brute(text)
        if n_words >= 50 and 2 * repeats <= n_words:
            found[doc] = lang, [plain_measures(m, text) for m in meters]
    for doc, _, lang in rows:
        assert got[doc].base_failed == (doc not in found)
        kept = doc in found
        for k in range(2) if kept else ():
            same = [x[k] for own, x in found.values() if own == lang]
            per, share, bits = found[doc][1][k]
            assert np.allclose((got[doc][f"per_token_{k}"], got[doc][f"byte_share_{k}"], got[doc][f"entropy_{k}"]), (per, share, bits))
            mid = statistics.median(round(x[0], 3) for x in same)
            kept &= 0.82 * mid <= per <= 1.3 * mid and share <= statistics.median(round(x[1], 3) for x in same) + 0.1 and bits >= 0.65
        assert got[doc].kept == kept


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(make, rows):
    got = R.judge(make(rows, extra=False)).collect()
    assert Counter((r.doc_id, *(r[n] for n in R._BASE)) for r in got) == Counter((d, *brute(t)) for d, t in rows)
    assert all(r.kept is not None and r.base_failed is not None for r in got)
