import hashlib
import pathlib
import re
from collections import Counter

import duckdb
import pytest

from tessera.llm import license_scan as L
from tessera.llm.license_texts import MIT, NOTICES, TEXTS
from tests.llm.conftest import ODD


def canonical(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    low = re.sub(L.COPYRIGHT_LINE, "", low)
    same = dict(L.SPELLINGS)
    return " ".join(same.get(w, w) for w in re.split(L.BETWEEN, low) if w)


def sha(text):
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def brute(rows):
    texts, notices = {}, {}
    for into, entries in ((texts, TEXTS), (notices, NOTICES)):
        for k, t in entries:
            into[sha(t)] = min(k, into.get(sha(t), k))
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, None, None, ""))
            continue
        lines = [x for x in text.split("\n") if "licen" in x.lower() or "copyright" in x.lower()]
        found = {notices[sha(x)] for x in lines if sha(x) in notices}
        out.append((doc, sha(text), texts.get(sha(text)), ",".join(sorted(found))))
    return Counter(out)


VARIANTS = [
    (20, f"Copyright (c) 2024 Somebody\n\n{MIT}"),
    (21, f"MIT LICENCE\n\n© 1999-2004 A, B & C. All rights reserved.\n\n{MIT.upper()}"),
    (22, MIT.replace('"', "“").replace(" ", "\n  ")),
    (23, MIT + " and more"),
    (24, "Some text.\nlicensed under the apache licence, version 2.0\nReleased under the MIT License.\n end"),
    (25, "SPDX-License-Identifier: MIT"),
    (26, "licence licence licence organisation whilst"),
    (27, "All rights reserved."),
    (28, "Released under" + " . " * 400 + "the MIT License"),
]


def test_against_brute_force(make):
    rows = ODD + VARIANTS
    got = Counter(map(tuple, L.scan(make(rows, extra=True)).collect()))
    assert got == brute(rows)
    of = {d: (k, n) for d, _, k, n in got}
    assert [of[d][0] for d in (20, 21, 22, 23, 25)] == ["MIT", "MIT", "MIT", None, "MIT"]
    assert of[24][1] == "Apache-2.0,MIT" and of[28][1] == "MIT"


def test_against_sql(make):
    rows = ODD + VARIANTS
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    assert Counter(con.execute(L.oracle()).fetchall()) == brute(rows)


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert Counter(map(tuple, L.scan(df).collect())) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_empty_table(make):
    assert L.scan(make([])).count() == 0


LONG = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def test_long_texts_are_known(make):
    folder = pathlib.Path("/usr/share/common-licenses")
    if not folder.is_dir():
        pytest.skip("no licence texts on this machine")
    texts = {k: (folder / f).read_text() for f, k in LONG.items()}
    cut = texts["Apache-2.0"].partition("APPENDIX: How to apply")[0]
    rows = [(i, t) for i, t in enumerate([*texts.values(), cut, cut + " and more", texts["GPL-3.0-only"].upper()])]
    got = {r.doc_id: r.license for r in L.scan(make(rows)).collect()}
    assert [got[i] for i in range(len(rows))] == [*texts, "Apache-2.0", None, "GPL-3.0-only"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {r[0]: r[2] for r in con.execute(L.oracle()).fetchall()} == got
