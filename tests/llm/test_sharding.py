import zlib
from collections import defaultdict

import pytest

from tessera.llm import sharding as S
from tests.llm.conftest import ODD


def check(rows, got, shards=24):
    assert len(got) == len(rows)
    size = {(d, t): len((t or "").encode()) + 8 for d, t in rows}
    total, loads, slots = 0, defaultdict(int), defaultdict(list)
    for r in got:
        total += r.size
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert total == sum(len((t or "").encode()) + 8 for _, t in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    most = max(size.values())
    assert all(abs(loads[k] - total / shards) <= 2 * most for k in range(shards))
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(d, size[d, t], None if t is None else zlib.crc32(t.encode())) for d, t in rows}


@pytest.mark.parametrize("ranges,sample", [(256, 16384), (8, 40)])
def test_even_shards(make, ranges, sample):
    rows = [(i, "é" * (i * 7919 % 300) + str(i)) for i in range(2000)] + [(3000 + i, "the same hot text") for i in range(1500)]
    check(rows, S.assign(make(rows), ranges=ranges, sample=sample).collect())


def test_odd_rows(make):
    rows = ODD + [(100 + i, "z" * i) for i in range(300)]
    check(rows, S.assign(make(rows, extra=True)).collect())


def test_reruns_agree(make):
    rows = [(i, "x" * (i % 50)) for i in range(500)]
    a, b = (sorted(map(tuple, S.assign(df).collect())) for df in (make(rows), make(rows).repartition(5)))
    assert a == b


def test_sharded_documents(make):
    rows = ODD + [(100 + i, "z" * i) for i in range(300)]
    df = make(rows)
    out = S.sharded_documents(df)
    assert out.columns == [*df.columns, "shard", "slot"]
    narrow = {(r.doc_id, r.shard) for r in S.assign(df).collect()}
    assert {(r.doc_id, r.shard) for r in out.collect()} == narrow and out.count() == len(rows)


def test_empty_table(make):
    assert S.assign(make([])).count() == 0
    assert S.sharded_documents(make([])).count() == 0


def test_cells_bounded_by_bytes(make, monkeypatch):
    monkeypatch.setattr(S, "CELL_BYTES", 500)
    rows = [(i, "x" * (i * 31 % 90)) for i in range(600)] + [(1000 + i, "the same hot text") for i in range(300)]
    check(rows, S.assign(make(rows), ranges=8, sample=100).collect())
    out = S.sharded_documents(make(rows), ranges=8, sample=100).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in S.assign(make(rows), ranges=8, sample=100).collect()}


def test_null_ids_are_spread(make, monkeypatch):
    """Rows with neither id nor text of their own don't stay in one cell."""
    monkeypatch.setattr(S, "CELL_ROWS", 100)
    rows = [(None, "one text")] * 1200 + [(i, "x" * (i % 90)) for i in range(600)]
    check(rows, S.assign(make(rows), ranges=8, sample=200).collect())
    at, cells = S.plan(S.materialise(S.keyed(make(rows).select("doc_id", "text")).drop("text")), 8, 200)
    assert max(r.n for r in cells.groupBy("range_no", "part").agg(S.F.count("*").alias("n")).collect()) < 250
    out = S.sharded_documents(make(rows), ranges=8, sample=200).collect()
    assert len(out) == len(rows) and len({(r.shard, r.slot) for r in out}) == len(rows)
