from collections import Counter, defaultdict

import duckdb
import pytest

from tessera.llm import mixing as M
from tests.llm.conftest import ODD


def duck(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r[0], r[1], r[2] if len(r) > 2 else "s") for r in rows])
    return con.execute(sql).fetchall()


def run(df):
    return Counter(map(tuple, M.mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()))


def world():
    return [(i, "w " * (i * 7919 % 90), [None, "b", "a", "é", "Z", "hot", "hot", "hot"][i % 8]) for i in range(800)] + [(900, None, "empty"), (901, "", "empty"), (902, "x " * 5000, "a")]


def test_against_sql(make):
    rows = world()
    assert run(make(rows)) == Counter(duck(rows, M.oracle()))


def test_targets_and_bounds(make):
    rows = [tuple(r) for r in M.mix(make(world())).select("source", "size", "source_size", "target", "taken").collect()]
    taken = defaultdict(int)
    for source, size, whole, target, n in rows:
        assert n % max(size, 1) == 0 and n <= 2 * size and target <= 2 * whole
        taken[source] += n
    goal = {r[0]: r[3] for r in rows}
    assert abs(sum(goal.values()) - 1.5 * sum(r[1] for r in rows)) < 1e-6
    assert all(abs(taken[s] - goal[s]) <= max(r[1] for r in rows if r[0] == s) for s in goal)


def test_reruns_agree(spark, make):
    df = make(world())
    assert run(df) == run(df.repartition(7))


def test_odd_rows(make):
    got = run(make(ODD, extra=True))
    assert sum(got.values()) == len(ODD)


def test_mixed_documents(make):
    df = make(world(), extra=True)
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    copies = {r.doc_id: r.copies for r in M.mix(df).collect()}
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})


def test_empty_table(make):
    assert M.mix(make([])).count() == 0


def test_hot_source_of_equal_rows(make):
    rows = [(i, "same text here", "hot") for i in range(300)] + [(300, "a b", "x")]
    assert run(make(rows)) == Counter(duck(rows, M.oracle()))
    assert pytest.approx(sum(r[4] * n for r, n in run(make(rows)).items()), abs=6) == 1.5 * 902
