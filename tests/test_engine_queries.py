"""Every registered query that has SQL is held against DuckDB on the small tables; the others run and give rows."""

import math

import duckdb
import pytest

from tessera.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    expected = duck.execute(ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, expected.fetchall())
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_query_is_registered_once():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["rank", "doc_id", "title", "score", "snippet"]
    assert df.count() >= 0


def test_three_linkages_at_the_k_of_kmeans(spark, sf_dir):
    found = QUERIES["hierarchical_words"](spark, sf_dir).collect()
    of = {m: {r.term: r.cluster for r in found if r.method == m} for m in ("ward", "single", "complete")}
    assert len(found) == sum(map(len, of.values()))
    assert of["ward"].keys() == of["single"].keys() == of["complete"].keys()
    ks = {len(set(x.values())) for x in of.values()}
    assert len(ks) == 1 and ks <= set(range(6, 13))
