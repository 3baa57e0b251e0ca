"""Every registered query against its DuckDB statement (the driver's check)."""

import math

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from marquee.plans.registry import QUERIES

from .conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return round(v, 9) if not math.isnan(v) else "nan"
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) <= set(queries()) and set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, duck, key):
    df = queries()[key](spark, SF_SMALL)
    rows = df.collect()
    rel = duck.execute(oracle_sql()[key])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    idx = [names.index(c) for c in df.columns]
    got = sorted((tuple(_norm(v) for v in r) for r in rows), key=repr)
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("key", ["order_by_group_key", "order_group_then_rank", "order_recommendations"])
def test_sorts_keep_the_oracle_order(spark, duck, key):
    # the value check above ignores order; for the sorts the order is the result
    df = queries()[key](spark, SF_SMALL)
    rel = duck.execute(oracle_sql()[key])
    names = [d[0] for d in rel.description]
    idx = [names.index(c) for c in df.columns]
    got = [tuple(_norm(v) for v in r) for r in df.collect()]
    want = [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]
    assert got == want


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["year", "number_of_movies", "tconst_most_votes", "title_most_votes", "number_of_votes", "top10"]


@pytest.mark.parametrize(
    "conf",
    [{"spark.sql.adaptive.enabled": "false"}, {"spark.sql.ansi.enabled": "false"}, {"spark.sql.shuffle.partitions": "200"}],
    ids=["no-aqe", "no-ansi", "200-partitions"],
)
def test_core_queries_under_other_session_settings(spark, duck, conf):
    keys = ["build_movies", "yearly_summary", "top2_rated_per_genre", "recommend_by_genre", "year_report"]
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for key in keys:
            df = queries()[key](spark, SF_SMALL)
            rel = duck.execute(oracle_sql()[key])
            names = [d[0] for d in rel.description]
            idx = [names.index(c) for c in df.columns]
            got = sorted((tuple(_norm(v) for v in r) for r in df.collect()), key=repr)
            want = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
            assert got == want, key
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
