import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import topk
from marquee.llm.registry import QUERIES, SQL
from tests.conftest import SF_ORACLE

from .brute import nearest

ROWS = "vec_id long, embedding array<float>"


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_matches_sql_and_all_pairs(spark):
    df = QUERIES["op11_top_neighbours"](spark, SF_ORACLE)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF_ORACLE}/embeddings.parquet')")
    rel = con.execute(SQL["op11_top_neighbours"])
    assert [d[0] for d in rel.description] == df.columns == ["query_id", "rank", "vec_id", "score"]
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_ORACLE}/embeddings.parquet").collect()]
    assert got(df) == sorted(rel.fetchall(), key=repr) == sorted(nearest(rows), key=repr)


@pytest.mark.parametrize("most", [(1 << 16, 1 << 13), (40, 3)])
def test_sparse_tied_and_repeated_vectors(spark, most):
    draw = random.Random(3)
    vector = lambda: [draw.choice([0.0, 0.0, 0.0, 0.5, -0.25, 1.0]) for _ in range(draw.choice([5, 5, 8]))]
    same = [1.0, 0.0, 0.5, 0.0, 0.25]
    rows = [(k, vector() if k % 3 else same) for k in range(0, 900, 4)] + [(16, same), (16, same), (400, same), (400, vector())]
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    assert got(topk.top_k(df, df.filter("vec_id % 100 = 0"), most=most)) == sorted(nearest(rows), key=repr)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (None, [1.0, 1.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0, 1.0, 9.0]), (100, [3.0]), (200, None), (-100, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, ROWS)
    asked = df.filter("vec_id % 100 = 0")
    assert got(topk.top_k(df, asked)) == sorted(nearest(rows), key=repr)
    more = df.withColumns({n: F.lit("own") for n in ["id", "vector", "sig", "g", "h", "rank", "score", "query_id"]})
    assert got(topk.top_k(more, more.filter("vec_id % 100 = 0"))) == sorted(nearest(rows), key=repr)
    assert topk.top_k(df.limit(0), asked.limit(0)).collect() == [] == topk.top_k(df, asked.limit(0)).collect()
    assert got(topk.top_k(df, asked, k=2)) == sorted(nearest(rows, k=2), key=repr)


def test_scores_beyond_64_bits_end_at_the_greatest_long(spark):
    df = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 1.0]), (2, [-1e15, 1.0]), (3, [1e30, 0.0])], "vec_id long, embedding array<double>")
    rows = got(topk.top_k(df, df.filter("vec_id = 0")).select("vec_id", "score"))
    assert rows == [(1, 2**63 - 1), (2, -(2**63)), (3, 2**63 - 1)]


def test_long_vectors_of_few_terms(spark):
    rows = [(k, [0.0] * 20_000 + [float(k % 7)] + [0.0] * (k % 5)) for k in range(0, 60, 2)]
    df = spark.createDataFrame(rows, ROWS)
    assert got(topk.top_k(df, df.filter("vec_id = 50"))) == sorted(nearest(rows, asked=lambda i: i == 50), key=repr)


def test_selection_breaks_ties_by_slot():
    scores = np.array([3, 5, 5, 1, 5, 3])
    assert topk.select(scores, 2).tolist() == [1, 2] and topk.select(scores, 4).tolist() == [1, 2, 4, 0] and topk.select(scores, 9).tolist() == [1, 2, 4, 0, 5, 3]
