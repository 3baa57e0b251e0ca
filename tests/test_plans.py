"""The physical plans have the shape the design relies on at scale."""

import re

import pytest
from pyspark.sql import functions as F

from marquee.operators import most_voted_per_year, movies_per_year, recommend_by_genre, top10_rated_per_year, yearly_summary
from marquee.operators.filters import filter_movies
from marquee.operators.ordering import range_bounds, range_id
from marquee.sinks.parquet import write_movies_parquet
from marquee.sinks.text import recommendation_lines, write_recommendation_text
from marquee.sources import driver as D
from marquee.sources.parquet import read_movies_parquet

from .conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def movies_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "movies")
    return write_movies_parquet(D.order_movies(spark, SF_SMALL), path)


def test_type_filter_and_projection_reach_the_scan(spark, movies_path):
    df = movies_per_year(read_movies_parquet(spark, movies_path, "movies_per_year"), "F")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(type), EqualTo(type,F)]" in p
    assert "ReadSchema: struct<type:string,startYear:int,endYear:int>" in p
    # count is aggregated map-side before the shuffle
    assert "partial_count" in p


def test_topn_cuts_before_the_shuffle(spark, movies_path):
    df = top10_rated_per_year(read_movies_parquet(spark, movies_path, "top10_rated_per_year"), "F")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 10, Partial" in p and "row_number(), 10, Final" in p
    partial = p.index("row_number(), 10, Partial")
    final = p.index("row_number(), 10, Final")
    # the tree prints top-down: the Final limit sits above the Exchange, the Partial below it
    assert final < p.index("Exchange hashpartitioning", final) < partial


def scans(df) -> int:
    return len(re.findall(r"FileScan parquet", plan(df)))


def test_summary_reads_the_movies_twice(spark, movies_path):
    df = yearly_summary(read_movies_parquet(spark, movies_path, "yearly_summary"), "F")
    p = plan(df)
    # the count is a hash aggregate over the years alone; both rankings share one pass
    assert re.search(r"HashAggregate\(keys=\[startYear[^\n]*partial_count\(1\)", p)
    assert scans(df) == 2 and "ReadSchema: struct<type:string,startYear:int>" in p
    assert p.count("row_number(), 10, Partial") == 1


def test_most_voted_is_one_scan_cut_before_the_shuffle(spark, movies_path):
    df = most_voted_per_year(read_movies_parquet(spark, movies_path, "most_voted_per_year"), "F")
    assert scans(df) == 1 and "row_number(), 1, Partial" in plan(df) and "Join" not in plan(df)


def test_recommendations_are_in_order_over_all_files(spark, movies_path, tmp_path):
    movies = read_movies_parquet(spark, movies_path, "by_genre")
    out = write_recommendation_text(recommend_by_genre(movies, "F"), str(tmp_path / "recs"), filter_movies(movies, "F"))
    files = sorted(tmp_path.glob("recs/part-*.txt"))
    ids = [line.split("\t")[0] for f in files for line in f.read_text(encoding="utf-8").splitlines()]
    assert len(files) > 1 and ids and ids == sorted(ids)
    sizes = [len(f.read_text(encoding="utf-8").splitlines()) for f in files]
    assert max(sizes) < 3 * sum(sizes) / len(sizes)
    # the ranges come from the ids: the recommendations are evaluated once
    lines = recommendation_lines(recommend_by_genre(movies, "F"), filter_movies(movies, "F"))
    assert "rangepartitioning" not in plan(lines)


def test_range_ids_follow_the_order(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), ("b",), ("bb",), ("c",), ("z",)], "k string")
    for bounds in ([], ["b"], ["a", "b", "c"], ["", "a", "b", "bb", "c", "y", "z"]):
        got = [(r.k, r.i) for r in df.select("k", range_id(F.col("k"), bounds).alias("i")).collect()]
        assert got == [(k, 0 if k is None else sum(b <= k for b in bounds)) for k, _ in got]
    assert range_bounds(df.limit(0), "k", 8) == [] and len(range_bounds(df, "k", 3)) <= 2
    numbers = spark.range(20_000).withColumnRenamed("id", "k")
    cuts = range_bounds(numbers, "k", 8)
    sizes = [r["count"] for r in numbers.groupBy(range_id(F.col("k"), cuts)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8


def test_recommendation_broadcasts_checked_side(spark, movies_path):
    movies = spark.read.parquet(movies_path)
    df = recommend_by_genre(movies, "F")
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in p
    salted = recommend_by_genre(movies, "F", max_broadcast_rows=0)
    salted.collect()
    assert "_salt" in salted._jdf.queryExecution().executedPlan().toString()


def test_movie_table_skips_other_types(spark, tmp_path):
    # The product's writer (write_movies_parquet) with small row groups standing
    # in for a large table: the type filter must skip other types' row groups
    # at the scan, and results must not change.
    movies = D.order_movies(spark, "/root/testdata/sf0.01")
    path = str(tmp_path / "clustered")
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    before = hconf.get("parquet.block.size")
    hconf.set("parquet.block.size", str(64 * 1024))
    try:
        write_movies_parquet(movies, path)
    finally:
        if before is None:
            hconf.unset("parquet.block.size")
        else:
            hconf.set("parquet.block.size", before)
    df = movies_per_year(read_movies_parquet(spark, path, "movies_per_year"), "F")
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    plan = qe.executedPlan().toString()
    assert "EqualTo(type,F)" in plan
    scanned = 0

    def walk(node):
        yield node
        if "QueryStage" in node.nodeName():
            yield from walk(node.plan())
            return
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    root = qe.executedPlan()
    root = root.executedPlan() if root.nodeName().startswith("AdaptiveSparkPlan") else root
    for node in walk(root):
        if node.nodeName().startswith("Scan parquet"):
            scanned += int(node.metrics().get("numOutputRows").get().value())
    total = movies.count()
    movies_only = movies.where("type = 'F'").count()
    assert movies_only <= scanned < total  # other types' row groups were never decoded
    expect = sorted(map(tuple, movies_per_year(movies, "F").collect()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == expect
