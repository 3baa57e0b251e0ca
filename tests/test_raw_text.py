"""Jobs 1-3 keep the raw text, give one row per id, and plan as intended."""

import re

from pyspark.sql import functions as F

from marquee.operators import join_movies_ratings, join_titles_ratings
from marquee.plans import jobs
from marquee.schemas import MOVIES
from marquee.sources.parquet import read_movies_parquet
from marquee.sources.tsv import read_ratings_raw, read_titles_raw

TITLES = [
    "tt1\tmovie\tA\tA\t0\t19??\t2001\t90 min\tDrama,\\N",
    "tt2\tmovie\tB\tB\t0\t2000\t\\N\t100\t\\N",
    "tt2\tmovie\tB two\tB\t0\t2000\t\\N\t100\t\\N",
    "tt3\tshort\tC\tC\t0\t2000\t\\N\t007\tComedy",
    "\tmovie\tno id 2\tno id\t0\t1999\t\\N\t\\N\tDrama",
    "\tmovie\tno id 1\tno id\t0\t1999\t\\N\t\\N\tDrama",
]
RATINGS = ["tt1\t7.50\t3000000000", "tt2\t5.0\t10", "tt2\t9.0\t9", "tt2\t4.0\t10", "tt3\t8.1\t12x", "\t6.0\t3", "tt9\t1.0\t1"]


def inputs(tmp_path):
    titles, ratings = tmp_path / "t.tsv", tmp_path / "r.tsv"
    titles.write_text("\n".join(["h\t" * 8 + "h", *TITLES]) + "\n", encoding="utf-8")
    ratings.write_text("\n".join(["h\th\th", *RATINGS]) + "\n", encoding="utf-8")
    return str(titles), str(ratings)


def lines(spark, path):
    return sorted(r.value for r in spark.read.text(path).collect())


def test_text_dumps_print_raw_text_once_per_id(spark, tmp_path):
    t, r = inputs(tmp_path)
    narrow = lines(spark, jobs.run_movies_text(spark, t, r, str(tmp_path / "j1")))
    assert narrow == ["\tno id\t1999\tDrama\t6.0\t3", "tt1\tA\t19??\tDrama,null\t7.50\t3000000000", "tt2\tB\t2000\tnull\t5.0\t10"]
    wide = lines(spark, jobs.run_titles_text(spark, t, r, str(tmp_path / "j2")))
    assert wide == [
        "\tmovie\tno id 1\tno id\t0\t1999\tnull\tnull\tDrama\t6.0\t3",
        "tt1\tmovie\tA\tA\t0\t19??\t2001\t90 min\tDrama,null\t7.50\t3000000000",
        "tt2\tmovie\tB\tB\t0\t2000\tnull\t100\tnull\t5.0\t10",
        "tt3\tshort\tC\tC\t0\t2000\tnull\t007\tComedy\t8.1\t12x",
    ]


def test_movie_table_keeps_what_does_not_parse(spark, tmp_path):
    movies = read_movies_parquet(spark, jobs.run_build_movies(spark, *inputs(tmp_path), str(tmp_path / "m")))
    assert [(f.name, f.dataType) for f in movies.schema] == [(f.name, f.dataType) for f in MOVIES]
    rows = {r.tconst: r for r in movies.collect()}
    assert len(rows) == 4 == movies.count()
    assert rows["tt1"].unparsed == {"startYear": "19??", "time": "90 min"} and rows["tt1"].votes == 3000000000
    assert rows["tt3"].unparsed == {"votes": "12x"} and rows["tt3"].time == 7
    assert rows["tt2"].unparsed is None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_one_exchange_per_side(spark, tmp_path):
    t, r = inputs(tmp_path)
    for n in (None, 3):
        titles, ratings = read_titles_raw(spark, t, n), read_ratings_raw(spark, r, n)
        for joined in (join_titles_ratings(titles, ratings), join_movies_ratings(titles, ratings)):
            assert exchanges(joined) == 2 and "SortMergeJoin" in plan(joined)
            assert plan(joined).count("WindowGroupLimit") >= 2  # repeated ids are cut before the shuffle


def test_type_filter_reaches_the_text_scan(spark, tmp_path):
    t, _ = inputs(tmp_path)
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(type,movie\)", plan(read_titles_raw(spark, t, kind="movie")))
    assert read_titles_raw(spark, t, kind="").count() == 0


def test_winner_of_repeated_ratings_for_text_and_numbers(spark):
    text = spark.createDataFrame([("a", "9", "9"), ("a", "10", "9"), ("b", "x", "y"), ("b", None, None)], "tconst string, rating string, votes string")
    titles = spark.createDataFrame([("a",), ("b",)], "tconst string").select(
        "tconst", *(F.lit("x").alias(c) for c in ("type", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear", "time")), F.array(F.lit("g")).alias("genres")
    )
    got = {r.tconst: (r.rating, r.votes) for r in join_titles_ratings(titles, text).collect()}
    assert got == {"a": ("10", "9"), "b": ("x", "y")}
