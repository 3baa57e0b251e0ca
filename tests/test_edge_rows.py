"""The hand-written edge rows through every job, against hand-worked results."""

import os

import pytest

from pyspark.sql import functions as F

from marquee.functions.columns import year_report
from marquee.operators import (
    join_movies_ratings,
    join_titles_ratings,
    most_voted_per_year,
    movies_per_year,
    recommend_by_genre,
    top2_rated_per_genre,
    top10_rated_per_year,
    yearly_summary,
)
from marquee.plans import jobs
from marquee.sources import read_ratings_tsv, read_titles_tsv

from .fixture_rows import (
    EXPECTED_MOST_VOTED,
    EXPECTED_MOVIES_PER_YEAR,
    EXPECTED_RECS,
    EXPECTED_TOP2_GENRE,
    EXPECTED_TOP10,
    write_inputs,
)


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    return write_inputs(str(tmp_path_factory.mktemp("edge")))


@pytest.fixture(scope="module")
def movies(spark, inputs):
    titles, ratings = inputs
    return join_titles_ratings(read_titles_tsv(spark, titles), read_ratings_tsv(spark, ratings)).cache()


def test_titles_parse(spark, inputs):
    rows = {r.tconst: r for r in read_titles_tsv(spark, inputs[0]).collect()}
    assert len(rows) == 12 and "tconst" not in rows  # header skipped
    assert rows["tt02"].originalTitle == '"Q'  # a quote is an ordinary character
    assert rows["tt10"].originalTitle == "back\\slash"
    assert rows["tt12"].originalTitle == ""  # empty text stays empty
    assert rows["tt01"].genres == ["Drama", "Comedy"]
    assert rows["tt04"].genres is None and rows["tt04"].startYear is None
    assert rows["tt10"].genres is None  # empty last field
    assert rows["tt11"].genres is None and rows["tt11"].time is None  # short line
    assert rows["tt05"].startYear is None and rows["tt05"].endYear == 1999
    assert rows["tt01"].time == 90


def test_ratings_parse(spark, inputs):
    rows = {r.tconst: (r.rating, r.votes) for r in read_ratings_tsv(spark, inputs[1]).collect()}
    assert rows["tt01"] == (9.0, 10) and len(rows) == 7


@pytest.mark.parametrize("codec", ["gzip", "bzip2"])
def test_compressed_inputs_equal_plain(spark, inputs, tmp_path, codec):
    titles, ratings = write_inputs(str(tmp_path), codec)
    plain = join_titles_ratings(read_titles_tsv(spark, inputs[0]), read_ratings_tsv(spark, inputs[1]))
    packed = join_titles_ratings(read_titles_tsv(spark, titles), read_ratings_tsv(spark, ratings))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, packed.collect()))


def test_join_keeps_every_title(movies):
    rows = {r.tconst: r for r in movies.collect()}
    assert len(rows) == 12 and "tt99" not in rows
    unrated = {k for k, r in rows.items() if r.rating is None}
    assert unrated == {"tt04", "tt06", "tt07", "tt10", "tt11", "tt12"}


def test_join_movies_only(spark, inputs):
    titles, ratings = inputs
    rows = join_movies_ratings(read_titles_tsv(spark, titles), read_ratings_tsv(spark, ratings)).collect()
    assert {r.tconst for r in rows} == {f"tt{i:02d}" for i in range(1, 13)} - {"tt06"}


def test_movies_per_year(movies):
    assert {r.year: r["count"] for r in movies_per_year(movies).collect()} == EXPECTED_MOVIES_PER_YEAR


def test_most_voted_per_year(movies):
    got = {r.year: (r.tconst, r.title, r.votes) for r in most_voted_per_year(movies).collect()}
    assert got == EXPECTED_MOST_VOTED


def test_top10_rated_per_year(movies):
    got = {}
    for r in sorted(top10_rated_per_year(movies).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.year, []).append(r.tconst)
    assert got == EXPECTED_TOP10


def test_top2_rated_per_genre(movies):
    got = {}
    for r in sorted(top2_rated_per_genre(movies).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.genre, []).append(r.tconst)
    assert got == EXPECTED_TOP2_GENRE


@pytest.mark.parametrize("max_rows", [200_000, 0])
def test_recommend_by_genre(movies, max_rows):
    # max_rows=0 forces the salted shuffle join instead of the broadcast.
    rows = recommend_by_genre(movies, max_broadcast_rows=max_rows).collect()
    assert {r.tconst: r.rec_tconst for r in rows} == EXPECTED_RECS
    r7 = next(r for r in rows if r.tconst == "tt07")
    assert r7.rating is None and r7.rec_rating == 6.0 and r7.rec_votes == 7


def test_yearly_summary(movies):
    rows = {r.year: r for r in yearly_summary(movies).collect()}
    assert {y: r.number_of_movies for y, r in rows.items()} == {2000: 5, 2001: 1, 2002: 2, 2003: 1, None: 2}
    assert {y: (r.tconst_most_votes, r.title_most_votes, r.number_of_votes) for y, r in rows.items()} == (
        EXPECTED_MOST_VOTED
    )
    assert {y: [e.tconst for e in r.top10] for y, r in rows.items() if r.top10} == EXPECTED_TOP10
    assert rows[2002].top10 == [] and rows[2003].top10 == []


def test_year_report_text(spark, movies, tmp_path):
    summary_path = str(tmp_path / "summary")
    yearly_summary(movies).write.parquet(summary_path)
    out = jobs.run_year_report(spark, summary_path, str(tmp_path / "report"))
    text = "".join(
        open(os.path.join(out, f), encoding="utf-8").read() for f in sorted(os.listdir(out)) if f.startswith("part-")
    )
    assert text.startswith("2000\t5\ttt02\t\"Q\t12\nTop 10:\n1- tt02\t\"Q\t9.0\t12\n2- tt01\tA\t9.0\t10\n")
    assert "2002\t2\ttt10\tback\\slash\t-1\nTop 10:\n\n2003" in text
    assert text.endswith("null\t2\ttt05\tE\t5\nTop 10:\n1- tt05\tE\t7.0\t5\n\n")
    blocks = year_report(yearly_summary(movies)).collect()
    assert len(blocks) == 5


def _lines(path):
    return [
        line
        for f in sorted(os.listdir(path))
        if f.startswith("part-")
        for line in open(os.path.join(path, f), encoding="utf-8").read().splitlines()
    ]


def _files(path):
    return [
        open(os.path.join(path, f), encoding="utf-8").read().splitlines()
        for f in sorted(os.listdir(path))
        if f.startswith("part-")
    ]


def test_text_jobs(spark, inputs, tmp_path):
    titles, ratings = inputs
    out = jobs.run_movies_text(spark, titles, ratings, str(tmp_path / "j1"))
    for lines in _files(out):  # each part file is in key order, like a reducer's
        assert lines == sorted(lines, key=lambda s: s.split("\t")[0])
    one = _lines(out)
    assert "tt01\tA\t2000\tDrama,Comedy\t9.0\t10" in one
    assert "tt04\tN\tnull\tnull\tnull\tnull" in one and len(one) == 11
    assert "tt03\tR\t2001\tDrama\t8.0\t5" in one  # a title 'R' is kept
    two = _lines(jobs.run_titles_text(spark, titles, ratings, str(tmp_path / "j2")))
    assert len(two) == 12
    assert "tt06\ttvSeries\tS\tS\t0\t2001\t2003\t30\tSport\tnull\tnull" in two


def test_file_jobs_end_to_end(spark, inputs, tmp_path):
    titles, ratings = inputs
    movies_path = jobs.run_build_movies(spark, titles, ratings, str(tmp_path / "movies"))
    assert spark.read.parquet(movies_path).count() == 12
    per_year = _lines(jobs.run_movies_per_year(spark, movies_path, str(tmp_path / "q1")))
    assert per_year == ["1999\t1", "2000\t5", "2001\t1", "2002\t2", "2003\t1", "null\t1"]
    voted = _lines(jobs.run_most_voted_per_year(spark, movies_path, str(tmp_path / "q2")))
    assert voted[-1] == "null\ttt05\tE\t5"
    top = _lines(jobs.run_top10_rated_per_year(spark, movies_path, str(tmp_path / "q3")))
    assert top[:4] == ["2000\ttt02\t\"Q\t9.0\t12", "2000\ttt01\tA\t9.0\t10", "2000\ttt08\tT1\t6.0\t7", "2000\ttt09\tT2\t6.0\t7"]
    genre = _lines(jobs.run_top2_rated_per_genre(spark, movies_path, str(tmp_path / "g1")))
    assert genre[0] == "Drama\ttt02\t\"Q\t9.0\t12" and len(genre) == 5
    recs = _lines(jobs.run_recommend_by_genre(spark, movies_path, str(tmp_path / "g2")))
    assert recs[0] == "tt01\tA\tDrama\t9.0\t10\tRECOMMENDED:\ttt02\t\"Q\t9.0\t12"
    assert [line.split("\t")[0] for line in recs] == sorted(EXPECTED_RECS)
    assert "tt07\tU\tSport\tnull\tnull\tRECOMMENDED:\ttt08\tT1\t6.0\t7" in recs
    summary_path = jobs.run_yearly_summary(spark, movies_path, str(tmp_path / "s"))
    assert spark.read.parquet(summary_path).count() == 5


def test_ties_are_stable_across_partitionings(spark, movies):
    # Every row in its own input partition (so the tied tt08/tt09 start apart),
    # AQE coalescing off (so 1 and 8 shuffle partitions really differ).
    from pyspark.sql import functions as F

    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {k: spark.conf.get(k) for k in keys}
    ops = (top10_rated_per_year, most_voted_per_year, top2_rated_per_genre, recommend_by_genre, yearly_summary)
    results = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spread = movies.repartitionByRange(12, "tconst")
        where = {r.tconst: r.p for r in spread.select("tconst", F.spark_partition_id().alias("p")).collect()}
        assert where["tt08"] != where["tt09"]
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append([sorted(map(repr, op(spread).collect())) for op in ops])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert results[0] == results[1]

def test_extra_fields_and_blank_lines(spark, tmp_path):
    # more fields than the layout: the extra ones are ignored; blank lines are skipped
    path = tmp_path / "extra.tsv"
    path.write_text(
        "h1\th2\th3\th4\th5\th6\th7\th8\th9\n"
        "tt1\tmovie\tA\tA\t0\t1999\t\\N\t80\tDrama\textra\tmore\n"
        "\n"
        "tt2\tmovie\tB\tB\t0\t2001\t\\N\t\\N\t\\N,Comedy\r\n",
        encoding="utf-8",
    )
    rows = {r.tconst: r for r in read_titles_tsv(spark, str(path)).collect()}
    assert set(rows) == {"tt1", "tt2"}
    assert rows["tt1"].genres == ["Drama"] and rows["tt1"].time == 80
    assert rows["tt2"].genres == [None, "Comedy"]  # a missing element stays in place as NULL
    assert rows["tt2"].startYear == 2001


def test_unparsable_numbers_become_null(spark, tmp_path):
    titles = tmp_path / "t.tsv"
    titles.write_text(
        "h\th\th\th\th\th\th\th\th\n"
        "tt1\tmovie\tA\tA\t0\tabc\t\\N\t9x\tDrama\n"
        "tt2\tmovie\tB\tB\t0\t2001\t\\N\t90\tDrama\n",
        encoding="utf-8",
    )
    ratings = tmp_path / "r.tsv"
    ratings.write_text("h\th\th\ntt1\tx\t5\ntt2\t7.5\tmany\n", encoding="utf-8")
    movies = join_titles_ratings(read_titles_tsv(spark, str(titles)), read_ratings_tsv(spark, str(ratings)))
    rows = {r.tconst: r for r in movies.collect()}
    assert rows["tt1"].startYear is None and rows["tt1"].time is None and rows["tt1"].rating is None
    assert rows["tt1"].votes == 5
    assert rows["tt2"].rating == 7.5 and rows["tt2"].votes is None
    # a rated movie with unparsable votes ranks and prints with -1
    assert [(r.tconst, r.votes) for r in top10_rated_per_year(movies).collect()] == [("tt2", -1)]


def test_extreme_votes_and_id_less_ratings(spark, tmp_path):
    titles = tmp_path / "t.tsv"
    titles.write_text(
        "h\th\th\th\th\th\th\th\th\n"
        "tt1\tmovie\tA\tA\t0\t2000\t\\N\t\\N\tDrama\n"
        "\tmovie\tB\tB\t0\t2000\t\\N\t\\N\tDrama\n"
        "\tmovie\tC\tC\t0\t2000\t\\N\t\\N\tDrama\n",
        encoding="utf-8",
    )
    ratings = tmp_path / "r.tsv"
    ratings.write_text("h\th\th\ntt1\t5.0\t-2147483648\n\t9.0\t10\n\t8.0\t11\n", encoding="utf-8")
    movies = join_titles_ratings(read_titles_tsv(spark, str(titles)), read_ratings_tsv(spark, str(ratings)))
    rows = movies.collect()
    # the empty id is an id like others: one title, and the rating line with most votes
    assert sorted((r.tconst, r.primaryTitle, r.rating, r.votes) for r in rows) == [("", "B", 8.0, 11), ("tt1", "A", 5.0, -2147483648)]
    best = most_voted_per_year(movies.where("tconst = 'tt1'").union(movies.where("tconst = ''").withColumn("votes", F.lit(None).cast("bigint"))))
    assert [(r.year, r.votes) for r in best.collect()] == [(2000, -1)]


def test_salted_fallback_refuses_inexact_join_types(spark):
    import pytest

    from marquee.operators.broadcast import checked_broadcast_join

    big = spark.range(10).withColumnRenamed("id", "k").withColumn("tconst", F.col("k").cast("string"))
    small = spark.range(5).withColumnRenamed("id", "k")
    for max_rows in (0, 100):  # refused whatever the size of the small side
        with pytest.raises(ValueError):
            checked_broadcast_join(big, small, ["k"], how="right", max_rows=max_rows)


def test_genres_job_ranks_once_and_matches_separate_jobs(spark, inputs, tmp_path):
    titles, ratings = inputs
    movies_path = jobs.run_build_movies(spark, titles, ratings, str(tmp_path / "movies"))
    top_out, recs_out = jobs.run_genres(spark, movies_path, str(tmp_path / "g"))
    assert _lines(top_out) == _lines(jobs.run_top2_rated_per_genre(spark, movies_path, str(tmp_path / "g9")))
    assert _lines(recs_out) == _lines(jobs.run_recommend_by_genre(spark, movies_path, str(tmp_path / "g10")))
