
import pytest
from pyspark.sql import functions as F

from marquee.operators import (
    filter_movies,
    most_voted_per_year,
    movies_per_year,
    recommend_by_genre,
    top2_rated_per_genre,
    top10_rated_per_year,
    yearly_summary,
)
from marquee.sources import driver as D

from .conftest import SF_SMALL

FT, PT = D.ORDER_MOVIE_TYPE, D.PART_MOVIE_TYPE


@pytest.fixture(scope="module")
def om(spark):
    return D.order_movies(spark, SF_SMALL).cache()


@pytest.fixture(scope="module")
def pm(spark):
    return D.part_movies(spark, SF_SMALL).cache()


def test_left_join_keeps_titles(spark, om):
    titles = D.order_titles(spark, SF_SMALL)
    ids = titles.select("tconst").distinct()
    assert titles.count() > ids.count()  # the stand-in repeats some lines
    assert om.count() == ids.count() == om.select("tconst").distinct().count()
    assert om.join(ids, "tconst", "left_anti").isEmpty()  # ratings without a title vanish


def test_counts_add_up(om):
    total = movies_per_year(om, FT).agg(F.sum("count")).first()[0]
    assert total == filter_movies(om, FT).count()


def test_summary_matches_its_parts(om):
    summary = {r.year: r for r in yearly_summary(om, FT).collect()}
    by_start = {r.startYear: r["count"] for r in filter_movies(om, FT).groupBy("startYear").count().collect()}
    assert {y: r.number_of_movies for y, r in summary.items()} == by_start
    best = {r.year: (r.tconst, r.votes) for r in most_voted_per_year(om, FT).collect()}
    assert {y: (r.tconst_most_votes, r.number_of_votes) for y, r in summary.items()} == best
    top = {}
    for r in sorted(top10_rated_per_year(om, FT).collect(), key=lambda r: r["rank"]):
        top.setdefault(r.year, []).append(r.tconst)
    assert {y: [e.tconst for e in r.top10] for y, r in summary.items() if r.top10} == top
    assert None in summary  # the unknown-year group is kept


def test_at_most_k_per_group(om, pm):
    assert top10_rated_per_year(om, FT).groupBy("year").count().agg(F.max("count")).first()[0] <= 10
    assert top2_rated_per_genre(pm, PT).groupBy("genre").count().agg(F.max("count")).first()[0] <= 2


def test_year_definitions_differ(om):
    # movies_per_year falls back to endYear; the others group by startYear only.
    per_year = {r.year: r["count"] for r in movies_per_year(om, FT).collect()}
    by_start = {r.startYear: r["count"] for r in filter_movies(om, FT).groupBy("startYear").count().collect()}
    assert 0 < per_year[None] < by_start[None]  # both years missing, against startYear alone
    assert None in {r.year for r in most_voted_per_year(om, FT).collect()}


def test_no_self_recommendation(pm):
    recs = recommend_by_genre(pm, PT)
    assert recs.where(F.col("tconst") == F.col("rec_tconst")).count() == 0
    assert recs.count() == recs.select("tconst").distinct().count()


def test_salted_fallback_equals_broadcast(pm):
    a = sorted(map(tuple, recommend_by_genre(pm, PT).collect()))
    b = sorted(map(tuple, recommend_by_genre(pm, PT, max_broadcast_rows=0).collect()))
    assert a == b and len(a) > 0


def test_byte_bound_alone_forces_the_salted_join(pm):
    from marquee.operators.broadcast import checked_broadcast_join, materialize
    from marquee.operators.recommend import genre_candidates

    cands = genre_candidates(pm, PT)
    _, rows, size, _ = materialize(cands, "probe")
    assert rows > 0 and size > rows * 10  # serialised bytes, not a row count
    targets = with_genre_targets(pm)
    broadcast = checked_broadcast_join(targets, cands, ["genre"])
    salted = checked_broadcast_join(targets, cands, ["genre"], max_bytes=size - 1)
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, broadcast.collect())) == sorted(map(repr, salted.collect()))


def with_genre_targets(pm):
    from marquee.operators import filter_has_genre, with_genre

    return filter_has_genre(with_genre(filter_movies(pm, PT))).select("tconst", "genre")
