"""Per-year aggregates: count, most-voted movie, ordered top list, yearly summary.

The count is a hash aggregate, combined map-side: one row per year and map
partition crosses the shuffle, however many movies a year holds. The most-voted
movie is a ranked cut to one row per year before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import default_minus_one, effective_year
from ..schemas import MOVIE
from .filters import filter_movies
from .topn import top_n_per_group


def movies_per_year(movies: DataFrame, kind: str = MOVIE) -> DataFrame:
    """Number of movies per year, the year being startYear or else endYear: (year, count)."""
    return (
        filter_movies(movies, kind)
        .groupBy(effective_year().alias("year"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def most_voted_per_year(movies: DataFrame, kind: str = MOVIE, fan_in: int | None = None) -> DataFrame:
    """Most-voted movie of each startYear: (year, tconst, title, votes).

    Every movie takes part, rated or not, so a year whose movies have no votes
    still returns one, with votes -1; ties go to the smallest id. One scan: an
    arg-max over text does not fit a hash aggregate's buffer, and a join back to
    the highest vote reads the movies twice; the cut keeps one row per year and
    map partition before the shuffle.
    """
    votes = default_minus_one("votes").cast("bigint")
    m = filter_movies(movies, kind).select(F.col("startYear").alias("year"), "tconst", F.col("originalTitle").alias("title"), votes.alias("votes"))
    best = top_n_per_group(m, ["year"], [F.col("votes").desc(), F.col("tconst").asc()], 1, fan_in=fan_in)
    return best.select("year", "tconst", "title", "votes")


def ordered_top_list(
    ranked: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    rank_col: str = "rank",
    name: str = "top",
) -> DataFrame:
    """Collect each group's already-cut rows into one list ordered by ``rank_col``.

    Input must be bounded per group (output of ``top_n_per_group``), so each
    list holds at most n entries.
    """
    entry = F.struct(F.col(rank_col).alias("_rank"), *[F.col(f) for f in fields])
    collected = F.array_sort(F.collect_list(entry))
    return ranked.groupBy(*keys).agg(
        F.transform(collected, lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias(name)
    )


def _ranked_twice(movies: DataFrame, n: int, fan_in: int | None) -> DataFrame:
    """One pass for both rankings: (year, by_rating, rank, tconst, originalTitle, rating, votes).

    Each movie is a candidate for its year's most-voted one and, if rated, for the
    top list; a flag in the group key keeps the two rankings apart, so one sort and
    one cut before the shuffle serve both. Ranks above 1 by votes are left over.
    """
    votes = default_minus_one("votes").cast("bigint")
    both = F.when(F.col("rating").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    m = movies.select(F.col("startYear").alias("year"), "tconst", "originalTitle", "rating", votes.alias("votes"), F.explode(both).alias("by_rating"))
    order = [F.when(F.col("by_rating"), F.col("rating")).desc_nulls_last(), F.col("votes").desc(), F.col("tconst").asc()]
    return top_n_per_group(m, ["year", "by_rating"], order, n, fan_in=fan_in)


def yearly_summary(movies: DataFrame, kind: str = MOVIE, n: int = 10, fan_in: int | None = None) -> DataFrame:
    """One row per startYear: movie count, most-voted movie, ordered top-n list.

    (year, number_of_movies, tconst_most_votes, title_most_votes,
    number_of_votes, top10 array<struct<tconst, originalTitle, rating, votes>>)

    Two scans (pass a written table, not a lazy join): the count reads the year
    alone and aggregates map-side; the most-voted movie and the top list come from
    one ranked pass, cut before its shuffle. They meet in a null-safe join of one
    row per year on each side (years without a rated movie get an empty list).
    ``fan_in`` is passed to the cut (see ``top_n_per_group``).
    """
    m = filter_movies(movies, kind)
    counts = m.groupBy(F.col("startYear").alias("_year")).agg(F.count(F.lit(1)).alias("number_of_movies"))
    ranked = _ranked_twice(m, max(1, n), fan_in)
    entry = F.struct("rank", "tconst", "originalTitle", "rating", "votes")
    per_year = ranked.groupBy("year").agg(
        F.min(F.when(~F.col("by_rating") & (F.col("rank") == 1), entry)).alias("best"),
        F.array_sort(F.collect_list(F.when(F.col("by_rating") & (F.col("rank") <= n), entry))).alias("listed"),
    )
    joined = counts.join(per_year, F.col("_year").eqNullSafe(F.col("year")))
    return joined.select(
        "year",
        "number_of_movies",
        F.col("best.tconst").alias("tconst_most_votes"),
        F.col("best.originalTitle").alias("title_most_votes"),
        F.col("best.votes").alias("number_of_votes"),
        F.transform("listed", lambda e: F.struct(*[e[f].alias(f) for f in ("tconst", "originalTitle", "rating", "votes")])).alias("top10"),
    )
