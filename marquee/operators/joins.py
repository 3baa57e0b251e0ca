"""Title-rating joins, one output row per title id.

The raw files may repeat an id. Each side is first cut to one row per id by a
ranking window: Spark cuts each map task's rows before the shuffle (partial
group limit), so an id carried by a third of all lines sends one row per task.
The window's exchange and sort on ``tconst`` are those of the sort-merge join,
so neither side is shuffled again. The join is pinned to that form (``merge``
hint): it spills instead of failing and collects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import join_genres
from ..schemas import MOVIE, MOVIES_COLUMNS
from .filters import filter_movies


def one_per_id(df: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each ``tconst`` under ``order``."""
    rank = F.row_number().over(Window.partitionBy("tconst").orderBy(*order))
    return df.withColumn("_nth", rank).where(F.col("_nth") == 1).drop("_nth")


def one_title(titles: DataFrame) -> DataFrame:
    """One line per title id: the first in the order of the other columns, missing values first."""
    others = [join_genres(c) if c == "genres" else F.col(c) for c in titles.columns if c != "tconst"]
    return one_per_id(titles, [c.asc_nulls_first() for c in others])


def one_rating(ratings: DataFrame) -> DataFrame:
    """One line per rated id: most votes, then best rating (text that is no number last)."""
    votes, rating = F.col("votes"), F.col("rating")
    numbers = [votes.try_cast("bigint"), rating.try_cast("double")]
    order = [c.desc_nulls_last() for c in (*numbers, votes, rating)]
    return one_per_id(ratings.select("tconst", "rating", "votes"), order).hint("merge")


def join_titles_ratings(titles: DataFrame, ratings: DataFrame) -> DataFrame:
    """Every title id, with its rating and votes when a rating line exists.

    Rating lines without a title vanish; titles without one get NULL rating and
    votes. Output columns follow the movie table's order. The inputs may be
    typed or raw text.
    """
    return one_title(titles).join(one_rating(ratings), on="tconst", how="left").select(*MOVIES_COLUMNS)


def join_movies_ratings(titles: DataFrame, ratings: DataFrame, kind: str = MOVIE) -> DataFrame:
    """Movies only, narrow: (tconst, originalTitle, startYear, genres, rating, votes).

    The type filter runs before the join, so only movies are shuffled.
    """
    movies = filter_movies(titles, kind).select("tconst", "originalTitle", "startYear", "genres")
    return one_title(movies).join(one_rating(ratings), on="tconst", how="left")
