"""Row filters. Each is a plain predicate, so Catalyst pushes it as far down as
it goes (``type = 'movie'`` and ``rating IS NOT NULL`` reach the Parquet scan)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import primary_genre
from ..schemas import MOVIE


def filter_movies(df: DataFrame, kind: str = MOVIE) -> DataFrame:
    """Keep titles whose type is exactly ``kind`` (case-sensitive)."""
    return df.where(F.col("type") == F.lit(kind))


def filter_rated(df: DataFrame) -> DataFrame:
    """Drop titles without a rating."""
    return df.where(F.col("rating").isNotNull())


def filter_has_genre(df: DataFrame, column: str = "genre") -> DataFrame:
    """Drop titles without a first genre (``column`` holds it, see ``with_genre``)."""
    return df.where(F.col(column).isNotNull())


def with_genre(df: DataFrame, genres: str = "genres") -> DataFrame:
    """Add ``genre``, the first element of the genre list."""
    return df.withColumn("genre", primary_genre(genres))


def exclude_self(candidates: Column, tconst: Column) -> Column:
    """Candidates of an array of structs whose ``tconst`` differs from this title's.

    For projections. Do not filter on it right after a join: the optimizer can
    move a predicate holding a lambda over an outer column to the wrong join
    side. ``first_other`` is the form to filter on.
    """
    return F.filter(candidates, lambda c: c["tconst"] != tconst)


def first_other(candidates: list[Column], tconst: Column) -> Column:
    """The first candidate, in the given order, that is not the title itself (or NULL).

    Plain CASE expressions, no lambda: it stays in generated code, and a filter on
    it is safe to place anywhere (a lambda over an outer column inside a join
    condition can be misplaced by the optimizer).
    """
    return F.coalesce(*[F.when(c["tconst"] != tconst, c) for c in candidates])

