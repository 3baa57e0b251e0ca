"""Top-n rows per group (ten best per year, two best per genre).

``row_number() <= n`` over a group window is planned by Spark as a partial
WindowGroupLimit on every map partition, a shuffle, and a final
WindowGroupLimit. The partial step cuts each group to n rows *before* the
shuffle, so a group holding a third of all rows still sends at most n rows
per map partition; no task ever holds a whole group.

The sort order must be total for the result to be deterministic under ties,
so the title id is always the last sort key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import default_minus_one
from ..schemas import MOVIE
from .filters import filter_has_genre, filter_movies, filter_rated, with_genre


def best_rated_order(rating: str = "rating", votes: str = "votes", tconst: str = "tconst") -> list[Column]:
    """Rating descending, then votes descending (missing as -1), then id ascending."""
    return [F.col(rating).desc(), default_minus_one(votes).desc(), F.col(tconst).asc()]


# Input files from which a fan-in round pays for its additional shuffle.
FAN_IN_FROM = 4096


def fan_in_for(df: DataFrame) -> int | None:
    """The square root of the number of input files, or None for inputs of few files."""
    files = len(df.inputFiles())
    return math.isqrt(files) if files >= FAN_IN_FROM else None


def top_n_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank_col: str = "rank",
    salt_by: Sequence[str] = ("tconst",),
    buckets: int | None = None,
    fan_in: int | None = None,
) -> DataFrame:
    """The first ``n`` rows of each ``keys`` group under ``order``, numbered 1..n in ``rank_col``.

    A group with fewer rows keeps them all; NULL keys form a group of their own.
    Spark inserts the partial (pre-shuffle) limit only for ``n`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``; above it, the rows are
    first cut within (group, salt) buckets, as many as shuffle partitions, salt =
    hash of ``salt_by`` (the rows of one group spread over every bucket), so the final ranking sees at
    most n rows per bucket of a group. Both ways give the same, exact result.

    ``fan_in`` (optional, e.g. the square root of the input partition count)
    adds a first round ranked within (group, input partition mod ``fan_in``):
    each input partition falls in one bucket, so a task of that round hears
    from only 1/``fan_in`` of the map tasks, and the final ranking of a group
    sees at most n x ``fan_in`` rows, instead of n x (map partitions).
    """
    spark = df.sparkSession
    if fan_in:
        part = F.pmod(F.spark_partition_id(), F.lit(fan_in))
        w0 = Window.partitionBy(*keys, F.col("_part")).orderBy(*order)
        df = df.withColumn("_part", part).withColumn("_r0", F.row_number().over(w0)).where(F.col("_r0") <= n)
        df = df.drop("_part", "_r0")
    threshold = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > threshold:
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        salt = F.pmod(F.xxhash64(*salt_by), F.lit(max(1, buckets)))
        w1 = Window.partitionBy(*keys, F.col("_bucket")).orderBy(*order)
        df = df.withColumn("_bucket", salt).withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n)
        df = df.drop("_bucket", "_r")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def top10_rated_per_year(movies: DataFrame, kind: str = MOVIE, n: int = 10, fan_in: int | None = None) -> DataFrame:
    """Ten best-rated movies of each startYear: (year, rank, tconst, title, rating, votes).

    Unrated movies are left out; a year with none disappears. Votes print as -1
    when missing.
    """
    rated = filter_rated(filter_movies(movies, kind)).select(
        F.col("startYear").alias("year"),
        "tconst",
        F.col("originalTitle").alias("title"),
        "rating",
        default_minus_one("votes").alias("votes"),
    )
    return top_n_per_group(rated, ["year"], best_rated_order(), n, fan_in=fan_in).select(
        "year", "rank", "tconst", "title", "rating", "votes"
    )


def top2_rated_per_genre(movies: DataFrame, kind: str = MOVIE, n: int = 2, fan_in: int | None = None) -> DataFrame:
    """Two best-rated movies of each first genre: (genre, rank, tconst, title, rating, votes)."""
    rated = filter_rated(filter_has_genre(with_genre(filter_movies(movies, kind)))).select(
        "genre",
        "tconst",
        F.col("originalTitle").alias("title"),
        "rating",
        default_minus_one("votes").alias("votes"),
    )
    return top_n_per_group(rated, ["genre"], best_rated_order(), n, fan_in=fan_in).select(
        "genre", "rank", "tconst", "title", "rating", "votes"
    )
