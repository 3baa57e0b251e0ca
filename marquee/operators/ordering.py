"""Output orders of the text results. A global sort is range-partitioned by
Spark (sampled bounds, one sorted range per task), never a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import default_minus_one

# Keys sampled for each range: as many as keep the ranges within some tenths of even.
SAMPLED_PER_RANGE = 64


def order_by_group_key(df: DataFrame, key: str) -> DataFrame:
    """Group key ascending, the NULL group last."""
    return df.orderBy(F.col(key).asc_nulls_last())


def order_group_then_rank(df: DataFrame, key: str) -> DataFrame:
    """Group ascending (NULL last), then rating desc, votes desc, id asc."""
    return df.orderBy(
        F.col(key).asc_nulls_last(),
        F.col("rating").desc(),
        default_minus_one("votes").desc(),
        F.col("tconst").asc(),
    )


def range_bounds(keys: DataFrame, key: str, ranges: int, per_range: int = SAMPLED_PER_RANGE) -> list:
    """At most ``ranges - 1`` ascending keys that cut ``keys`` into about equal ranges.

    Reads the key column alone. The sample is taken by hash, so it does not
    depend on partitions, and about ``ranges * per_range`` keys reach the driver.
    """
    keys = keys.where(F.col(key).isNotNull())
    total = keys.count()
    steps = 1 << 30
    share = min(steps, -(-steps * ranges * per_range // max(1, total)))
    sample = sorted(r[0] for r in keys.where(F.pmod(F.xxhash64(key), F.lit(steps)) < share).select(key).distinct().collect())
    cuts = sorted({len(sample) * k // ranges for k in range(1, ranges)})
    return [sample[c] for c in cuts if 0 < c < len(sample)]


def range_id(key: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are at or below ``key``: a binary search in one expression."""
    if not bounds:
        return F.lit(0)
    held = F.array(*(F.lit(b) for b in bounds))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    further = lambda at, step: F.coalesce(F.get(held, at + step - 1) <= key, F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def order_across(df: DataFrame, key: str, bounds: list) -> DataFrame:
    """``df`` in ``key`` order over all partitions, the ranges given: no sampling pass over ``df``.

    A global sort runs its input a first time to sample its ranges. Where the
    key's spread is known from elsewhere, rows go straight to their range.
    """
    ranged = df.repartitionById(len(bounds) + 1, range_id(F.col(key), bounds).cast("int"))
    return ranged.sortWithinPartitions(F.col(key).asc())


def order_recommendations(df: DataFrame, keys: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """Recommendations by title id, in one order over all partitions.

    ``keys`` (optional) is a cheap table of the ids, e.g. a one-column scan of the
    movies: the ranges are then cut from it, and ``df`` is evaluated only once.
    """
    if keys is None:
        return df.orderBy(F.col("tconst").asc())
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return order_across(df, "tconst", range_bounds(keys, "tconst", ranges))
