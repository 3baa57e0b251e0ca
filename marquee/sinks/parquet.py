"""Parquet sinks for the joined movie table and the nested yearly summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import MOVIES, SUMMARY


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the declared columns, in order and cast to their types; a column it lacks is NULL."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def write_movies_parquet(movies: DataFrame, path: str, cluster_by_type: bool = True) -> str:
    """Write the joined table (genres as a list column), columns in model order.

    Every query reads movies only, so each task's output is sorted by (type,
    tconst) before writing: a task-local sort, no shuffle. Row groups and
    pages then hold one type each, and the pushed ``type = 'movie'`` filter
    skips the others from their min/max statistics. (Directory partitioning
    by type would turn an empty type into NULL, so values are kept as is.)
    """
    table = conformed(movies, MOVIES)
    if cluster_by_type:
        table = table.sortWithinPartitions("type", "tconst")
    table.write.mode("overwrite").parquet(path)
    return path


def write_summary_parquet(summary: DataFrame, path: str) -> str:
    """Write one nested row per year."""
    conformed(summary, SUMMARY).write.mode("overwrite").parquet(path)
    return path
