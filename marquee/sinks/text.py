"""Text sinks: tab-separated lines, written by the tasks in parallel.

Sinks of small results and the recommendations order their rows over all files
(range partitioning), so the part files read in sequence give the ordered result;
the join dumps are in key order within each file. Nothing is funnelled into one
task or one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import format_row
from ..operators.ordering import order_by_group_key, order_group_then_rank, order_recommendations

# Fixed value: the literal between a movie and its recommendation.
RECOMMENDED = "RECOMMENDED:"


def write_lines(lines: DataFrame, path: str, compression: str | None = None) -> str:
    """Write a one-column (``value``) DataFrame as text lines."""
    writer = lines.select("value").write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)
    return path


def kv_lines(df: DataFrame, key: str, values: list[str | Column]) -> DataFrame:
    """``key\\tvalue...`` lines, NULLs printed as ``null``; ordered by key, NULL last."""
    ordered = order_by_group_key(df, key)
    return ordered.select(format_row(key, *values).alias("value"))


def keyed_lines(df: DataFrame, key: str, values: list[str | Column]) -> DataFrame:
    """``key\\tvalue...`` lines sorted by key within each output file.

    For the join dumps, whose output grows with the input: like a reducer's
    part file, each file is in key order, without a second, global shuffle.
    After a sort-merge join on ``key`` the rows already arrive in that order and
    Spark drops the sort.
    """
    return df.sortWithinPartitions(key).select(format_row(key, *values).alias("value"))


def ranked_lines(df: DataFrame, group: str) -> DataFrame:
    """``group\\ttconst\\ttitle\\trating\\tvotes`` lines in group-then-rank order."""
    ordered = order_group_then_rank(df, group)
    return ordered.select(format_row(group, "tconst", "title", "rating", "votes").alias("value"))


def recommendation_lines(recs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``tconst\\ttitle\\tgenre\\trating\\tvotes\\tRECOMMENDED:\\trec...`` lines in tconst order over all files.

    The output grows with the input. With ``keys``, a cheap table of the ids, the
    ranges of the files are known beforehand and the recommendations are
    evaluated once; without, the sort evaluates them a first time to sample.
    """
    ordered = order_recommendations(recs, keys)
    return ordered.select(
        format_row(
            "tconst",
            "title",
            "genre",
            "rating",
            "votes",
            F.lit(RECOMMENDED),
            "rec_tconst",
            "rec_title",
            "rec_rating",
            "rec_votes",
        ).alias("value")
    )


def write_kv_text(df: DataFrame, path: str, key: str, values: list[str | Column]) -> str:
    return write_lines(kv_lines(df, key, values), path)


def write_ranked_text(df: DataFrame, path: str, group: str) -> str:
    return write_lines(ranked_lines(df, group), path)


def write_recommendation_text(recs: DataFrame, path: str, keys: DataFrame | None = None) -> str:
    return write_lines(recommendation_lines(recs, keys), path)


def write_report_text(report: DataFrame, path: str) -> str:
    """The yearly report: one text block per year, years ascending, NULL last."""
    ordered = order_by_group_key(report, "year")
    return write_lines(ordered.select(F.col("report").alias("value")), path)
