"""The user-visible jobs, file to file, as a user of the original batch jobs runs them.

Jobs 1-3 read the raw TSV files (the text dumps print the raw text); jobs 4-7, 9 and 10 read the movie table that
job 3 writes; job 8 reads job 7's summary. Each function returns the path it
wrote. ``kind`` is the title type that counts as a movie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import join_genres, year_report
from ..operators.aggregates import most_voted_per_year, movies_per_year, yearly_summary
from ..operators.filters import filter_movies
from ..operators.joins import join_movies_ratings, join_titles_ratings
from ..operators.recommend import recommend_by_genre
from ..operators.topn import fan_in_for, top2_rated_per_genre, top10_rated_per_year
from ..operators.broadcast import materialize
from ..runtime import remove_path
from ..schemas import MOVIE, RAW_RATINGS, RAW_TITLES
from ..sinks.parquet import write_movies_parquet, write_summary_parquet
from ..sinks.text import (
    keyed_lines,
    write_kv_text,
    write_lines,
    write_ranked_text,
    write_recommendation_text,
    write_report_text,
)
from ..sources.parquet import read_movies_parquet, read_summary_parquet
from ..sources.tsv import read_ratings_raw, read_titles_raw, rejected_lines, type_movies


def movies_text_lines(titles: DataFrame, ratings: DataFrame, kind: str = MOVIE) -> DataFrame:
    """Job 1 lines: ``tconst\\ttitle\\tstartYear\\tgenres\\trating\\tvotes`` for movies only."""
    joined = join_movies_ratings(titles, ratings, kind)
    return keyed_lines(
        joined, "tconst", ["originalTitle", "startYear", join_genres("genres"), "rating", "votes"]
    )


def titles_text_lines(titles: DataFrame, ratings: DataFrame) -> DataFrame:
    """Job 2 lines: every title with all its columns, ratings appended."""
    joined = join_titles_ratings(titles, ratings)
    return keyed_lines(
        joined,
        "tconst",
        [
            "type",
            "primaryTitle",
            "originalTitle",
            "isAdult",
            "startYear",
            "endYear",
            "time",
            join_genres("genres"),
            "rating",
            "votes",
        ],
    )


def _inputs(spark: SparkSession, titles_path: str, ratings_path: str, partitions: int | None, kind: str | None = None):
    # ``partitions`` spreads unsplittable (.gz) input over that many tasks, by id, right after the scan.
    return read_titles_raw(spark, titles_path, partitions, kind), read_ratings_raw(spark, ratings_path, partitions)


def run_movies_text(
    spark: SparkSession, titles_path: str, ratings_path: str, out: str, kind: str = MOVIE, partitions: int | None = None
) -> str:
    """Job 1: join, movies only, narrow columns, text output."""
    return write_lines(movies_text_lines(*_inputs(spark, titles_path, ratings_path, partitions, kind), kind), out)


def run_titles_text(
    spark: SparkSession, titles_path: str, ratings_path: str, out: str, partitions: int | None = None
) -> str:
    """Job 2: join, all titles, all columns, text output."""
    return write_lines(titles_text_lines(*_inputs(spark, titles_path, ratings_path, partitions)), out)


def run_build_movies(
    spark: SparkSession, titles_path: str, ratings_path: str, out: str, partitions: int | None = None
) -> str:
    """Job 3: join, all titles, Parquet output (feeds every query)."""
    movies = join_titles_ratings(*_inputs(spark, titles_path, ratings_path, partitions))
    return write_movies_parquet(type_movies(movies), out)


def run_rejects(spark: SparkSession, titles_path: str, ratings_path: str, out: str) -> str:
    """The lines of both files that do not have the declared fields: ``file\\tverdict\\tfields\\tline``."""
    files = {"titles": (titles_path, RAW_TITLES), "ratings": (ratings_path, RAW_RATINGS)}
    odd = [rejected_lines(spark, path, schema).withColumn("file", F.lit(name)) for name, (path, schema) in files.items()]
    lines = odd[0].union(odd[1]).select(F.concat_ws("\t", "file", "verdict", F.col("fields").cast("string"), "value").alias("value"))
    return write_lines(lines, out)


def run_movies_per_year(spark: SparkSession, movies_path: str, out: str, kind: str = MOVIE) -> str:
    """Job 4: ``year\\tcount`` lines."""
    counts = movies_per_year(read_movies_parquet(spark, movies_path, "movies_per_year"), kind)
    return write_kv_text(counts, out, "year", ["count"])


def run_most_voted_per_year(spark: SparkSession, movies_path: str, out: str, kind: str = MOVIE) -> str:
    """Job 5: ``year\\ttconst\\ttitle\\tvotes`` lines."""
    movies = read_movies_parquet(spark, movies_path, "most_voted_per_year")
    best = most_voted_per_year(movies, kind, fan_in=fan_in_for(movies))
    return write_kv_text(best, out, "year", ["tconst", "title", "votes"])


def run_top10_rated_per_year(spark: SparkSession, movies_path: str, out: str, kind: str = MOVIE) -> str:
    """Job 6: ``year\\ttconst\\ttitle\\trating\\tvotes`` lines, ten per year."""
    movies = read_movies_parquet(spark, movies_path, "top10_rated_per_year")
    top = top10_rated_per_year(movies, kind, fan_in=fan_in_for(movies))
    return write_ranked_text(top, out, "year")


def run_yearly_summary(spark: SparkSession, movies_path: str, out: str, kind: str = MOVIE) -> str:
    """Job 7: one nested Parquet row per year."""
    movies = read_movies_parquet(spark, movies_path, "yearly_summary")
    summary = yearly_summary(movies, kind, fan_in=fan_in_for(movies))
    return write_summary_parquet(summary, out)


def run_year_report(spark: SparkSession, summary_path: str, out: str) -> str:
    """Job 8: the yearly summary printed as a text report."""
    return write_report_text(year_report(read_summary_parquet(spark, summary_path)), out)


def run_top2_rated_per_genre(spark: SparkSession, movies_path: str, out: str, kind: str = MOVIE) -> str:
    """Job 9: ``genre\\ttconst\\ttitle\\trating\\tvotes`` lines, two per genre."""
    movies = read_movies_parquet(spark, movies_path, "by_genre")
    top = top2_rated_per_genre(movies, kind, fan_in=fan_in_for(movies))
    return write_ranked_text(top, out, "genre")


def run_recommend_by_genre(spark: SparkSession, movies_path: str, out: str, kind: str = MOVIE) -> str:
    """Job 10: one recommendation line per movie with a genre, in tconst order over all part files."""
    scratch: list[str] = []
    movies = read_movies_parquet(spark, movies_path, "by_genre")
    try:
        recs = recommend_by_genre(movies, kind, scratch=scratch)
        return write_recommendation_text(recs, out, filter_movies(movies, kind))
    finally:
        for path in scratch:
            remove_path(spark, path)


def run_genres(spark: SparkSession, movies_path: str, out_dir: str, kind: str = MOVIE) -> tuple[str, str]:
    """Jobs 9 and 10 together: the top 2 per genre is ranked once, written once
    as a table, then both written as job 9's lines and fed to job 10's join."""
    movies = read_movies_parquet(spark, movies_path, "by_genre")
    scratch: list[str] = []
    try:
        top, _, _, path = materialize(top2_rated_per_genre(movies, kind, fan_in=fan_in_for(movies)), "top2_per_genre")
        scratch.append(path)
        top2_out = write_ranked_text(top, f"{out_dir.rstrip('/')}/top2_rated_per_genre", "genre")
        recs = recommend_by_genre(movies, kind, scratch=scratch, top=top)
        recs_out = write_recommendation_text(recs, f"{out_dir.rstrip('/')}/recommend_by_genre", filter_movies(movies, kind))
        return top2_out, recs_out
    finally:
        for p in scratch:
            remove_path(spark, p)
