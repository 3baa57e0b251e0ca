"""Every operator of the model as a query over the driver's tables.

Each entry takes (spark, sf_dir) and returns a DataFrame whose columns match
the DuckDB statement of the same key in ``oracle.SQL``. Nested results (lists)
are compared in a rendered text form; the nested operators themselves are
tested directly in ``tests/``. Queries that exercise a file format first let
Spark write the catalogue in that format to a fresh folder under the shared
checkpoint directory, then read it back through the source under test.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.aggregates import most_voted_per_year, movies_per_year, ordered_top_list, yearly_summary
from ..operators.filters import exclude_self, filter_has_genre, filter_movies, filter_rated, with_genre
from ..operators.joins import join_movies_ratings, join_titles_ratings
from ..operators.ordering import order_by_group_key, order_group_then_rank, order_recommendations
from ..operators.recommend import genre_candidates, recommend_by_genre
from ..operators.topn import top2_rated_per_genre, top10_rated_per_year
from ..plans import jobs
from ..operators.broadcast import checked_broadcast_join
from ..runtime import scratch_path
from ..schemas import RAW_RATINGS, RAW_TITLES, TITLES_HEADER
from ..sinks.parquet import write_movies_parquet, write_summary_parquet
from ..sinks.text import write_kv_text, write_ranked_text, write_recommendation_text
from ..sources import driver as D
from ..sources.parquet import read_lookup, read_movies_parquet, read_summary_parquet
from ..sources.tsv import TSV_OPTIONS, read_ratings_tsv, read_titles_tsv, rejected_lines, write_raw_tsv, write_tsv_lines

F_TYPE = D.ORDER_MOVIE_TYPE
P_TYPE = D.PART_MOVIE_TYPE

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------- helpers


def _titles_tsv(spark: SparkSession, sf: str, compression: str | None = None) -> str:
    return write_raw_tsv(D.order_title_file_rows(spark, sf), scratch_path(spark, "titles_tsv"), compression)


def _ratings_tsv(spark: SparkSession, sf: str, compression: str | None = None) -> str:
    return write_raw_tsv(D.order_rating_file_rows(spark, sf), scratch_path(spark, "ratings_tsv"), compression)


def _written(df: DataFrame, name: str) -> DataFrame:
    """The joined table written once: queries that read it in several branches evaluate the join once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _order_table(spark: SparkSession, sf: str) -> DataFrame:
    return _written(D.order_movies(spark, sf), "order_movies")


def _part_table(spark: SparkSession, sf: str) -> DataFrame:
    return _written(D.part_movies(spark, sf), "part_movies")


def _raw(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**TSV_OPTIONS).csv(path)


def _genres_as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("genres", C.join_genres("genres"))


def _flat_summary(summary: DataFrame) -> DataFrame:
    entries = F.transform(
        "top10", lambda e: C.format_row(e["tconst"], e["originalTitle"], e["rating"], e["votes"])
    )
    return summary.select(
        "year",
        "number_of_movies",
        "tconst_most_votes",
        "title_most_votes",
        "number_of_votes",
        F.array_join(entries, ";").alias("top10"),
    )


# ---------------------------------------------------------------- sources


def q_read_titles_tsv(spark: SparkSession, sf: str) -> DataFrame:
    return _genres_as_text(read_titles_tsv(spark, _titles_tsv(spark, sf)))


def q_read_ratings_tsv(spark: SparkSession, sf: str) -> DataFrame:
    return read_ratings_tsv(spark, _ratings_tsv(spark, sf))


def q_read_compressed_tsv(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for codec in ("none", "gzip", "bzip2"):
        titles = read_titles_tsv(spark, _titles_tsv(spark, sf, codec))
        ratings = read_ratings_tsv(spark, _ratings_tsv(spark, sf, codec))
        title = C.format_row(*[c for c in titles.columns if c != "genres"], C.join_genres("genres"))
        parts.append(titles.select(F.lit(codec).alias("codec"), F.lit("titles").alias("file"), title.alias("value")))
        parts.append(ratings.select(F.lit(codec).alias("codec"), F.lit("ratings").alias("file"), C.format_row(*ratings.columns).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def q_read_movies_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = write_movies_parquet(D.order_movies(spark, sf), scratch_path(spark, "movies"))
    return read_movies_parquet(spark, path, ["tconst", "type", "originalTitle", "startYear", "rating", "votes"])


def q_read_summary_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = write_summary_parquet(yearly_summary(D.order_movies(spark, sf), F_TYPE), scratch_path(spark, "summary"))
    summary = read_summary_parquet(spark, path)
    return summary.select("year", F.posexplode("top10").alias("pos", "e")).select(
        "year",
        (F.col("pos") + 1).alias("position"),
        "e.tconst",
        "e.originalTitle",
        "e.rating",
        "e.votes",
    )


def q_read_lookup(spark: SparkSession, sf: str) -> DataFrame:
    top = top2_rated_per_genre(D.part_movies(spark, sf), P_TYPE)
    path = write_ranked_text(top, scratch_path(spark, "top2_text"), "genre")
    return read_lookup(spark, path, key_type="bigint")


def q_rejected_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Some title lines cut after their second field, some with two fields more, read back as rejects."""
    rows = D.order_title_file_rows(spark, sf)
    key = F.col("tconst").try_cast("bigint")
    whole = F.concat_ws("\t", *rows.columns)
    line = F.when(key % 41 == 0, F.concat_ws("\t", *rows.columns[:2])).when(key % 43 == 0, F.concat_ws("\t", whole, F.lit("one"), F.lit("two")))
    path = scratch_path(spark, "odd_titles_tsv")
    write_tsv_lines(rows.select(line.otherwise(whole).alias("value")), path, TITLES_HEADER)
    return rejected_lines(spark, path)


# ---------------------------------------------------------------- sinks


def q_write_movies_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = write_movies_parquet(D.order_movies(spark, sf), scratch_path(spark, "movies"))
    return _genres_as_text(spark.read.parquet(path)).drop("unparsed")


def q_write_summary_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = write_summary_parquet(yearly_summary(D.order_movies(spark, sf), F_TYPE), scratch_path(spark, "summary"))
    return _flat_summary(spark.read.parquet(path))


def q_write_kv_text(spark: SparkSession, sf: str) -> DataFrame:
    counts = movies_per_year(D.order_movies(spark, sf), F_TYPE)
    return spark.read.text(write_kv_text(counts, scratch_path(spark, "kv_text"), "year", ["count"]))


def q_write_ranked_text(spark: SparkSession, sf: str) -> DataFrame:
    top = top10_rated_per_year(D.order_movies(spark, sf), F_TYPE)
    return spark.read.text(write_ranked_text(top, scratch_path(spark, "ranked_text"), "year"))


def q_write_recommendation_text(spark: SparkSession, sf: str) -> DataFrame:
    recs = recommend_by_genre(_part_table(spark, sf), P_TYPE)
    return spark.read.text(write_recommendation_text(recs, scratch_path(spark, "rec_text")))


# ---------------------------------------------------------------- projections and scalar functions


def q_project_columns(spark: SparkSession, sf: str) -> DataFrame:
    return C.project_columns(D.order_movies(spark, sf), ["type", "startYear", "endYear"])


def q_null_marker_to_null(spark: SparkSession, sf: str) -> DataFrame:
    raw = _raw(spark, _titles_tsv(spark, sf), RAW_TITLES)
    return raw.select(
        "tconst",
        F.col("startYear").alias("start_raw"),
        C.null_marker_to_null("startYear").alias("startYear"),
        F.col("time").alias("time_raw"),
        C.null_marker_to_null("time").alias("time"),
    )


def q_split_genres(spark: SparkSession, sf: str) -> DataFrame:
    genres = C.split_genres("genres")
    return D.part_genre_text(spark, sf).select(
        "tconst",
        F.array_size(genres).alias("n_genres"),
        F.get(genres, 0).alias("genre_1"),
        F.get(genres, 1).alias("genre_2"),
    )


def q_join_genres(spark: SparkSession, sf: str) -> DataFrame:
    return D.part_titles(spark, sf).select("tconst", C.join_genres("genres").alias("genres"))


def q_primary_genre(spark: SparkSession, sf: str) -> DataFrame:
    return D.part_titles(spark, sf).select("tconst", C.primary_genre("genres").alias("genre"))


def q_effective_year(spark: SparkSession, sf: str) -> DataFrame:
    return D.order_titles(spark, sf).select("tconst", "startYear", "endYear", C.effective_year().alias("year"))


def q_parse_numbers(spark: SparkSession, sf: str) -> DataFrame:
    raw = _raw(spark, _ratings_tsv(spark, sf), RAW_RATINGS)
    return raw.select(
        "tconst",
        F.col("rating").alias("rating_text"),
        C.parse_double("rating").alias("rating"),
        F.col("votes").alias("votes_text"),
        C.parse_long("votes").alias("votes"),
    )


def q_default_minus_one(spark: SparkSession, sf: str) -> DataFrame:
    m = D.order_movies(spark, sf)
    return m.select("tconst", C.default_minus_one("rating").alias("rating"), C.default_minus_one("votes").alias("votes"))


def q_null_to_text(spark: SparkSession, sf: str) -> DataFrame:
    m = D.order_movies(spark, sf)
    return m.select(
        "tconst",
        C.null_to_text("startYear").alias("startYear"),
        C.null_to_text("rating").alias("rating"),
        C.null_to_text("votes").alias("votes"),
    )


def q_format_row(spark: SparkSession, sf: str) -> DataFrame:
    m = D.order_movies(spark, sf)
    cols = ["tconst", "type", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear", "time"]
    return m.select("tconst", C.format_row(*cols, C.join_genres("genres"), "rating", "votes").alias("value"))


def q_year_report(spark: SparkSession, sf: str) -> DataFrame:
    return C.year_report(yearly_summary(_order_table(spark, sf), F_TYPE))


# ---------------------------------------------------------------- filters


def q_filter_movies(spark: SparkSession, sf: str) -> DataFrame:
    return filter_movies(D.order_movies(spark, sf), F_TYPE).select("tconst", "type", "startYear")


def q_filter_rated(spark: SparkSession, sf: str) -> DataFrame:
    return filter_rated(D.order_movies(spark, sf)).select("tconst", "rating", "votes")


def q_filter_has_genre(spark: SparkSession, sf: str) -> DataFrame:
    m = with_genre(filter_movies(D.part_movies(spark, sf), P_TYPE))
    return filter_has_genre(m).select("tconst", "genre")


def q_exclude_self(spark: SparkSession, sf: str) -> DataFrame:
    movies = _part_table(spark, sf)
    targets = filter_has_genre(with_genre(filter_movies(movies, P_TYPE))).select("tconst", "genre")
    joined = checked_broadcast_join(targets, genre_candidates(movies, P_TYPE), ["genre"])
    return joined.select("tconst", F.size(exclude_self(F.col("cands"), F.col("tconst"))).alias("n_candidates"))


def q_skip_header(spark: SparkSession, sf: str) -> DataFrame:
    return read_titles_tsv(spark, _titles_tsv(spark, sf)).select("tconst")


# ---------------------------------------------------------------- joins


def q_join_titles_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return _genres_as_text(join_titles_ratings(D.order_titles(spark, sf), D.order_ratings(spark, sf)))


def q_join_movies_ratings(spark: SparkSession, sf: str) -> DataFrame:
    joined = join_movies_ratings(D.order_titles(spark, sf), D.order_ratings(spark, sf), F_TYPE)
    return _genres_as_text(joined)


def q_recommend_by_genre(spark: SparkSession, sf: str) -> DataFrame:
    return recommend_by_genre(_part_table(spark, sf), P_TYPE)


# ---------------------------------------------------------------- aggregates


def q_movies_per_year(spark: SparkSession, sf: str) -> DataFrame:
    return movies_per_year(D.order_movies(spark, sf), F_TYPE)


def q_most_voted_per_year(spark: SparkSession, sf: str) -> DataFrame:
    return most_voted_per_year(D.order_movies(spark, sf), F_TYPE)


def q_yearly_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_summary(yearly_summary(_order_table(spark, sf), F_TYPE))


def q_ordered_top_list(spark: SparkSession, sf: str) -> DataFrame:
    top = top2_rated_per_genre(D.part_movies(spark, sf), P_TYPE)
    lists = ordered_top_list(top, ["genre"], ["tconst"], name="cands")
    return lists.select("genre", F.array_join(F.transform("cands", lambda e: e["tconst"].cast("string")), ",").alias("cands"))


# ---------------------------------------------------------------- top-n per group


def q_top10_rated_per_year(spark: SparkSession, sf: str) -> DataFrame:
    return top10_rated_per_year(D.order_movies(spark, sf), F_TYPE)


def q_top2_rated_per_genre(spark: SparkSession, sf: str) -> DataFrame:
    return top2_rated_per_genre(D.part_movies(spark, sf), P_TYPE)


# ---------------------------------------------------------------- sorts


def q_order_by_group_key(spark: SparkSession, sf: str) -> DataFrame:
    return order_by_group_key(movies_per_year(D.order_movies(spark, sf), F_TYPE), "year")


def q_order_group_then_rank(spark: SparkSession, sf: str) -> DataFrame:
    top = top10_rated_per_year(D.order_movies(spark, sf), F_TYPE)
    return order_group_then_rank(top, "year").select("year", "tconst", "title", "rating", "votes")


def q_order_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return order_recommendations(recommend_by_genre(_part_table(spark, sf), P_TYPE))


# ---------------------------------------------------------------- end-to-end jobs (TSV in)


def q_movies_text(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.run_movies_text(spark, _titles_tsv(spark, sf), _ratings_tsv(spark, sf), scratch_path(spark, "job1"), F_TYPE)
    return spark.read.text(out)


def q_titles_text(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.run_titles_text(spark, _titles_tsv(spark, sf), _ratings_tsv(spark, sf), scratch_path(spark, "job2"))
    return spark.read.text(out)


def q_build_movies(spark: SparkSession, sf: str) -> DataFrame:
    out = jobs.run_build_movies(spark, _titles_tsv(spark, sf), _ratings_tsv(spark, sf), scratch_path(spark, "job3"))
    movies = _genres_as_text(read_movies_parquet(spark, out))
    pairs = F.transform(F.array_sort(F.map_entries("unparsed")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return movies.withColumn("unparsed", F.array_join(pairs, ";"))


QUERIES: dict[str, Query] = {
    "read_titles_tsv": q_read_titles_tsv,
    "read_ratings_tsv": q_read_ratings_tsv,
    "read_compressed_tsv": q_read_compressed_tsv,
    "rejected_lines": q_rejected_lines,
    "read_movies_parquet": q_read_movies_parquet,
    "read_summary_parquet": q_read_summary_parquet,
    "read_lookup": q_read_lookup,
    "write_movies_parquet": q_write_movies_parquet,
    "write_summary_parquet": q_write_summary_parquet,
    "write_kv_text": q_write_kv_text,
    "write_ranked_text": q_write_ranked_text,
    "write_recommendation_text": q_write_recommendation_text,
    "project_columns": q_project_columns,
    "null_marker_to_null": q_null_marker_to_null,
    "split_genres": q_split_genres,
    "join_genres": q_join_genres,
    "primary_genre": q_primary_genre,
    "effective_year": q_effective_year,
    "parse_numbers": q_parse_numbers,
    "default_minus_one": q_default_minus_one,
    "null_to_text": q_null_to_text,
    "format_row": q_format_row,
    "year_report": q_year_report,
    "filter_movies": q_filter_movies,
    "filter_rated": q_filter_rated,
    "filter_has_genre": q_filter_has_genre,
    "exclude_self": q_exclude_self,
    "skip_header": q_skip_header,
    "join_titles_ratings": q_join_titles_ratings,
    "join_movies_ratings": q_join_movies_ratings,
    "recommend_by_genre": q_recommend_by_genre,
    "movies_per_year": q_movies_per_year,
    "most_voted_per_year": q_most_voted_per_year,
    "yearly_summary": q_yearly_summary,
    "ordered_top_list": q_ordered_top_list,
    "top10_rated_per_year": q_top10_rated_per_year,
    "top2_rated_per_genre": q_top2_rated_per_genre,
    "order_by_group_key": q_order_by_group_key,
    "order_group_then_rank": q_order_group_then_rank,
    "order_recommendations": q_order_recommendations,
    "movies_text": q_movies_text,
    "titles_text": q_titles_text,
    "build_movies": q_build_movies,
}
