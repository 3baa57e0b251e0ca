"""The model's two input tables, derived by Spark from the driver's parquet tables.

The driver ships no catalogue data, so two stand-in catalogues are built from
its TPC-H-like tables. Both keep the model's column names and types (only
``tconst`` stays the source's integer key), so every operator runs on them
unchanged; the title type that plays ``movie`` is passed to the operators.

Order catalogue (year queries): one title line per order, written as raw text.
  tconst = o_orderkey, type = o_orderstatus (``F`` plays ``movie``),
  primaryTitle = originalTitle = o_orderpriority, isAdult = '0',
  startYear = endYear = year(o_orderdate), genres = o_orderpriority with ``-``
  read as a comma. Ratings: lineitem grouped by the key; rating =
  round(max(l_discount) * 100, 1), votes = sum(l_quantity).
Part catalogue (genre queries): one title per part.
  tconst = p_partkey, type = p_type (``ECONOMY`` plays ``movie``),
  primaryTitle = originalTitle = p_name, startYear and endYear missing,
  time = p_size, genres = p_name with blanks read as commas.
So that every rule acts, key arithmetic (``EDGES``) makes some lines odd:
  missing or unparsable years, runtimes and votes, votes beyond the int range,
  types differing only by case, missing genre fields and elements, a year
  without rated movies, repeated title and rating lines, ratings without a
  title, and (in the files) lines without an id.
Line catalogue (bench scale-up of the join jobs): one title per lineitem row,
  tconst = '<l_orderkey>-<l_linenumber>', type = l_returnflag (``R`` plays
  ``movie``), title = 'part <l_partkey>', startYear = year(l_shipdate),
  genres = [l_linestatus]; its ratings are the line's own discount and
  quantity, for lines with a non-zero discount only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import parse_double, parse_int, parse_long, split_genres
from ..operators.joins import join_titles_ratings
from ..schemas import NULL_MARKER, TITLE_FIELDS
from .tsv import TITLE_NUMBERS, raw_titles

# Fixed values of the stand-in mapping above.
ORDER_MOVIE_TYPE = "F"
PART_MOVIE_TYPE = "ECONOMY"
LINE_MOVIE_TYPE = "R"
UNKNOWN_YEAR_PRIORITY = "4-NOT SPECIFIED"
ORPHANS_FROM = 1_000_000_000
# The odd lines: key modulo base equals rest.
EDGES = {
    "odd_year": (17, 0),
    "unrated_year": (23, 0),
    "no_end": (7, 0),
    "odd_time": (5, 0),
    "no_time": (5, 1),
    "lower_type": (11, 0),
    "no_genres": (13, 0),
    "last_genre": (13, 1),
    "first_genre": (13, 2),
    "title_twice": (37, 0),
    "huge_votes": (19, 0),
    "long_rating": (19, 1),
    "odd_votes": (19, 2),
    "rating_twice": (31, 0),
    "orphan": (29, 0),
    "no_id": (997, 0),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _key(column: str, edge: str) -> Column:
    base, rest = EDGES[edge]
    return F.col(column) % base == rest


def _genre_text(words: Column, column: str) -> Column:
    """Comma text with the marker as the field, the last or the first element of some lines."""
    marker = F.lit(NULL_MARKER)
    return (
        F.when(_key(column, "no_genres"), marker)
        .when(_key(column, "last_genre"), F.concat_ws(",", words, marker))
        .when(_key(column, "first_genre"), F.concat_ws(",", marker, words))
        .otherwise(words)
    )


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title lines of the order catalogue: the key and the eight other fields as raw text."""
    o = table(spark, sf_dir, "orders")
    marker, year = F.lit(NULL_MARKER), F.year("o_orderdate").cast("string")
    key = "o_orderkey"
    start = (
        F.when(F.col("o_orderpriority") == UNKNOWN_YEAR_PRIORITY, marker)
        .when(_key(key, "odd_year"), F.lit("19??"))
        .when(_key(key, "unrated_year"), F.lit("1899"))
        .otherwise(year)
    )
    time = F.when(_key(key, "odd_time"), F.lit("90 min")).when(_key(key, "no_time"), marker)
    lines = o.select(
        F.col(key).alias("key"),
        F.when(_key(key, "lower_type"), F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("type"),
        F.col("o_orderpriority").alias("primaryTitle"),
        F.col("o_orderpriority").alias("originalTitle"),
        F.lit("0").alias("isAdult"),
        start.alias("startYear"),
        F.when(_key(key, "no_end"), marker).otherwise(year).alias("endYear"),
        time.otherwise((F.col(key) % 200).cast("string")).alias("time"),
        _genre_text(F.translate("o_orderpriority", "-", ","), key).alias("genres"),
    )
    again = F.concat("primaryTitle", F.lit(" (again)"))
    return lines.union(lines.where(_key("key", "title_twice")).withColumn("primaryTitle", again))


def _order_rating_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating lines of the order catalogue: the key, rating and votes as raw text."""
    sums = lineitem_ratings(spark, sf_dir, "l_orderkey").withColumnRenamed("tconst", "key")
    rating = F.col("rating").cast("string")
    votes = F.when(_key("key", "huge_votes"), F.lit("3000000000")).when(_key("key", "odd_votes"), F.lit("12x"))
    lines = sums.where(~_key("key", "unrated_year")).select(
        "key",
        F.when(_key("key", "long_rating"), F.concat(rating, F.lit("0"))).otherwise(rating).alias("rating"),
        votes.otherwise(F.col("votes").cast("string")).alias("votes"),
    )
    second = lines.where(_key("key", "rating_twice")).select("key", F.lit("1.0").alias("rating"), F.lit("1").alias("votes"))
    orphans = lines.where(_key("key", "orphan")).withColumn("key", F.col("key") + ORPHANS_FROM)
    return lines.union(second).union(orphans)


def _file_id() -> Column:
    return F.when(_key("key", "no_id"), F.lit("")).otherwise(F.col("key").cast("string")).alias("tconst")


def order_title_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order catalogue's title file: nine text fields, some lines without an id."""
    return _order_lines(spark, sf_dir).select(_file_id(), *TITLE_FIELDS[1:])


def order_rating_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_rating_lines(spark, sf_dir).select(_file_id(), "rating", "votes")


def order_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw_titles(_order_lines(spark, sf_dir).withColumnRenamed("key", "tconst"))
    return lines.withColumns({"tconst": F.col("tconst").cast("bigint"), **{c: parse_int(c) for c in TITLE_NUMBERS}})


def part_genre_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tconst, genres as raw text) of the part catalogue."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("tconst"), _genre_text(F.translate("p_name", " ", ","), "p_partkey").alias("genres"))


def part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    genres = _genre_text(F.translate("p_name", " ", ","), "p_partkey")
    return p.select(
        F.col("p_partkey").alias("tconst"),
        F.when(_key("p_partkey", "lower_type"), F.lower("p_type")).otherwise(F.col("p_type")).alias("type"),
        F.col("p_name").alias("primaryTitle"),
        F.col("p_name").alias("originalTitle"),
        F.lit("0").alias("isAdult"),
        F.lit(None).cast("int").alias("startYear"),
        F.lit(None).cast("int").alias("endYear"),
        F.col("p_size").alias("time"),
        split_genres(genres).alias("genres"),
    )


def _line_id() -> Column:
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))


def line_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    title = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    return li.select(
        _line_id().alias("tconst"),
        F.col("l_returnflag").alias("type"),
        title.alias("primaryTitle"),
        title.alias("originalTitle"),
        F.lit("0").alias("isAdult"),
        F.year("l_shipdate").alias("startYear"),
        F.lit(None).cast("int").alias("endYear"),
        F.lit(None).cast("int").alias("time"),
        F.array("l_linestatus").alias("genres"),
    )


def line_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.where(F.col("l_discount") > 0).select(
        _line_id().alias("tconst"),
        F.round(F.col("l_discount") * 100, 1).alias("rating"),
        F.col("l_quantity").cast("bigint").alias("votes"),
    )


def lineitem_ratings(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """(tconst, rating, votes) per ``key`` of lineitem; partial aggregation map-side."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col(key).alias("tconst")).agg(
        F.round(F.max("l_discount") * 100, 1).alias("rating"),
        F.sum("l_quantity").cast("bigint").alias("votes"),
    )


def order_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _order_rating_lines(spark, sf_dir).withColumnRenamed("key", "tconst")
    return lines.withColumns({"rating": parse_double("rating"), "votes": parse_long("votes")})


def part_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_ratings(spark, sf_dir, "l_partkey")


def order_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined movie table of the order catalogue."""
    return join_titles_ratings(order_titles(spark, sf_dir), order_ratings(spark, sf_dir))


def part_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined movie table of the part catalogue."""
    return join_titles_ratings(part_titles(spark, sf_dir), part_ratings(spark, sf_dir))
