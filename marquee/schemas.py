"""Declared schemas of the catalogue-and-ratings model.

Nothing is inferred: raw TSV files are read with all-string schemas, the text
dumps print that text, and the movie table is cast to ``MOVIES`` when written
and read with it.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The raw title file has these nine tab-separated fields, in this
# order, and the rating file these three.
TITLE_FIELDS = [
    "tconst",
    "type",
    "primaryTitle",
    "originalTitle",
    "isAdult",
    "startYear",
    "endYear",
    "time",
    "genres",
]
RATING_FIELDS = ["tconst", "rating", "votes"]

# Header lines the TSV writer puts at the top of each file (the reader skips
# the first line of a file whatever it says).
TITLES_HEADER = "\t".join(
    ["tconst", "titleType", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear", "runtimeMinutes", "genres"]
)
RATINGS_HEADER = "\t".join(["tconst", "averageRating", "numVotes"])

# Fixed value: the missing-value marker of the raw files.
NULL_MARKER = "\\N"
# Fixed value: the title type the queries keep.
MOVIE = "movie"

RAW_TITLES = T.StructType([T.StructField(c, T.StringType(), True) for c in TITLE_FIELDS])
RAW_RATINGS = T.StructType([T.StructField(c, T.StringType(), True) for c in RATING_FIELDS])

TITLES = T.StructType(
    [
        T.StructField("tconst", T.StringType(), True),
        T.StructField("type", T.StringType(), True),
        T.StructField("primaryTitle", T.StringType(), True),
        T.StructField("originalTitle", T.StringType(), True),
        T.StructField("isAdult", T.StringType(), True),
        T.StructField("startYear", T.IntegerType(), True),
        T.StructField("endYear", T.IntegerType(), True),
        T.StructField("time", T.IntegerType(), True),
        T.StructField("genres", T.ArrayType(T.StringType(), True), True),
    ]
)

RATINGS = T.StructType(
    [
        T.StructField("tconst", T.StringType(), True),
        T.StructField("rating", T.DoubleType(), True),
        T.StructField("votes", T.LongType(), True),
    ]
)

# The joined table every query reads (titles left-joined to ratings).
MOVIES_COLUMNS = [
    "tconst",
    "type",
    "primaryTitle",
    "originalTitle",
    "isAdult",
    "startYear",
    "endYear",
    "time",
    "rating",
    "votes",
    "genres",
]

# The movie table as stored. ``unparsed`` keeps, by column, the raw text of every
# number that did not parse (NULL when all did), so nothing of the input is lost.
MOVIES = T.StructType(
    [
        *(f for f in TITLES.fields if f.name != "genres"),
        T.StructField("rating", T.DoubleType(), True),
        T.StructField("votes", T.LongType(), True),
        T.StructField("genres", T.ArrayType(T.StringType(), True), True),
        T.StructField("unparsed", T.MapType(T.StringType(), T.StringType(), True), True),
    ]
)

# Column subsets each query asks the Parquet scan for.
PROJECTIONS = {
    "movies_per_year": ["type", "startYear", "endYear"],
    "most_voted_per_year": ["tconst", "type", "originalTitle", "startYear", "votes"],
    "top10_rated_per_year": ["tconst", "type", "originalTitle", "startYear", "rating", "votes"],
    "yearly_summary": ["tconst", "type", "originalTitle", "startYear", "rating", "votes"],
    "by_genre": ["tconst", "type", "originalTitle", "rating", "votes", "genres"],
}

TOP_ENTRY = T.StructType(
    [
        T.StructField("tconst", T.StringType(), True),
        T.StructField("originalTitle", T.StringType(), True),
        T.StructField("rating", T.DoubleType(), True),
        T.StructField("votes", T.LongType(), True),
    ]
)

SUMMARY = T.StructType(
    [
        T.StructField("year", T.IntegerType(), True),
        T.StructField("number_of_movies", T.LongType(), False),
        T.StructField("tconst_most_votes", T.StringType(), True),
        T.StructField("title_most_votes", T.StringType(), True),
        T.StructField("number_of_votes", T.LongType(), True),
        T.StructField("top10", T.ArrayType(TOP_ENTRY, False), False),
    ]
)
