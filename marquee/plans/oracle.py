"""DuckDB SQL that computes, from the same parquet tables, what each registered
query computes with Spark. Column names and types match the Spark results.

The stand-in catalogues (see ``sources.driver``) are spelled out once as CTEs
and shared by every statement.
"""

from __future__ import annotations

TAB = "chr(9)"
NL = "chr(10)"

def genres_text(expr: str) -> str:
    """SQL twin of ``join_genres``: missing elements print as text."""
    return f"array_to_string(list_transform({expr}, lambda g: coalesce(g, 'null')), ',')"


TITLE_ORDER = ", ".join(
    f"{c} NULLS FIRST"
    for c in ("type", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear", "time", genres_text("genres"))
)
NARROW_ORDER = ", ".join(f"{c} NULLS FIRST" for c in ("originalTitle", "startYear", genres_text("genres")))
RATING_ORDER = (
    "TRY_CAST(votes AS BIGINT) DESC NULLS LAST, TRY_CAST(rating AS DOUBLE) DESC NULLS LAST, "
    "votes DESC NULLS LAST, rating DESC NULLS LAST"
)


def genre_text(words: str, key: str) -> str:
    return (
        f"CASE WHEN {key} % 13 = 0 THEN '\\N' WHEN {key} % 13 = 1 THEN {words} || ',\\N' "
        f"WHEN {key} % 13 = 2 THEN '\\N,' || {words} ELSE {words} END"
    )


def genre_list(text: str) -> str:
    return f"list_transform(string_split(nullif({text}, '\\N'), ','), lambda g: nullif(g, '\\N'))"


ORDER_LINES = """
title_base AS (
  SELECT o_orderkey AS key,
         CASE WHEN o_orderkey % 11 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS type,
         o_orderpriority AS primaryTitle, o_orderpriority AS originalTitle, '0' AS isAdult,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '\\N' WHEN o_orderkey % 17 = 0 THEN '19??'
              WHEN o_orderkey % 23 = 0 THEN '1899' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS startYear,
         CASE WHEN o_orderkey % 7 = 0 THEN '\\N' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS endYear,
         CASE WHEN o_orderkey % 5 = 0 THEN '90 min' WHEN o_orderkey % 5 = 1 THEN '\\N'
              ELSE CAST(o_orderkey % 200 AS VARCHAR) END AS time,
         GENRES AS genres
  FROM orders),
title_lines AS (
  SELECT * FROM title_base UNION ALL
  SELECT key, type, primaryTitle || ' (again)', originalTitle, isAdult, startYear, endYear, time, genres
  FROM title_base WHERE key % 37 = 0),
rating_base AS (
  SELECT l_orderkey AS key,
         CAST(round(max(l_discount) * 100, 1) AS VARCHAR) || CASE WHEN l_orderkey % 19 = 1 THEN '0' ELSE '' END AS rating,
         CASE WHEN l_orderkey % 19 = 0 THEN '3000000000' WHEN l_orderkey % 19 = 2 THEN '12x'
              ELSE CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) END AS votes
  FROM lineitem WHERE l_orderkey % 23 <> 0 GROUP BY l_orderkey),
rating_lines AS (
  SELECT * FROM rating_base UNION ALL
  SELECT key, '1.0', '1' FROM rating_base WHERE key % 31 = 0 UNION ALL
  SELECT key + 1000000000, rating, votes FROM rating_base WHERE key % 29 = 0),
file_titles AS (
  SELECT CASE WHEN key % 997 = 0 THEN '' ELSE CAST(key AS VARCHAR) END AS tconst, * EXCLUDE (key) FROM title_lines),
file_ratings AS (
  SELECT CASE WHEN key % 997 = 0 THEN '' ELSE CAST(key AS VARCHAR) END AS tconst, rating, votes FROM rating_lines),
raw_titles AS (
  SELECT tconst, type, primaryTitle, originalTitle, isAdult, nullif(startYear, '\\N') AS startYear,
         nullif(endYear, '\\N') AS endYear, nullif(time, '\\N') AS time, LISTED AS genres FROM file_titles),
file_movies AS (
  SELECT t.*, r.rating, r.votes
  FROM (SELECT * FROM raw_titles QUALIFY row_number() OVER (PARTITION BY tconst ORDER BY TITLE_ORDER) = 1) t
  LEFT JOIN (SELECT * FROM file_ratings QUALIFY row_number() OVER (PARTITION BY tconst ORDER BY RATING_ORDER) = 1) r
  USING (tconst)),
file_narrow AS (
  SELECT t.*, r.rating, r.votes
  FROM (SELECT tconst, originalTitle, startYear, genres FROM raw_titles WHERE type = 'F'
        QUALIFY row_number() OVER (PARTITION BY tconst ORDER BY NARROW_ORDER) = 1) t
  LEFT JOIN (SELECT * FROM file_ratings QUALIFY row_number() OVER (PARTITION BY tconst ORDER BY RATING_ORDER) = 1) r
  USING (tconst)),
"""
ORDER_LINES = (
    ORDER_LINES.replace("GENRES", genre_text("replace(o_orderpriority, '-', ',')", "o_orderkey"))
    .replace("LISTED", genre_list("genres"))
    .replace("TITLE_ORDER", TITLE_ORDER)
    .replace("RATING_ORDER", RATING_ORDER)
    .replace("NARROW_ORDER", NARROW_ORDER)
)

ORDER_CTES = (
    ORDER_LINES
    + f"""
order_titles AS (
  SELECT key AS tconst, type, primaryTitle, originalTitle, isAdult, TRY_CAST(startYear AS INTEGER) AS startYear,
         TRY_CAST(endYear AS INTEGER) AS endYear, TRY_CAST(time AS INTEGER) AS time, {genre_list("genres")} AS genres
  FROM title_lines),
order_ratings AS (
  SELECT key AS tconst, TRY_CAST(rating AS DOUBLE) AS rating, TRY_CAST(votes AS BIGINT) AS votes FROM rating_lines),
order_movies AS (
  SELECT t.tconst, t.type, t.primaryTitle, t.originalTitle, t.isAdult, t.startYear, t.endYear,
         t.time, r.rating, r.votes, t.genres
  FROM (SELECT * FROM order_titles QUALIFY row_number() OVER (PARTITION BY tconst ORDER BY {TITLE_ORDER}) = 1) t
  LEFT JOIN (SELECT * FROM order_ratings QUALIFY row_number() OVER (PARTITION BY tconst ORDER BY {RATING_ORDER}) = 1) r
  ON t.tconst = r.tconst),
"""
    + """
movies AS (SELECT * FROM order_movies WHERE type = 'F'),
top10 AS (
  SELECT * FROM (
    SELECT startYear AS year, tconst, originalTitle AS title, rating, COALESCE(votes, -1) AS votes,
           CAST(row_number() OVER (PARTITION BY startYear
                ORDER BY rating DESC, COALESCE(votes, -1) DESC, tconst) AS INTEGER) AS rank
    FROM movies WHERE rating IS NOT NULL)
  WHERE rank <= 10),
most_voted AS (
  SELECT year, tconst, title, votes FROM (
    SELECT startYear AS year, tconst, originalTitle AS title, COALESCE(votes, -1) AS votes,
           row_number() OVER (PARTITION BY startYear ORDER BY COALESCE(votes, -1) DESC, tconst) AS rn
    FROM movies)
  WHERE rn = 1),
summary AS (
  SELECT c.year, c.number_of_movies, m.tconst AS tconst_most_votes, m.title AS title_most_votes,
         m.votes AS number_of_votes
  FROM (SELECT startYear AS year, count(*) AS number_of_movies FROM movies GROUP BY startYear) c
  JOIN most_voted m ON c.year IS NOT DISTINCT FROM m.year)
"""
)

PART_CTES = (
    f"""
part_titles AS (
  SELECT p_partkey AS tconst, CASE WHEN p_partkey % 11 = 0 THEN lower(p_type) ELSE p_type END AS type,
         p_name AS primaryTitle, p_name AS originalTitle,
         '0' AS isAdult, CAST(NULL AS INTEGER) AS startYear, CAST(NULL AS INTEGER) AS endYear,
         p_size AS time, {genre_list(genre_text("replace(p_name, ' ', ',')", "p_partkey"))} AS genres
  FROM part),
"""
    + """
part_ratings AS (
  SELECT l_partkey AS tconst, round(max(l_discount) * 100, 1) AS rating,
         CAST(sum(l_quantity) AS BIGINT) AS votes
  FROM lineitem GROUP BY l_partkey),
part_movies AS (
  SELECT t.tconst, t.type, t.primaryTitle, t.originalTitle, t.isAdult, t.startYear, t.endYear,
         t.time, r.rating, r.votes, t.genres
  FROM part_titles t LEFT JOIN part_ratings r ON t.tconst = r.tconst),
targets AS (
  SELECT tconst, originalTitle AS title, genres[1] AS genre, rating, votes
  FROM part_movies WHERE type = 'ECONOMY' AND genres[1] IS NOT NULL),
top2 AS (
  SELECT * FROM (
    SELECT genre, tconst, title, rating, COALESCE(votes, -1) AS votes,
           CAST(row_number() OVER (PARTITION BY genre
                ORDER BY rating DESC, COALESCE(votes, -1) DESC, tconst) AS INTEGER) AS rank
    FROM targets WHERE rating IS NOT NULL)
  WHERE rank <= 2),
recs AS (
  SELECT t.tconst, t.title, t.genre, t.rating, t.votes,
         c.tconst AS rec_tconst, c.title AS rec_title, c.rating AS rec_rating, c.votes AS rec_votes
  FROM targets t JOIN top2 c ON c.genre = t.genre AND c.tconst <> t.tconst
  QUALIFY row_number() OVER (PARTITION BY t.tconst ORDER BY c.rank) = 1)
"""
)


def txt(expr: str) -> str:
    """SQL twin of ``null_to_text``."""
    return f"COALESCE(CAST({expr} AS VARCHAR), 'null')"


def row(*exprs: str) -> str:
    """SQL twin of ``format_row``."""
    return f"concat_ws({TAB}, " + ", ".join(txt(e) for e in exprs) + ")"


def with_order(select: str) -> str:
    return f"WITH {ORDER_CTES} {select}"


def with_part(select: str) -> str:
    return f"WITH {PART_CTES} {select}"


TOP_LIST_TEXT = (
    "SELECT year, string_agg(" + row("tconst", "title", "rating", "votes") + ", ';' ORDER BY rank) AS top10 "
    "FROM top10 GROUP BY year"
)

SUMMARY_FLAT = with_order(
    "SELECT s.year, s.number_of_movies, s.tconst_most_votes, s.title_most_votes, s.number_of_votes, "
    "COALESCE(l.top10, '') AS top10 "
    f"FROM summary s LEFT JOIN ({TOP_LIST_TEXT}) l ON s.year IS NOT DISTINCT FROM l.year"
)

REPORT_LINES = (
    "SELECT year, string_agg(concat(CAST(rank AS VARCHAR), '- ', "
    + row("tconst", "title", "rating", "votes")
    + f", {NL}), '' ORDER BY rank) AS lines FROM top10 GROUP BY year"
)

YEAR_REPORT = with_order(
    "SELECT s.year, concat("
    + row("s.year", "s.number_of_movies", "s.tconst_most_votes", "s.title_most_votes", "s.number_of_votes")
    + f", {NL}, 'Top 10:', {NL}, COALESCE(l.lines, '')) AS report "
    f"FROM summary s LEFT JOIN ({REPORT_LINES}) l ON s.year IS NOT DISTINCT FROM l.year"
)

MOVIES_FLAT = (
    "SELECT tconst, type, primaryTitle, originalTitle, isAdult, startYear, endYear, time, rating, votes, "
    + genres_text("genres")
    + " AS genres FROM order_movies"
)

TITLES_AS_READ = (
    "SELECT tconst, type, primaryTitle, originalTitle, isAdult, TRY_CAST(startYear AS INTEGER) AS startYear, "
    "TRY_CAST(endYear AS INTEGER) AS endYear, TRY_CAST(time AS INTEGER) AS time, "
    + genres_text("genres")
    + " AS genres FROM raw_titles"
)

RATINGS_AS_READ = (
    "SELECT tconst, TRY_CAST(rating AS DOUBLE) AS rating, TRY_CAST(votes AS BIGINT) AS votes FROM file_ratings"
)

TITLE_LINE = "concat_ws(chr(9), tconst, type, primaryTitle, originalTitle, isAdult, startYear, endYear, time, genres)"
REJECTED_LINES = (
    "SELECT value, CAST(len(string_split(value, chr(9))) AS INTEGER) AS fields, verdict FROM ("
    "SELECT concat_ws(chr(9), tconst, type) AS value, 'short' AS verdict FROM file_titles WHERE TRY_CAST(tconst AS BIGINT) % 41 = 0 UNION ALL "
    f"SELECT {TITLE_LINE} || chr(9) || 'one' || chr(9) || 'two', 'long' FROM file_titles "
    "WHERE TRY_CAST(tconst AS BIGINT) % 43 = 0 AND TRY_CAST(tconst AS BIGINT) % 41 <> 0)"
)

AS_LINES = (
    "SELECT 'titles' AS file, "
    + row("tconst", "type", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear", "time", "genres")
    + " AS value FROM (" + TITLES_AS_READ + ") UNION ALL SELECT 'ratings' AS file, "
    + row("tconst", "rating", "votes")
    + " AS value FROM (" + RATINGS_AS_READ + ")"
)

# The numbers of a movie line and their types, in the order of their names.
NUMBERS = {"endYear": "INTEGER", "rating": "DOUBLE", "startYear": "INTEGER", "time": "INTEGER", "votes": "BIGINT"}
UNPARSED = (
    "nullif(concat_ws(';', "
    + ", ".join(f"CASE WHEN {c} IS NOT NULL AND TRY_CAST({c} AS {t}) IS NULL THEN '{c}=' || {c} END" for c, t in NUMBERS.items())
    + "), '')"
)

MOVIES_TEXT_LINE = row(
    "tconst", "originalTitle", "startYear", genres_text("genres"), "rating", "votes"
)

TITLES_TEXT_LINE = row(
    "tconst", "type", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear", "time",
    genres_text("genres"), "rating", "votes",
)

REC_LINE = row(
    "tconst", "title", "genre", "rating", "votes", "'RECOMMENDED:'", "rec_tconst", "rec_title", "rec_rating",
    "rec_votes",
)

SQL: dict[str, str] = {
    # sources
    "read_titles_tsv": with_order(TITLES_AS_READ),
    "read_ratings_tsv": with_order(RATINGS_AS_READ),
    "rejected_lines": with_order(REJECTED_LINES),
    "read_compressed_tsv": with_order(
        "SELECT codec, t.* FROM (" + AS_LINES + ") t, (VALUES ('none'), ('gzip'), ('bzip2')) c(codec)"
    ),
    "read_movies_parquet": with_order(
        "SELECT CAST(tconst AS VARCHAR) AS tconst, type, originalTitle, startYear, rating, votes FROM order_movies"
    ),
    "read_summary_parquet": with_order(
        "SELECT year, rank AS position, CAST(tconst AS VARCHAR) AS tconst, title AS originalTitle, rating, votes FROM top10"
    ),
    "read_lookup": with_part(
        "SELECT genre, tconst, title AS originalTitle, rating, votes FROM top2"
    ),
    # sinks
    "write_movies_parquet": with_order(MOVIES_FLAT.replace("SELECT tconst", "SELECT CAST(tconst AS VARCHAR) AS tconst")),
    "write_summary_parquet": SUMMARY_FLAT.replace(
        "s.tconst_most_votes,", "CAST(s.tconst_most_votes AS VARCHAR) AS tconst_most_votes,"
    ),
    "write_kv_text": with_order(
        "SELECT " + row("year", "count") + " AS value FROM "
        "(SELECT COALESCE(startYear, endYear) AS year, count(*) AS count FROM movies GROUP BY 1)"
    ),
    "write_ranked_text": with_order(
        "SELECT " + row("year", "tconst", "title", "rating", "votes") + " AS value FROM top10"
    ),
    "write_recommendation_text": with_part("SELECT " + REC_LINE + " AS value FROM recs"),
    # projections and scalar functions
    "project_columns": with_order("SELECT type, startYear, endYear FROM order_movies"),
    "null_marker_to_null": with_order(
        "SELECT nullif(tconst, '') AS tconst, startYear AS start_raw, nullif(startYear, '\\N') AS startYear, "
        "time AS time_raw, nullif(time, '\\N') AS time FROM file_titles"
    ),
    "split_genres": with_part(
        "SELECT tconst, CAST(len(genres) AS INTEGER) AS n_genres, genres[1] AS genre_1, genres[2] AS genre_2 "
        "FROM part_titles"
    ),
    "join_genres": with_part("SELECT tconst, " + genres_text("genres") + " AS genres FROM part_titles"),
    "primary_genre": with_part("SELECT tconst, genres[1] AS genre FROM part_titles"),
    "effective_year": with_order(
        "SELECT tconst, startYear, endYear, COALESCE(startYear, endYear) AS year FROM order_titles"
    ),
    "parse_numbers": with_order(
        "SELECT nullif(tconst, '') AS tconst, rating AS rating_text, TRY_CAST(rating AS DOUBLE) AS rating, "
        "votes AS votes_text, TRY_CAST(votes AS BIGINT) AS votes FROM file_ratings"
    ),
    "default_minus_one": with_order(
        "SELECT tconst, COALESCE(rating, -1) AS rating, COALESCE(votes, -1) AS votes FROM order_movies"
    ),
    "null_to_text": with_order(
        "SELECT tconst, " + txt("startYear") + " AS startYear, " + txt("rating") + " AS rating, "
        + txt("votes") + " AS votes FROM order_movies"
    ),
    "format_row": with_order("SELECT tconst, " + TITLES_TEXT_LINE + " AS value FROM order_movies"),
    "year_report": YEAR_REPORT,
    # filters
    "filter_movies": with_order("SELECT tconst, type, startYear FROM order_movies WHERE type = 'F'"),
    "filter_rated": with_order("SELECT tconst, rating, votes FROM order_movies WHERE rating IS NOT NULL"),
    "filter_has_genre": with_part("SELECT tconst, genre FROM targets"),
    "exclude_self": with_part(
        "SELECT t.tconst, CAST(count(c.tconst) AS INTEGER) AS n_candidates "
        "FROM targets t JOIN (SELECT DISTINCT genre FROM top2) g ON g.genre = t.genre "
        "LEFT JOIN top2 c ON c.genre = t.genre AND c.tconst <> t.tconst GROUP BY t.tconst"
    ),
    "skip_header": with_order("SELECT tconst FROM file_titles"),
    # joins
    "join_titles_ratings": with_order(MOVIES_FLAT),
    "join_movies_ratings": with_order(
        "SELECT tconst, originalTitle, startYear, " + genres_text("genres") + " AS genres, rating, votes "
        "FROM movies"
    ),
    "recommend_by_genre": with_part("SELECT * FROM recs"),
    # aggregates
    "movies_per_year": with_order(
        "SELECT COALESCE(startYear, endYear) AS year, count(*) AS count FROM movies GROUP BY 1"
    ),
    "most_voted_per_year": with_order("SELECT year, tconst, title, votes FROM most_voted"),
    "yearly_summary": SUMMARY_FLAT,
    "ordered_top_list": with_part(
        "SELECT genre, string_agg(CAST(tconst AS VARCHAR), ',' ORDER BY rank) AS cands FROM top2 GROUP BY genre"
    ),
    # top-n per group
    "top10_rated_per_year": with_order("SELECT year, rank, tconst, title, rating, votes FROM top10"),
    "top2_rated_per_genre": with_part("SELECT genre, rank, tconst, title, rating, votes FROM top2"),
    # sorts
    "order_by_group_key": with_order(
        "SELECT COALESCE(startYear, endYear) AS year, count(*) AS count FROM movies GROUP BY 1 "
        "ORDER BY 1 NULLS LAST"
    ),
    "order_group_then_rank": with_order(
        "SELECT year, tconst, title, rating, votes FROM top10 ORDER BY year NULLS LAST, rating DESC, votes DESC, tconst"
    ),
    "order_recommendations": with_part("SELECT * FROM recs ORDER BY tconst"),
    # end-to-end jobs
    "movies_text": with_order("SELECT " + MOVIES_TEXT_LINE + " AS value FROM file_narrow"),
    "titles_text": with_order("SELECT " + TITLES_TEXT_LINE + " AS value FROM file_movies"),
    "build_movies": with_order(
        "SELECT tconst, type, primaryTitle, originalTitle, isAdult, TRY_CAST(startYear AS INTEGER) AS startYear, "
        "TRY_CAST(endYear AS INTEGER) AS endYear, TRY_CAST(time AS INTEGER) AS time, "
        "TRY_CAST(rating AS DOUBLE) AS rating, TRY_CAST(votes AS BIGINT) AS votes, "
        + genres_text("genres") + " AS genres, " + UNPARSED + " AS unparsed FROM file_movies"
    ),
}
