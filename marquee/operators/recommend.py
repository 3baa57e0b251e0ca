"""Same-genre recommendation for every movie.

For each movie with a first genre, recommend that genre's best-rated movie, or
its second best when the best is the movie itself; a genre with no rated movie
gives no row. Unrated movies are recommended to as well.

Plan: the two best per genre (cut before the shuffle, see ``topn``) are folded
into one row per genre holding its first and second candidate. It is
joined to the movies through ``checked_broadcast_join``: broadcast when its
row count is within bound, otherwise a salted shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .broadcast import DEFAULT_MAX_BROADCAST_ROWS, checked_broadcast_join
from ..schemas import MOVIE
from .aggregates import ordered_top_list
from .filters import filter_has_genre, filter_movies, first_other, with_genre
from .topn import top2_rated_per_genre


def genre_candidates(movies: DataFrame, kind: str = MOVIE, n: int = 2, top: DataFrame | None = None) -> DataFrame:
    """(genre, cands) with cands the genre's n best, in rank order.

    ``top`` is an already computed ``top2_rated_per_genre`` result to reuse.
    """
    top = top if top is not None else top2_rated_per_genre(movies, kind, n)
    return ordered_top_list(top, ["genre"], ["tconst", "title", "rating", "votes"], name="cands")


def recommend_by_genre(
    movies: DataFrame,
    kind: str = MOVIE,
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
    scratch: list[str] | None = None,
    top: DataFrame | None = None,
) -> DataFrame:
    """(tconst, title, genre, rating, votes, rec_tconst, rec_title, rec_rating, rec_votes).

    ``scratch`` receives the path of the materialised candidate table, for the
    caller to remove once the result has been written. ``top`` reuses an
    already computed top-2-per-genre table instead of ranking again.
    """
    targets = filter_has_genre(with_genre(filter_movies(movies, kind))).select(
        "tconst", F.col("originalTitle").alias("title"), "genre", "rating", "votes"
    )
    lists = genre_candidates(movies, kind, top=top)
    cands = lists.select("genre", F.get("cands", 0).alias("c1"), F.get("cands", 1).alias("c2"))
    joined = checked_broadcast_join(targets, cands, ["genre"], max_rows=max_broadcast_rows, scratch=scratch)
    rec = first_other([F.col("c1"), F.col("c2")], F.col("tconst"))
    return (
        joined.select("tconst", "title", "genre", "rating", "votes", rec.alias("rec"))
        .where(F.col("rec").isNotNull())
        .select(
            "tconst",
            "title",
            "genre",
            "rating",
            "votes",
            F.col("rec.tconst").alias("rec_tconst"),
            F.col("rec.title").alias("rec_title"),
            F.col("rec.rating").alias("rec_rating"),
            F.col("rec.votes").alias("rec_votes"),
        )
    )
