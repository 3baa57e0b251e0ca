"""Catalogue-and-ratings analytics on Spark DataFrames.

Read a title table and a rating table, join them into one movie table, and
answer the per-year and per-genre questions over it with Spark's own joins,
windows and aggregates.
"""

from .operators import (
    join_movies_ratings,
    join_titles_ratings,
    most_voted_per_year,
    movies_per_year,
    recommend_by_genre,
    top2_rated_per_genre,
    top10_rated_per_year,
    top_n_per_group,
    yearly_summary,
)

__all__ = [
    "join_movies_ratings",
    "join_titles_ratings",
    "most_voted_per_year",
    "movies_per_year",
    "recommend_by_genre",
    "top2_rated_per_genre",
    "top10_rated_per_year",
    "top_n_per_group",
    "yearly_summary",
]
