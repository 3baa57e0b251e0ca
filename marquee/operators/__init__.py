from .aggregates import most_voted_per_year, movies_per_year, ordered_top_list, yearly_summary
from .filters import exclude_self, filter_has_genre, filter_movies, filter_rated, with_genre
from .joins import join_movies_ratings, join_titles_ratings
from .ordering import order_by_group_key, order_group_then_rank, order_recommendations
from .recommend import genre_candidates, recommend_by_genre
from .topn import best_rated_order, top2_rated_per_genre, top10_rated_per_year, top_n_per_group

__all__ = [
    "best_rated_order",
    "exclude_self",
    "filter_has_genre",
    "filter_movies",
    "filter_rated",
    "genre_candidates",
    "join_movies_ratings",
    "join_titles_ratings",
    "most_voted_per_year",
    "movies_per_year",
    "order_by_group_key",
    "order_group_then_rank",
    "order_recommendations",
    "ordered_top_list",
    "recommend_by_genre",
    "top10_rated_per_year",
    "top2_rated_per_genre",
    "top_n_per_group",
    "with_genre",
    "yearly_summary",
]
