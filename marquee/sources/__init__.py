from .parquet import read_lookup, read_movies_parquet, read_summary_parquet
from .tsv import count_rejects, read_ratings_tsv, read_titles_tsv, rejected_lines, write_ratings_tsv, write_titles_tsv

__all__ = [
    "count_rejects",
    "read_lookup",
    "read_movies_parquet",
    "read_ratings_tsv",
    "read_summary_parquet",
    "read_titles_tsv",
    "rejected_lines",
    "write_ratings_tsv",
    "write_titles_tsv",
]
