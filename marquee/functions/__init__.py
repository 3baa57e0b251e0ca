from .columns import (
    default_minus_one,
    effective_year,
    format_row,
    join_genres,
    null_marker_to_null,
    null_to_text,
    parse_double,
    parse_int,
    primary_genre,
    project_columns,
    split_genres,
    year_report,
)

__all__ = [
    "default_minus_one",
    "effective_year",
    "format_row",
    "join_genres",
    "null_marker_to_null",
    "null_to_text",
    "parse_double",
    "parse_int",
    "primary_genre",
    "project_columns",
    "split_genres",
    "year_report",
]
