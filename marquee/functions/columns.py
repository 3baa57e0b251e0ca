"""Scalar column expressions (projections, parsing, null handling, rendering).

All are built-in Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import NULL_MARKER

# The text a missing value prints as, the value a missing rating
# or vote count ranks and prints as, the separators of the text formats, and
# the report's list heading and entry mark.
NULL_TEXT = "null"
MISSING_NUMBER = -1
FIELD_SEP = "\t"
GENRE_SEP = ","
REPORT_LIST_HEADING = "Top 10:"
REPORT_ENTRY_MARK = "- "


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def project_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep only the columns a query needs; Catalyst prunes the scan to them."""
    return df.select(*columns)


def null_marker_to_null(c: str | Column, marker: str = NULL_MARKER) -> Column:
    """The raw files' missing marker becomes a real NULL (per column, never reader-wide)."""
    return F.nullif(_col(c), F.lit(marker))


def split_genres(c: str | Column, marker: str = NULL_MARKER) -> Column:
    """Comma text to a list; a missing field is a NULL list, a missing element a NULL element.

    The per-element lambda (not code-generated) runs only for the rare fields
    that hold the marker at all; every other field takes the plain split.
    """
    text = _col(c)
    marked = F.transform(
        F.split(null_marker_to_null(text, marker), GENRE_SEP), lambda g: F.nullif(g, F.lit(marker))
    )
    return F.when(text.contains(marker), marked).otherwise(F.split(text, GENRE_SEP))


def join_genres(c: str | Column) -> Column:
    """List back to comma text; NULL elements print as ``null``."""
    return F.array_join(_col(c), GENRE_SEP, NULL_TEXT)


def primary_genre(c: str | Column = "genres") -> Column:
    """First element of the genre list, NULL when the list or its head is missing."""
    return F.get(_col(c), 0)


def effective_year(start: str | Column = "startYear", end: str | Column = "endYear") -> Column:
    """startYear, falling back to endYear (used by the per-year count only)."""
    return F.coalesce(_col(start), _col(end))


def parse_int(c: str | Column) -> Column:
    """Text to int; unparsable text gives NULL instead of failing the task."""
    return _col(c).try_cast("int")


def parse_long(c: str | Column) -> Column:
    """Text to bigint (vote counts may pass the int range); unparsable text gives NULL."""
    return _col(c).try_cast("bigint")


def parse_double(c: str | Column) -> Column:
    """Text to double; unparsable text gives NULL instead of failing the task."""
    return _col(c).try_cast("double")


def default_minus_one(c: str | Column) -> Column:
    """A missing rating or vote count is shown, and ranked, as -1."""
    return F.coalesce(_col(c), F.lit(MISSING_NUMBER))


def null_to_text(c: str | Column) -> Column:
    """Render any scalar as text, NULL as ``null`` (``concat_ws`` would skip it)."""
    return F.coalesce(_col(c).cast("string"), F.lit(NULL_TEXT))


def format_row(*cols: str | Column) -> Column:
    """Tab-joined text of the given columns, NULLs printed as ``null``."""
    return F.concat_ws(FIELD_SEP, *[null_to_text(c) for c in cols])


def report_entry(entry: Column, position: Column) -> Column:
    """One numbered line of a top list: ``<pos>- tconst\\ttitle\\trating\\tvotes``."""
    return F.concat(
        (position + 1).cast("string"),
        F.lit(REPORT_ENTRY_MARK),
        format_row(entry["tconst"], entry["originalTitle"], entry["rating"], entry["votes"]),
        F.lit("\n"),
    )


def year_report(summary: DataFrame) -> DataFrame:
    """Render each yearly summary row as the text block of the report.

    Layout per year: ``year\\tcount\\ttconst\\ttitle\\tvotes``, a ``Top 10:`` line,
    then one numbered line per list entry; the text sink's line end closes the
    block with an empty line.
    """
    header = format_row("year", "number_of_movies", "tconst_most_votes", "title_most_votes", "number_of_votes")
    lines = F.array_join(F.transform("top10", lambda e, i: report_entry(e, i)), "")
    return summary.select(
        "year",
        F.concat(header, F.lit(f"\n{REPORT_LIST_HEADING}\n"), lines).alias("report"),
    )
