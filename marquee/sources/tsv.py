"""Raw tab-separated title and rating files (plain, .gz or .bz2).

The reader splits on tabs only: quoting is switched off, so a ``"`` or a
backslash inside a title is an ordinary character (NUL is the one character
a field cannot hold: with quoting off the CSV parser uses it as the quote). The first line of every
file is its header and is skipped. Short lines give NULL for the missing
fields instead of failing the task, fields beyond the last are left out; both
are counted by ``count_rejects`` and given by ``rejected_lines``. The codec
follows the file extension. gzip files do not split: their one task a file only
inflates and cuts lines, which are spread by id and parsed after that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import null_marker_to_null, parse_double, parse_int, parse_long, split_genres
from ..schemas import MOVIES_COLUMNS, NULL_MARKER, RAW_RATINGS, RAW_TITLES, RATINGS_HEADER, TITLE_FIELDS, TITLES_HEADER

# The columns that hold numbers in the raw files.
TITLE_NUMBERS = ("startYear", "endYear", "time")
RATING_NUMBERS = ("rating", "votes")

# Separator of the reader that keeps lines whole: control characters that no text line holds in this order.
LINE_SEPARATOR = "\u001f\u001e\u001f"

TSV_OPTIONS = {
    "sep": "\t",
    "header": "true",
    "quote": "",
    "escape": "",
    "mode": "PERMISSIVE",
    "encoding": "UTF-8",
}


def _read(spark: SparkSession, paths: str | list[str], schema) -> DataFrame:
    return spark.read.schema(schema).options(**TSV_OPTIONS).csv(paths)


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value): the files' lines without their headers, unparsed: one field, cut at a character no text line holds."""
    options = TSV_OPTIONS | {"sep": LINE_SEPARATOR}
    return spark.read.schema("value string").options(**options).csv(paths)


def _spread_lines(spark: SparkSession, paths: str | list[str], schema, partitions: int | None, kind: str | None = None) -> DataFrame:
    """The rows of ``_read``, parsed after lines have been spread by id.

    For files that one task must inflate: that task finds the line ends and the
    id, no more. The exchange by id is the one the join needs.
    """
    fields = F.split("value", "\t")
    lines = _lines(spark, paths)
    if kind is not None and "type" in schema.names:
        lines = lines.where(F.coalesce(F.get(fields, schema.names.index("type")), F.lit("")) == kind)
    # An empty field is a missing one, as in the CSV reader.
    lines = lines.select(F.coalesce(F.substring_index("value", "\t", 1), F.lit("")).alias("tconst"), "value")
    lines = lines.repartition(partitions, "tconst") if partitions else lines.repartition("tconst")
    field = lambda k: F.nullif(F.get(fields, k), F.lit(""))
    return lines.select("tconst", *(field(k).alias(c) for k, c in enumerate(schema.names) if k))


def _inflated_by_one_task(df: DataFrame) -> bool:
    return any(f.lower().endswith(".gz") for f in df.inputFiles())


def _rows(spark: SparkSession, paths: str | list[str], schema, partitions: int | None, kind: str | None = None) -> DataFrame:
    raw = _read(spark, paths, schema)
    if partitions or _inflated_by_one_task(raw):
        return _spread_lines(spark, paths, schema, partitions, kind)
    if kind:
        return raw.where(F.col("type") == F.lit(kind))
    return raw if kind is None else raw.where(F.coalesce("type", F.lit("")) == "")  # the empty type is read as a missing field


def line_fields(spark: SparkSession, paths: str | list[str], schema=RAW_TITLES) -> DataFrame:
    """(value, fields, verdict): every line with its number of fields, ``ok``, ``short`` or ``long`` against ``schema``."""
    n, want = F.size(F.split("value", "\t")), len(schema.names)
    verdict = F.when(n < want, "short").when(n > want, "long").otherwise("ok")
    return _lines(spark, paths).select("value", n.alias("fields"), verdict.alias("verdict"))


def rejected_lines(spark: SparkSession, paths: str | list[str], schema=RAW_TITLES) -> DataFrame:
    """The lines that do not have the declared fields, whole, so that none of their text is lost."""
    return line_fields(spark, paths, schema).where("verdict != 'ok'")


def count_rejects(spark: SparkSession, paths: str | list[str], schema=RAW_TITLES) -> dict[str, int]:
    """How many lines are ``ok``, ``short`` and ``long``, in one aggregated pass."""
    counted = line_fields(spark, paths, schema).groupBy("verdict").count().collect()
    return {"ok": 0, "short": 0, "long": 0} | {r["verdict"]: r["count"] for r in counted}


def read_titles_raw(
    spark: SparkSession, paths: str | list[str], partitions: int | None = None, kind: str | None = None
) -> DataFrame:
    """Title file as text: only ``\\N`` becomes NULL, and genres a list of text.

    ``kind`` keeps one title type; the condition is on the raw column, so it is
    pushed into the scan and other lines are dropped in the parser. ``partitions``
    spreads the lines by id over that many tasks before they are parsed, as is
    done for .gz files anyway.
    """
    return raw_titles(_rows(spark, paths, RAW_TITLES, partitions, kind))


def raw_titles(raw: DataFrame) -> DataFrame:
    """All-string title rows with missing values told apart from empty text."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return raw.select(
        text("tconst"),
        text("type"),
        text("primaryTitle"),
        text("originalTitle"),
        text("isAdult"),
        *(null_marker_to_null(c).alias(c) for c in TITLE_NUMBERS),
        split_genres("genres").alias("genres"),
    )


def read_ratings_raw(spark: SparkSession, paths: str | list[str], partitions: int | None = None) -> DataFrame:
    """Rating file as text: (tconst, rating, votes), ``\\N`` as NULL."""
    raw = _rows(spark, paths, RAW_RATINGS, partitions)
    numbers = [null_marker_to_null(c).alias(c) for c in RATING_NUMBERS]
    return raw.select(F.coalesce("tconst", F.lit("")).alias("tconst"), *numbers)


def read_titles_tsv(spark: SparkSession, paths: str | list[str], partitions: int | None = None) -> DataFrame:
    """Title file to typed titles.

    ``\\N`` becomes NULL in startYear, endYear, time and genres only; the
    identifying and text columns keep their text as is, and an empty text field
    stays the empty string.
    """
    return read_titles_raw(spark, paths, partitions).withColumns({c: parse_int(c) for c in TITLE_NUMBERS})


def read_ratings_tsv(spark: SparkSession, paths: str | list[str], partitions: int | None = None) -> DataFrame:
    """Rating file to (tconst, rating double, votes bigint); unparsable numbers are NULL."""
    return read_ratings_raw(spark, paths, partitions).withColumns({"rating": parse_double("rating"), "votes": parse_long("votes")})


def type_movies(joined: DataFrame) -> DataFrame:
    """Joined raw rows to the typed movie table; what does not parse stays as text in ``unparsed``."""
    typed = {c: parse_int(c) for c in TITLE_NUMBERS} | {"rating": parse_double("rating"), "votes": parse_long("votes")}
    lost = [F.when(F.col(c).isNotNull() & v.isNull(), F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))) for c, v in typed.items()]
    entries = F.filter(F.array(*lost), lambda x: x.isNotNull())
    unparsed = F.when(F.coalesce(*lost).isNotNull(), F.map_from_entries(entries))
    return joined.select(*(typed[c].alias(c) if c in typed else F.col(c) for c in MOVIES_COLUMNS), unparsed.alias("unparsed"))


def write_raw_tsv(rows: DataFrame, path: str, compression: str | None = None) -> str:
    """Write all-string title or rating rows (missing values already ``\\N``) with a header line."""
    header = TITLES_HEADER if len(rows.columns) == len(TITLE_FIELDS) else RATINGS_HEADER
    write_tsv_lines(rows.select(F.concat_ws("\t", *rows.columns).alias("value")), path, header, compression)
    return path


def write_titles_tsv(titles: DataFrame, path: str, compression: str | None = None) -> str:
    """Write typed titles in the raw layout (header line, ``\\N`` for missing values).

    The format has no way to tell a missing genre list from an empty one or
    from a list holding one missing element: all three are written as ``\\N``
    and read back as a missing list.
    """
    marker = F.lit(NULL_MARKER)
    cells = [F.coalesce(F.col(c).cast("string"), marker) for c in TITLE_FIELDS[:-1]]
    listed = F.when(F.size("genres") > 0, F.array_join("genres", ",", NULL_MARKER))
    genres = F.coalesce(listed, marker)
    line = F.concat_ws("\t", *cells, genres)
    write_tsv_lines(titles.select(line.alias("value")), path, TITLES_HEADER, compression)
    return path


def write_ratings_tsv(ratings: DataFrame, path: str, compression: str | None = None) -> str:
    """Write ratings in the raw layout (header line, ``\\N`` for missing values)."""
    marker = F.lit(NULL_MARKER)
    line = F.concat_ws(
        "\t", *[F.coalesce(F.col(c).cast("string"), marker) for c in ("tconst", "rating", "votes")]
    )
    write_tsv_lines(ratings.select(line.alias("value")), path, RATINGS_HEADER, compression)
    return path


def write_tsv_lines(lines: DataFrame, path: str, header: str, compression: str | None = None) -> None:
    """Write one text column as lines, with ``header`` at the top of every part file.

    The CSV writer is used for its per-file header; with one column, a separator
    that never occurs and quoting off, each value is written verbatim.
    """
    writer = (
        lines.withColumnRenamed("value", header)
        .write.mode("overwrite")
        .option("header", "true")
        .option("sep", "\u0001")
        .option("quote", "")
        .option("escape", "")
        .option("escapeQuotes", "false")
        .option("emptyValue", "")
        # the writer trims blanks by default; lines must pass untouched
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
    )
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)
