"""Parquet sources: the joined movie table, the nested yearly summary, and the
small top-per-genre lookup read back from its text form.

Declared columns are checked against the files' footers before a query is planned:
with a declared schema alone, Spark reads a column that a file lacks as NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import parse_double, parse_long
from ..schemas import MOVIES, PROJECTIONS, SUMMARY


def _plain(kind: T.DataType) -> T.DataType:
    """The type without nullability, which files do not keep."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType), True) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(_plain(kind.keyType), _plain(kind.valueType), True)
    return kind


def check_columns(found: T.StructType, declared: T.StructType, where: str) -> None:
    """Raise if a declared column is missing or of another type; further columns are fine."""
    have = {f.name: f.dataType for f in found}
    wrong = [f"{f.name}: missing" for f in declared if f.name not in have]
    wrong += [
        f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}"
        for f in declared
        if f.name in have and _plain(have[f.name]) != _plain(f.dataType)
    ]
    if wrong:
        raise ValueError(f"{where} does not hold the declared columns ({'; '.join(wrong)})")


def _declared(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    check_columns(spark.read.parquet(path).schema, schema, path)
    return spark.read.schema(schema).parquet(path)


def read_movies_parquet(spark: SparkSession, path: str, columns: list[str] | str | None = None) -> DataFrame:
    """Read the movie table with only the columns a query needs.

    ``columns`` is a list, the name of a known projection (``PROJECTIONS``), or
    None for every column of ``MOVIES``. The projection reaches the scan's ReadSchema, and a
    later filter on ``type`` becomes a pushed Parquet filter. Raises ValueError if a
    wanted column is missing or of another type; one footer is read for this, as
    the files of a table come from one job.
    """
    names = PROJECTIONS[columns] if isinstance(columns, str) else columns or MOVIES.names
    wanted = T.StructType([MOVIES[n] for n in names])
    return _declared(spark, path, wanted).select(*names)


def read_summary_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read the nested one-row-per-year summary back; raises as ``read_movies_parquet`` does."""
    return _declared(spark, path, SUMMARY)


def read_lookup(spark: SparkSession, path: str, key_type: str = "string") -> DataFrame:
    """Read ranked group lines (``group\\ttconst\\ttitle\\trating\\tvotes``) as a table.

    This is the top-per-genre result in its text form; the recommendation join
    normally takes the DataFrame directly and needs no file in between.
    """
    parts = F.split(F.col("value"), "\t")
    return spark.read.text(path).select(
        F.get(parts, 0).alias("genre"),
        F.get(parts, 1).try_cast(key_type).alias("tconst"),
        F.get(parts, 2).alias("originalTitle"),
        parse_double(F.get(parts, 3)).alias("rating"),
        parse_long(F.get(parts, 4)).alias("votes"),
    )
