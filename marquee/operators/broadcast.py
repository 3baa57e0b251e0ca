"""Joining a large table to a small one whose size is checked, not assumed.

The small side is materialised once as a Parquet table written under the
shared ``spark.checkpoint.dir`` (so it survives executor loss and cuts its
lineage); its rows and their serialised bytes are counted while it is
written. Within the row and byte bounds it is broadcast: the
large side is never shuffled. Beyond them, both sides are shuffled on the key
plus a salt, with the small side copied once per salt value, so a key holding
a third of the large side is spread over ``fan_out`` tasks at once; AQE's
skew-join splitting divides whatever imbalance is left. ``fan_out`` is a
fixed number, not the shuffle partition count: the copies of the small side
grow with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..runtime import scratch_path

# Default bounds for broadcasting: rows of the small side (one per group key),
# and their uncompressed size (each row serialised as JSON, so close to its
# in-memory size, not the compressed Parquet size), well under executor memory.
DEFAULT_MAX_BROADCAST_ROWS = 200_000
DEFAULT_MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Salt values of the shuffle fallback (copies of the small side).
DEFAULT_FAN_OUT = 32
# Join types whose result the copies of the small side leave unchanged
# (Spark's spellings, compared without case or underscores).
SALTABLE_JOINS = ("inner", "left", "leftouter", "leftsemi", "semi", "leftanti", "anti")


def materialize(df: DataFrame, name: str = "materialized") -> tuple[DataFrame, int, int, str]:
    """Write ``df`` once to the shared checkpoint folder.

    Returns it read back, its row count, its uncompressed byte count and its path.
    Unlike an eager ``checkpoint()`` of an uncached plan, the plan runs once.
    Rows and bytes are counted while they are written (observed metrics, no
    second job), and the table is read back with its known schema (no footer
    scan).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    seen = Observation(f"{name}_size")
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))
    df.observe(seen, F.count(F.lit(1)).alias("rows"), size.alias("bytes")).write.mode("overwrite").parquet(path)
    metrics = seen.get
    return spark.read.schema(df.schema).parquet(path), int(metrics["rows"]), int(metrics["bytes"]), path


def checked_broadcast_join(
    large: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salt_by: Sequence[str] = ("tconst",),
    max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
    fan_out: int = DEFAULT_FAN_OUT,
    max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
    scratch: list[str] | None = None,
) -> DataFrame:
    """Write ``small`` now, then plan ``large.join(small, on, how)``, broadcasting ``small`` only within ``max_rows`` and ``max_bytes``.

    The materialised small side stays under the checkpoint folder; pass a list
    as ``scratch`` to receive its path and remove it once the result is written.
    """
    if how.lower().replace("_", "") not in SALTABLE_JOINS:  # whatever the size of ``small``
        raise ValueError(f"a {how!r} join cannot be salted exactly")
    small, rows, size, path = materialize(small, "broadcast_side")
    if scratch is not None:
        scratch.append(path)
    if rows <= max_rows and size <= max_bytes:
        return large.join(F.broadcast(small), list(on), how)
    salts = max(1, fan_out)
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted_large = large.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    return salted_large.join(salted_small, [*on, "_salt"], how).drop("_salt")
