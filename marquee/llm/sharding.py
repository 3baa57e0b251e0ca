"""Sharding by longest processing time, exact on a histogram.

Rows of equal text form a group that stays in one shard. Groups go, from the
largest down, to the least-loaded shard (the law is ``bytes``: shard sizes near
equal). The driver schedules classes instead of groups: a class is a group size
(sizes from ``EXACT`` on are rounded down to ``DIGITS`` binary digits, so there
are at most ``EXACT + 2 ** (DIGITS - 1) * 64`` classes, whatever the data), and
its result says how many groups of each class every shard gets. Groups find
their shard by their rank within the class, rows by their group.

Defined cases: a null text has the size of an empty one and is grouped with
it; a null doc_id is a row like others; repeated rows each get a slot. Ties in
load go to the lowest shard. An empty table gives an empty result; further
columns are not carried.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import shuffle_partitions, table, written

SHARDS = 24
OVERHEAD = 8
EXACT = 1 << 16
DIGITS = 11


def deal(classes: list[tuple[int, int, int]], shards: int = SHARDS) -> list[tuple[int, list[int]]]:
    """Longest-processing-time scheduling of ``(class, groups, bytes)`` rows.

    Returns for each class the running number of its groups that shards 0..k
    get. Large classes are levelled in one go: equal groups fill the shards up
    to a common load, and only the rest goes through the heap one by one.
    """
    heap = [(0.0, k) for k in range(shards)]
    out = []
    for name, groups, total in sorted(classes, key=lambda c: (-c[2] / c[1], -c[0])):
        size = total / groups
        given = [0] * shards
        left = groups
        while left > 4 * shards:
            goal = heapq.nsmallest(shards, heap)
            # The level the lightest shards reach when they alone take what is left.
            used, level = 0.0, 0.0
            for k, (load, _) in enumerate(goal, 1):
                used += load
                level = (used + left * size) / k
                if k == shards or goal[k][0] >= level:
                    break
            before = left
            heap = []
            for load, shard in goal:
                n = min(left, max(0, int((level - load) // size) - 1))
                given[shard] += n
                left -= n
                heap.append((load + n * size, shard))
            heapq.heapify(heap)
            if left == before:
                break
        for _ in range(left):
            load, shard = heap[0]
            given[shard] += 1
            heapq.heapreplace(heap, (load + size, shard))
        for k in range(1, shards):
            given[k] += given[k - 1]
        out.append((name, given))
    return out


def _ranked(df: DataFrame, by: list[str], part: str, order: list[str], name: str) -> DataFrame:
    """``df`` with a gapless number from 0 within ``by``, counted in parts and shifted by the parts before."""
    sizes = df.groupBy(*by, part).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*by, part, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(*by, part).orderBy(*order)) - 1
    return df.withColumn("_in", inside).join(shift, [*by, part]).withColumn(name, F.col("_shift") + F.col("_in")).drop("_in", "_shift", part)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    parts = F.lit(shuffle_partitions(spark))
    text = F.coalesce("text", F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("group"),  # texts that collide merely stay together
        ),
        "shard-rows",
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    cut = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2("bytes")) - DIGITS + 1, F.lit(0))).cast("long")
    groups = groups.withColumn("class", F.when(F.col("bytes") < EXACT, F.col("bytes")).otherwise(F.col("bytes") - F.col("bytes") % cut))
    groups = written(groups, "shard-groups")
    histogram = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("total")).collect()
    dealt = deal([tuple(r) for r in histogram], shards)
    plan = spark.createDataFrame(dealt, "class long, upto array<long>")
    ranked = _ranked(groups.withColumn("part", F.pmod("group", parts)), ["class"], "part", ["group"], "rank")
    placed = ranked.join(F.broadcast(plan), "class").select(  # one row per class: a bounded number
        "group", F.size(F.filter("upto", lambda x: x <= F.col("rank"))).alias("shard")
    )
    assigned = rows.join(placed, "group").withColumn("part", F.pmod(F.xxhash64("doc_id", "group"), parts))
    assigned = written(assigned, "shard-assigned")
    out = _ranked(assigned, ["shard"], "part", ["doc_id", "group"], "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
