"""Exact top-k inner-product search, one term at a time, over blocks of vectors.

Components become whole numbers, ``floor(scale * x)``; a vector's non-zero
components are its terms. Rows are dealt into blocks by a hash, queries into
blocks of their own, and every cell (row block, query block) is one group of
bounded size. In a cell the rows become postings, one list of (slot, weight)
for each term. The sparse query rows that hold a term scatter their weighted
postings into dense score arrays; then each query's best rows are picked by
partition selection, and the cells' picks are merged by rank. Nothing is
pruned: every row is scored against every query.

Queries do not fit one broadcast when they grow with the table, so both sides
are shuffled: each row once per query block, each query once per row block.

Defined cases: a null vector, or one with a null or non-finite component, takes
no part, neither as a query nor as a row. An empty vector scores 0. Vectors of
different lengths are compared over the terms they share. A query never meets
rows of its own id; a row without an id is a candidate, last in a tie. Repeated
rows are candidates each; repeated equal queries are answered once, queries of
one id with different vectors each on their own. Components and scores beyond
64 bits end at the greatest long. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import ship, table, written

K = 10
SCALE = 1024
#: Rows and queries of one cell, at most about: bounds on a group.
ROWS, QUERIES = 1 << 16, 1 << 13
#: Scores held at a time in a cell.
SCORES = 1 << 22
_LONG = 1 << 63


class Postings:
    """Non-zero components of a list column, grouped by term: (slots, weights) each."""

    def __init__(self, vectors: pa.Array):
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        weights = vectors.flatten().to_numpy(zero_copy_only=False)
        slots = np.repeat(np.arange(len(sizes)), sizes)
        terms = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        held = weights != 0
        order = np.argsort(terms[held], kind="stable")
        self.slots, self.weights = slots[held][order], weights[held][order]
        self.terms, self.first = np.unique(terms[held][order], return_index=True)
        self.ends = np.append(self.first[1:], len(self.slots))
        # Rounded up to floats first, as the least long has no positive twin.
        self.greatest = float(np.abs(weights.astype(np.float64)).max(initial=0))

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for term, a, b in zip(self.terms.tolist(), self.first, self.ends, strict=True):
            yield term, self.slots[a:b], self.weights[a:b]


def accumulate(queries: dict[int, tuple[np.ndarray, np.ndarray]], n_queries: int, postings: Postings, n: int, kind: type) -> np.ndarray:
    """Scores (query, slot): each query term adds its weight times the term's postings."""
    scores = np.zeros((n_queries, n), dtype=kind)
    for term, slots, weights in postings:
        if term not in queries:
            continue
        rows, own = queries[term]
        share = own.astype(kind)[:, None] * weights.astype(kind)[None, :]
        if len(slots) == n:  # a full posting list needs no scattering
            scores[rows] += share
        else:
            scores[rows[:, None], slots[None, :]] += share
    return scores


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Slots of the ``k`` greatest scores, best first, ties to the smaller slot."""
    if k >= len(scores):
        return np.argsort(-scores, kind="stable")
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    own = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    return own[np.argsort(-scores[own], kind="stable")]


def _by_id(rows: pa.Table) -> pa.Table:
    return rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_end")).combine_chunks()


def _column(rows: pa.Table, name: str) -> pa.Array:
    column = rows.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


_PICKED = pa.schema([("query_id", pa.int64()), ("sig", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _cell(k: int):
    """The best rows of one row block for each query of one query block."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        n = rows.num_rows
        if not n or not queries.num_rows:
            return _PICKED.empty_table()
        rows = _by_id(rows)  # slots in the order that breaks ties
        ids = _column(rows, "id")
        known = ids.drop_null().to_numpy()
        postings = Postings(_column(rows, "vector"))
        out = []
        step = max(1, SCORES // n)
        for low in range(0, queries.num_rows, step):
            part = queries.slice(low, step)
            asked, sig = _column(part, "id").to_numpy(), _column(part, "sig").to_numpy()
            own = Postings(_column(part, "vector"))
            # Whole sums stay below 2 ** 62, else Python's own integers are added up.
            small = postings.greatest * own.greatest * max(1, len(postings.terms)) < 2.0**62
            scores = accumulate({t: (s, w) for t, s, w in own}, len(asked), postings, n, np.int64 if small else object)
            left, right = np.searchsorted(known, asked, "left"), np.searchsorted(known, asked, "right")
            for q in range(len(asked)):
                others = np.delete(np.arange(n), slice(left[q], right[q])) if right[q] > left[q] else np.arange(n)
                best = others[select(scores[q][others], k)]
                value = scores[q][best]
                value = value if small else np.array([min(max(int(x), -_LONG), _LONG - 1) for x in value], dtype=np.int64)
                out.append((np.full(len(best), asked[q]), np.full(len(best), sig[q]), best, value))
        asked, sig, best, value = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(asked), pa.array(sig), ids.take(pa.array(best)), pa.array(value)], schema=_PICKED)

    return run


def whole(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(id, vector)``: whole components of the rows whose vector is finite throughout."""
    x = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return x.filter(F.col("v").isNotNull() & finite).select("id", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c)).alias("vector"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, most: tuple[int, int] = (ROWS, QUERIES)) -> DataFrame:
    """``(query_id, rank, <id_col>, score)``: the ``k`` rows of greatest inner product for each query, its own id left out."""
    spark = rows.sparkSession
    ship(spark)
    rows = written(whole(rows, id_col, vector_col, scale), "vectors")
    asked = whole(queries.filter(F.col(id_col).isNotNull()), id_col, vector_col, scale).distinct()
    asked = written(asked.withColumn("sig", F.xxhash64("vector")), "queries")
    n_rows, n_queries = rows.count(), asked.count()
    # At least as many cells as cores on a small table, and no more than a cell's bound of rows on a large one.
    fine = min(-(-n_rows // 2048), 4 * spark.sparkContext.defaultParallelism)
    row_blocks, query_blocks = max(1, fine, -(-n_rows // most[0])), max(1, -(-n_queries // most[1]))
    block = lambda *by: F.pmod(F.xxhash64(*by), F.lit(by_blocks))
    by_blocks = row_blocks
    # The place in the written table, too: rows that repeat one id must not meet in one block.
    cells = rows.withColumn("g", block("id", F.monotonically_increasing_id()))
    cells = cells.withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    by_blocks = query_blocks
    asked = asked.withColumn("h", block("id", "sig"))
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))))
    picked = cells.groupBy("g", "h").cogroup(asked.groupBy("g", "h")).applyInArrow(_cell(k), "query_id long, sig long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "sig").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return picked.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op11_top_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter(F.col("vec_id") % 100 == 0))


def oracle() -> str:
    return f"""WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id),
    ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}"""
