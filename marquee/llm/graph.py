"""Connected components of an edge table by contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import written


def contract(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)``; the root is the component's smallest node.

    Each round hooks every node to its smallest neighbour, follows that twice,
    and maps the edges onto the hooks; edges within one root go. Rounds end
    when no edge is left, after about the logarithm of the longest path.
    """
    edges = written(edges.filter("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        hooks = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        onward = hooks.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        hooks = written(hooks.join(onward, "p").select("u", F.col("pp").alias("p")), "hooks")
        if roots is None:
            roots = hooks.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            moved = roots.join(hooks, F.col("root") == F.col("u"), "left")
            roots = written(moved.select("node", F.coalesce("p", "root").alias("root")), "roots")
        left = hooks.select("u", F.col("p").alias("pu"))
        right = hooks.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        on = edges.join(left, "u").join(right, "v").filter("pu != pv")
        edges = written(on.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
