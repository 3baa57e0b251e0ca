import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import prefixtrie
from marquee.llm.registry import QUERIES
from tests.conftest import SF_ORACLE

from .brute import trie_nodes

ROWS = "conv_id long, turn long, role string, text string"


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def drawn(seed, convs=120, words=3):
    """Conversations over few texts, so that many prefixes meet."""
    draw = random.Random(seed)
    ids = draw.sample(range(-150, 900), convs)
    return [(c, t, draw.choice("ua"), "x" * draw.randrange(words)) for c in ids for t in range(draw.randrange(9))] + [(c, None, None, None) for c in ids[:9]]


def test_query_matches_all_prefixes(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_ORACLE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = QUERIES["op12_prefix_trie"](spark, SF_ORACLE)
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got(df) == sorted(trie_nodes(rows), key=repr)


@pytest.mark.parametrize(("seed", "local"), [(1, 4), (2, 30), (3, 1 << 16)])
def test_components_split_over_the_cluster_or_in_a_group(spark, seed, local):
    rows = drawn(seed)
    df = prefixtrie.conversation_trie(spark.createDataFrame(rows, ROWS), local=local)
    assert got(df) == sorted(trie_nodes(rows), key=repr)


def test_a_long_chain_and_many_copies(spark):
    """One conversation with most rows, copies of another, and one that ends inside them."""
    rows = [(7, t, "u", f"t{t}") for t in range(400)] + [(c, t, "u", "same") for c in range(200, 260) for t in range(12)] + [(300, 0, "u", "same")]
    df = prefixtrie.conversation_trie(spark.createDataFrame(rows, ROWS).repartition(5), local=50)
    assert got(df) == sorted(trie_nodes(rows), key=repr)


def test_defined_cases(spark):
    rows = [(None, 1, "u", "lost"), (5, 2, "u", None), (5, None, None, "first"), (5, 2, "u", None), (5, 2, "a", "tie"), (105, 1, "u", "own"), (-3, 1, "a", "neg"), (8, 1, "u", "é" * 70_000), (8, 1, "u", "é" * 70_000)]
    df = spark.createDataFrame(rows, ROWS)
    assert got(prefixtrie.conversation_trie(df)) == sorted(trie_nodes(rows), key=repr)
    more = df.withColumns({n: F.lit(1) for n in ["conv", "depth", "part", "at", "h1", "pos", "s", "size", "node"]})
    assert got(prefixtrie.conversation_trie(more)) == sorted(trie_nodes(rows), key=repr)
    assert prefixtrie.conversation_trie(df.limit(0)).collect() == []


def test_group_steps_equal_plain_sums():
    draw = random.Random(5)
    for n, deep in [(1, 1), (40, 2), (300, 1), (300, 299)]:
        up = [-1] + [max(0, k - draw.randint(1, deep)) if deep < n - 1 else k - 1 for k in range(1, n)]
        depth = [0] * n
        for k in range(1, n):
            depth[k] = depth[up[k]] + 1
        s, w = np.ones(n, dtype=np.int64), np.array([[draw.randrange(9), draw.randrange(9)] for _ in range(n)])
        want = w.copy()
        for k in range(n - 1, 0, -1):
            s[up[k]] += s[k]
            want[up[k]] += want[k]
        conv, depth = np.arange(n), np.array(depth)
        own = prefixtrie.subtree_totals(conv, depth, np.array([max(u, 0) for u in up]), conv == 0, s, w)
        assert (own == want).all()
