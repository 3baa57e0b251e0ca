"""Prefix trie of conversations, rolled up by centroid decomposition.

Conversations that start with the same turns share the trie's nodes. A node is
named by its smallest member and its depth. A prefix is known by two polynomials
over its turns' hashes, modulo 2**64, so nodes come from one grouping of all
prefixes, and the prefix of a rebuilt conversation follows from those of the two
conversations it is made of.

The forest of parent edges is rolled up by its centroids. In a component, the
nodes whose part of it is more than half of it form a path from the top; the
lowest of them is the centroid. What lies at or below the centroid is totalled
and added along the path; then the component falls into the part above and one
part below each child, none more than half as large. After the logarithm of the
largest component every node holds its subtree's total, however deep the trie.
Components beyond ``LOCAL`` nodes are split by joins over the cluster; smaller
ones, several to a group, by the same steps on arrays.

Rows are numbered and summed within range partitions, so one conversation with a
third of all rows is spread; only the first and last conversation of a partition
can go on in another, and these few sums are carried over. The digest of a node's
ends is sequential; where it has several, their ids stream past in order.

Defined cases: a null role or text is empty; a null turn comes first; rows of
the same turn are ordered by role, then text; repeated rows are turns each.
Rows without a conv_id take no part. ``c - c % 100`` keeps c's sign. An empty
table has no trie: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import ship, shuffle_partitions, table, written
from marquee.runtime import scratch_path

#: Nodes of a component that one group may hold.
LOCAL = 1 << 16
#: Components that may be split at once: bounds what is broadcast.
SPLIT = 100_000
#: A rebuilt conversation starts with fewer turns of its block's first one than this.
HEAD = 6
BLOCK = 100
#: Odd, so that each has an inverse modulo 2**64: the polynomials' bases.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_U = np.uint64
_MOD = 1 << 64


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** 0`` to ``base ** n`` modulo 2**64."""
    steps = np.full(n + 1, base % _MOD, dtype=_U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and prefix polynomials within one sorted partition; ``edge`` marks the sums that another one may need.

    A row is held back until the next batch, to know whether it is the last.
    """
    names = ["conv", "part", "pos", "p0", "p1", "chars", "edge"]
    first = conv_now = None
    pos_now, sum_now, power_now = 0, [0, 0], [1, 1]
    held: pa.RecordBatch | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv").to_numpy()
        first = conv[0] if first is None else first
        new = np.concatenate([[conv[0] != conv_now], conv[1:] != conv[:-1]])
        run = np.cumsum(new)  # 0: the run that goes on from the batch before
        start = np.concatenate([[0], np.flatnonzero(new)]) if not new[0] else np.flatnonzero(new)
        at = start[run - new[0]]
        goes_on = run == 0
        pos = np.arange(n) - at + 1 + np.where(goes_on, pos_now, 0)
        columns = []
        for k, base in enumerate(BASES):
            power = _powers(base, n)
            hashes = batch.column(f"h{k}").to_numpy().view(_U)
            lead = np.where(goes_on, _U(power_now[k]), _U(1))
            terms = hashes * power[np.arange(n) - at + 1] * lead
            total = np.cumsum(terms, dtype=_U)
            columns.append(total - (total[at] - terms[at]) + np.where(goes_on, _U(sum_now[k]), _U(0)))
            power_now[k] = int(power[n - at[-1]]) * int(lead[-1]) % _MOD
        conv_now, pos_now, sum_now = conv[-1], int(pos[-1]), [int(c[-1]) for c in columns]
        edge = (conv == first) & np.concatenate([conv[1:] != conv[:-1], [False]])
        out = [batch.column("conv"), batch.column("part"), pa.array(pos), *(pa.array(c.view(np.int64)) for c in columns), batch.column("chars"), pa.array(edge)]
        out = pa.RecordBatch.from_arrays(out, names=names)
        if held is not None:
            yield _with_last(held, bool(held.column("conv")[-1].as_py() == first and first != conv[0]))
        held = out
    if held is not None:
        yield _with_last(held, True)


def _with_last(batch: pa.RecordBatch, edge: bool) -> pa.RecordBatch:
    flags = batch.column("edge").to_numpy(zero_copy_only=False).copy()
    flags[-1] |= edge
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(flags)], names=batch.schema.names)


def _carried(edges: list[tuple[int, int, int, int, int]]) -> list[tuple[int, ...]]:
    """``(conv, part, pos0, s0, s1, f0, f1)`` for each edge that earlier partitions hold rows of; (conv, part, pos, p0, p1) come in."""
    out, before = [], {}
    signed = lambda x: x - _MOD if x >= _MOD >> 1 else x
    for conv, part, pos, *sums in sorted(edges, key=lambda e: (e[0], e[1])):
        pos0, held = before.get(conv, (0, (0, 0)))
        factor = [pow(b, pos0, _MOD) for b in BASES]
        if pos0:
            out.append((conv, part, pos0, *map(signed, held), *map(signed, factor)))
        before[conv] = pos0 + pos, tuple((h + f * s) % _MOD for h, f, s in zip(held, factor, sums, strict=True))
    return out


def _apply_carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda c: batch.column(c).to_numpy()  # noqa: B023, E731
        sums = [(get(f"s{k}").view(_U) + get(f"f{k}").view(_U) * get(f"p{k}").view(_U)).view(np.int64) for k in range(2)]
        columns = [batch.column("conv"), pa.array(get("pos") + get("pos0")), *map(pa.array, sums), batch.column("chars")]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", "pos", "p0", "p1", "chars"])


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv, pos, p0, p1, chars)``: each row's place in its conversation, the prefix up to it, its text's code points."""
    spark = conversations.sparkSession
    ship(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text")
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    placed = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select(
        "conv",
        F.spark_partition_id().cast("long").alias("part"),
        F.xxhash64(F.lit("one"), "role", "text").alias("h0"),
        F.xxhash64(F.lit("two"), "text", "role").alias("h1"),
        F.length("text").cast("long").alias("chars"),
    )
    placed = written(placed.mapInArrow(_along, "conv long, part long, pos long, p0 long, p1 long, chars long, edge boolean"), "turns")
    # Two rows for each partition at most.
    edges = [tuple(r) for r in placed.filter("edge").select("conv", "part", "pos", "p0", "p1").collect()]
    carried = spark.createDataFrame(_carried(edges), "conv long, part long, pos0 long, s0 long, s1 long, f0 long, f1 long")
    both = placed.drop("edge").join(F.broadcast(carried), ["conv", "part"], "left").fillna({"pos0": 0, "s0": 0, "s1": 0, "f0": 1, "f1": 1})
    return both.mapInArrow(_apply_carried, "conv long, pos long, p0 long, p1 long, chars long")


def _rebase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of a conversation's own turns, moved behind the turns that its block's first one lends."""
    for batch in batches:
        get = lambda c: batch.column(c).to_numpy()  # noqa: B023, E731
        h, m = get("h"), get("m")
        back = [_powers(pow(b, -1, _MOD), int((h - m).max(initial=0))) for b in BASES]
        sums = []
        for k in range(2):
            own = get(f"p{k}").view(_U) - get(f"own{k}").view(_U)
            sums.append((get(f"lent{k}").view(_U) + back[k][h - m] * own).view(np.int64))
        d = get("pos") - h + m
        columns = [batch.column("conv"), pa.array(d), *map(pa.array, sums), batch.column("chars"), pa.array(d == get("turns"))]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", "d", "p0", "p1", "chars", "end"])


def rebuilt(turns: DataFrame, head: int = HEAD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(conv, d, p0, p1, chars, end)``: prefixes of the rebuilt conversations; and ``(conv, turns)`` of all of them."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % head
    firsts = {c: F.array(*(F.max(F.when(F.col("pos") == k, F.col(c))) for k in range(1, head))) for c in ("p0", "p1", "chars")}
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"), *(x.alias(f"first_{c}") for c, x in firsts.items()))
    convs = written(convs.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % block}), "firsts")
    lent = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), *(F.col(f"first_{c}").alias(f"base_{c}") for c in firsts))
    zero = F.lit(0).cast("long")
    at = lambda c, k: F.coalesce(F.get(c, (F.col(k) - 1).cast("int")), zero)
    convs = convs.join(lent, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", zero)))
    convs = convs.select(
        "conv", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), zero)).alias("turns"),
        *(at(f"base_p{k}", "m").alias(f"lent{k}") for k in range(2)), *(at(f"first_p{k}", "h").alias(f"own{k}") for k in range(2)),
        *(f"base_{c}" for c in firsts),
    )
    convs = written(convs, "convs")
    heads = convs.filter("m > 0").withColumn("d", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    heads = heads.select("conv", "d", *(at(f"base_{c}", "d").alias(c) for c in ("p0", "p1", "chars")), (F.col("d") == F.col("turns")).alias("end"))
    known = convs.select("conv", "h", "m", "turns", "lent0", "lent1", "own0", "own1")
    tails = turns.join(known, "conv").filter("pos > h").mapInArrow(_rebase, "conv long, d long, p0 long, p1 long, chars long, end boolean")
    return written(heads.union(tails), "rebuilt"), convs.select("conv", "turns")


def trie(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(conv, depth, n_convs, chars, n_ends, only)`` named by smallest member and depth, and
    ``(conv, depth, node, end, n_ends)``: for each conversation, the node's smallest member at each depth."""
    prefix = ["d", "p0", "p1"]
    ends = [F.sum(F.col("end").cast("long")).alias("n_ends"), F.min(F.when(F.col("end"), F.col("conv"))).alias("only")]
    named = rows.groupBy(*prefix).agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), *ends)
    named = written(named, "named")
    members = rows.select("conv", *prefix, "end").join(named.select(*prefix, "node", "n_ends"), prefix)
    turnless = F.col("turns") == 0
    root = convs.agg(F.min("conv"), F.count("*"), F.sum(turnless.cast("long")), F.min(F.when(turnless, F.col("conv")))).first()
    long = lambda x: F.lit(x).cast("long")
    top = convs.select("conv", long(0).alias("depth"), long(root[0]).alias("node"), turnless.alias("end"), long(root[2]).alias("n_ends"))
    paths = written(members.select("conv", F.col("d").alias("depth"), "node", "end", "n_ends").union(top), "paths")
    nodes = named.select(F.col("node").alias("conv"), F.col("d").alias("depth"), "n_convs", "chars", "n_ends", "only")
    only = top.filter("conv = node").select("conv", "depth", long(root[1]).alias("n_convs"), long(0).alias("chars"), "n_ends", long(root[3]).alias("only"))
    return nodes.union(only), paths


def parents(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """``nodes`` with ``parent``, the parent's smallest member (null for the root)."""
    above = paths.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    return nodes.join(above, ["conv", "depth"], "left")


def below(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """``(conv, depth, s)``: nodes of each subtree.

    The nodes that carry a conversation's name are the lower end of its path;
    a member adds those of them that lie at or below the node.
    """
    own = paths.filter("node = conv").groupBy("conv").agg(F.min("depth").alias("own"))
    chains = convs.join(own, "conv").select("conv", "own", "turns")
    add = F.col("turns") - F.greatest("own", "depth") + 1
    return paths.join(chains, "conv").groupBy(F.col("node").alias("conv"), "depth").agg(F.sum(add).alias("s"))


class Forest:
    """Parent-edge forest of one group as arrays, with its nodes' preorder places."""

    def __init__(self, conv, depth, parent, top, s):
        n = len(conv)
        self.depth, self.span = depth, s
        names, rank = np.unique(np.concatenate([conv, parent]), return_inverse=True)
        place = np.unique(depth)
        code = rank[:n] * (len(place) + 1) + np.searchsorted(place, depth) + 1
        wanted = rank[n:] * (len(place) + 1) + np.searchsorted(place, depth - 1) + 1
        by_code = np.argsort(code)
        up = by_code[np.minimum(np.searchsorted(code[by_code], wanted), n - 1)]
        self.up = np.where(top, -1, up)
        # Preorder: a child comes after its parent and the subtrees of the siblings before it.
        order = np.lexsort((np.arange(n), self.up))
        ahead = np.cumsum(s[order]) - s[order]
        first = np.concatenate([[True], self.up[order][1:] != self.up[order][:-1]])
        offset = np.empty(n, dtype=np.int64)
        offset[order] = ahead - np.maximum.accumulate(np.where(first, ahead, 0))
        self.pre = np.where(top, offset, 0)
        down = np.argsort(depth, kind="stable")
        for level in np.split(down, np.flatnonzero(np.diff(depth[down])) + 1):
            level = level[~top[level]]
            self.pre[level] = self.pre[self.up[level]] + 1 + offset[level]
        at = np.searchsorted(place, depth) * (n + 1) + self.pre
        self._by_place, self._place = np.argsort(at), np.sort(at)
        self._levels, self.n = place, n

    def child(self, centroid: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The child of ``centroid`` above or at ``node``."""
        at = np.searchsorted(self._levels, self.depth[centroid] + 1) * (self.n + 1) + self.pre[node]
        return self._by_place[np.searchsorted(self._place, at, side="right") - 1]

    def inside(self, centroid: np.ndarray, node: np.ndarray) -> np.ndarray:
        return (self.pre[centroid] <= self.pre[node]) & (self.pre[node] < self.pre[centroid] + self.span[centroid])


def subtree_totals(conv, depth, parent, top, s, weights: np.ndarray) -> np.ndarray:
    """Sums of ``weights`` (one column each) over every node's subtree within its component; ``top`` marks components' tops."""
    forest = Forest(conv, depth, parent, top, s)
    n = len(conv)
    total = np.zeros_like(weights)
    part = np.where(top, np.arange(n), -1)  # the top of each node's component
    for level in np.split(by_depth := np.argsort(depth, kind="stable"), np.flatnonzero(np.diff(depth[by_depth])) + 1):
        level = level[~top[level]]
        part[level] = part[forest.up[level]]
    s, size = s.copy(), s.copy()  # of each node's part, and of the component by its top
    live = np.arange(n)
    while len(live):
        mine = part[live]
        heavy = 2 * s[live] > size[mine]
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, mine[heavy], s[live[heavy]])
        centre = np.full(n, -1)
        lowest = heavy & (s[live] == least[mine])
        centre[mine[lowest]] = live[lowest]
        c = centre[mine]
        inside = forest.inside(c, live)
        held = np.zeros_like(weights)
        np.add.at(held, mine[inside], weights[live[inside]])
        total[live[heavy]] += held[mine[heavy]]
        is_centre = live == c
        cut = s[c]  # before sizes change
        below_c = inside & ~is_centre
        s[live[heavy & ~is_centre]] -= cut[heavy & ~is_centre]
        tops = live == mine
        size[mine[tops]] -= cut[tops]
        heads = forest.child(c[below_c], live[below_c])
        part[live[below_c]] = heads
        size[heads] = s[heads]
        live = live[~is_centre]
    return total


def _totals_of(rows: pa.Table) -> pa.Table:
    get = lambda c: rows.column(c).to_numpy().astype(np.int64)
    conv, depth, parent = get("conv"), get("depth"), get("parent")
    top = (conv == get("comp_conv")) & (depth == get("comp_depth"))
    own = subtree_totals(conv, depth, parent, top, get("s"), np.stack([get("w1"), get("w2")], axis=1))
    out = own + np.stack([get("a1"), get("a2")], axis=1)
    return pa.Table.from_arrays([pa.array(conv), pa.array(depth), pa.array(out[:, 0]), pa.array(out[:, 1])], names=["conv", "depth", "t1", "t2"])


_STATE = ["conv", "depth", "parent", "comp_conv", "comp_depth", "size", "s", "w1", "w2", "a1", "a2"]


def _split(state: DataFrame, paths: DataFrame, local: int) -> DataFrame:
    """Every component of ``state`` split at its centroid, totals added along the centroid's path."""
    comp = ["comp_conv", "comp_depth"]
    heavy = F.col("s") * 2 > F.col("size")
    lowest = state.filter(heavy).groupBy(*comp).agg(F.min(F.struct("s", F.col("depth").alias("cd"), F.col("conv").alias("cc"))).alias("c"))
    centres = F.broadcast(written(lowest.select(*comp, "c.cc", "c.cd", F.col("c.s").alias("cs")), "centres"))
    # The conversations whose path leads through the centroid, and where it goes on from there.
    through = paths.join(centres, (F.col("node") == F.col("cc")) & (F.col("depth") == F.col("cd"))).select(*comp, "conv")
    onward = paths.select("conv", (F.col("depth") - 1).alias("cd"), F.col("node").alias("child"))
    through = through.join(centres.select(*comp, "cd"), comp).join(onward, ["conv", "cd"], "left").select(*comp, "conv", F.lit(True).alias("passes"), "child")
    placed = state.join(centres, comp).join(through, [*comp, "conv"], "left")
    inside = F.coalesce("passes", F.lit(False)) & (F.col("depth") >= F.col("cd"))
    placed = written(placed.withColumns({"inside": inside, "centre": (F.col("conv") == F.col("cc")) & (F.col("depth") == F.col("cd"))}), "placed")
    held = placed.filter("inside").groupBy(*comp).agg(F.sum("w1").alias("t1"), F.sum("w2").alias("t2"))
    # Only parts that will be split again need their size: no more than there are components to split.
    heads = placed.filter("inside and not centre and depth = cd + 1").filter(F.col("s") > local)
    heads = F.broadcast(heads.select(F.col("conv").alias("child"), "cd", F.col("s").alias("head")))
    both = placed.join(F.broadcast(held), comp).join(heads, ["child", "cd"], "left")
    down = F.col("inside") & ~F.col("centre")
    upper = heavy & ~F.col("centre")
    one = F.lit(1).cast("long")
    pick = lambda centre, lower, other: F.when(F.col("centre"), centre).when(down, lower).otherwise(other)
    new = {
        "comp_conv": pick(F.col("conv"), F.col("child"), F.col("comp_conv")),
        "comp_depth": pick(F.col("depth"), F.col("cd") + 1, F.col("comp_depth")),
        "size": pick(one, F.coalesce("head", one), F.col("size") - F.col("cs")),
        "s": F.when(F.col("centre"), one).when(upper, F.col("s") - F.col("cs")).otherwise(F.col("s")),
        "w1": F.when(F.col("centre"), 0).otherwise(F.col("w1")),
        "w2": F.when(F.col("centre"), 0).otherwise(F.col("w2")),
        "a1": F.col("a1") + F.when(heavy, F.col("t1")).otherwise(0),
        "a2": F.col("a2") + F.when(heavy, F.col("t2")).otherwise(0),
    }
    return both.select(*((new[c] if c in new else F.col(c)).cast("long").alias(c) for c in _STATE))


def rollup(forest: DataFrame, paths: DataFrame, local: int = LOCAL) -> DataFrame:
    """``(conv, depth, t1, t2)``: ``w1`` and ``w2`` of ``forest (conv, depth, parent, s, w1, w2)`` summed over each subtree.

    ``s`` is the number of nodes in the subtree; the forest has one root.
    """
    spark = forest.sparkSession
    ship(spark)
    top = forest.filter("parent is null").select("conv", "depth", "s").first()
    if top is None:
        return forest.select("conv", "depth", F.col("w1").alias("t1"), F.col("w2").alias("t2"))
    local = max(local, -(-top["s"] // SPLIT))
    start = {"parent": F.coalesce("parent", "conv"), "comp_conv": F.lit(top["conv"]), "comp_depth": F.lit(top["depth"]), "size": F.lit(top["s"]), "a1": F.lit(0), "a2": F.lit(0)}
    state = forest.select(*(start.get(c, F.col(c)).cast("long").alias(c) for c in _STATE))
    small = state.filter(F.col("size") <= local)
    large = top["s"] > local
    if large:  # as columns of a table, the component's name is a join key like any other
        state = written(state, "components")
    while large:
        path = scratch_path(spark, "components")
        _split(state.filter(F.col("size") > local), paths, local).write.parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        small = small.union(state.filter(F.col("size") <= local))
        large = not state.filter(F.col("size") > local).isEmpty()
    groups = max(1, -(-top["s"] // local))
    bucket = F.pmod(F.xxhash64("comp_conv", "comp_depth"), F.lit(groups))
    return small.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_totals_of, "conv long, depth long, t1 long, t2 long")


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of rows with the same node."""
    last, digest = None, None

    def row(rows):
        columns = [pa.array([k[0] for k, _ in rows], pa.int64()), pa.array([k[1] for k, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["conv", "depth", "several"])

    for batch in batches:
        done = []
        for key in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "conv")), strict=True):
            if key[:2] != last:
                if digest is not None:
                    done.append((last, digest.hexdigest()))
                last, digest = key[:2], hashlib.sha256(str(key[2]).encode())
            else:
                digest.update(f",{key[2]}".encode())
        yield row(done)
    if digest is not None:
        yield row([(last, digest.hexdigest())])


def digests(paths: DataFrame) -> DataFrame:
    """``(conv, depth, several)``: the digest of the ends of each node that has more than one."""
    many = paths.filter("end and n_ends > 1").select("node", "depth", "conv")
    ordered = many.repartition("node", "depth").sortWithinPartitions("node", "depth", "conv")
    return ordered.mapInArrow(_stream_digests, "conv long, depth long, several string")


def conversation_trie(conversations: DataFrame, head: int = HEAD, block: int = BLOCK, local: int = LOCAL) -> DataFrame:
    """Per trie node of the rebuilt conversations: its name, parent, counts, subtree totals and ends."""
    rows, convs = rebuilt(turns_of(conversations), head, block)
    nodes, paths = trie(rows, convs)
    nodes = written(parents(nodes, paths), "nodes")
    key = ["conv", "depth"]
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    known = known.join(below(paths, convs), key)
    leaf = (F.col("n_children") == 0).cast("long")
    known = written(known.withColumns({"w1": leaf, "w2": (F.col("n_convs") - 1) * F.col("chars")}), "forest")
    totals = rollup(known.select(*key, "parent", "s", "w1", "w2"), paths, local)
    out = known.join(totals, key).join(digests(paths), key, "left")
    single = F.when(F.col("n_ends") == 1, F.sha2(F.col("only").cast("string").cast("binary"), 256)).otherwise(hashlib.sha256().hexdigest())
    return out.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("t1").alias("n_leaves"),
        F.col("t2").alias("saved_tokens"),
        F.coalesce("several", single).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))
