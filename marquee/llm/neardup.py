"""MinHash near-duplicates with tensored banding.

Every document gets two small collections of ``SUBKEYS`` sub-keys, each made
of ``WIDTH`` minhashes of its word shingles. A table's key is a pair of one
sub-key from either collection, so ``SUBKEYS ** 2`` tables come from
``2 * SUBKEYS * WIDTH`` minhashes. Sub-keys that no other set has cannot be
half of a shared key and go first. Two sets with similarity s meet unless all
sub-keys of one collection differ: ``2 * (1 - s ** WIDTH) ** SUBKEYS``, which
is 1e-5 at s = 0.8. Sharing a key only makes a candidate: a link is confirmed
on the full shingle sets.

Equal sets are one node from the start. Within a key no list of all pairs is
made: rounds compare each node with one centre of its keys, linked nodes
become one component, and at the end every pair of nodes still in different components
is compared, unless too few of their shingles can be common.

Defined cases: null or wordless texts have the empty set and are linked with
nothing; with fewer words than the shingle, the whole sequence is the one
shingle. A null doc_id is no candidate for ``component_id``, which is null if
the whole component has none. Rows that repeat a doc_id are judged by their
texts. An empty table gives an empty result; ``keep_one`` returns the input's
columns whatever they are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm import wordhash
from marquee.llm.common import ship, table, written
from marquee.llm.graph import contract

WIDTH = 2
SUBKEYS = 12
#: 64-bit words of the bit map that narrows the last comparison.
MAP_WORDS = 8
#: Star rounds end when fewer than one in so many comparisons makes a link.
WORTH = 10

_PROFILE = "rid long, doc_id long, th long, n_shingles long, s1 long, s2 long, subs array<long>"


def _sets(texts: pa.Array, size: int) -> Iterator[list[np.ndarray]]:
    """The sorted distinct shingle hashes of each text, some rows at a time."""
    body, offsets = wordhash.flat(texts)
    for low, high in wordhash.row_groups(offsets):
        part, at = body[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, first = wordhash.words(part, at)
        grams, cut = wordhash.shingles(wordhash.word_hashes(part, starts, ends), first, size)
        yield [np.unique(grams[cut[k] : cut[k + 1]]) for k in range(high - low)]


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _list_column(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _longs(values))


def _profile(size: int, width: int, subkeys: int):
    hashes = wordhash.seeds(2 * subkeys * width, 11)
    ids = wordhash.seeds(2 * subkeys, 13)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for sets in _sets(batch.column("text"), size):
                counts = np.array([len(x) for x in sets], dtype=np.int64)
                full = np.flatnonzero(counts)
                grams = np.concatenate([sets[k] for k in full]) if len(full) else np.empty(0, np.uint64)
                at = np.concatenate([[0], np.cumsum(counts[full])])
                s1, s2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                subs = np.zeros((len(full), 2 * subkeys), np.uint64)
                if len(full):
                    s1[full] = np.add.reduceat(wordhash.mix(grams + np.uint64(1)), at[:-1])
                    s2[full] = np.add.reduceat(wordhash.mix(grams + np.uint64(2)), at[:-1])
                    for k in range(2 * subkeys * width):
                        least = np.minimum.reduceat(wordhash.mix(grams * hashes[k]), at[:-1])
                        subs[:, k // width] = wordhash.mix(subs[:, k // width] * np.uint64(3) + least + ids[k // width])
                rows = batch.slice(done, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("rid"),
                        rows.column("doc_id"),
                        rows.column("th"),
                        pa.array(counts),
                        _longs(s1),
                        _longs(s2),
                        _list_column(subs.ravel(), np.concatenate([[0], np.cumsum(np.where(counts > 0, 2 * subkeys, 0))])),
                    ],
                    names=["rid", "doc_id", "th", "n_shingles", "s1", "s2", "subs"],
                )
                done += len(sets)

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for sets in _sets(batch.column("text"), size):
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(done, len(sets)), _list_column(values, offsets)], names=["node", "grams"]
                )
                done += len(sets)

    return run


def _near(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _keys(profile: DataFrame, subkeys: int) -> tuple[DataFrame, DataFrame]:
    """``(key, node, n, shared)`` for table keys that at least two different sets have, and the nodes' sub-keys."""
    reps = profile.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("rid").alias("rid"))
    nodes = profile.join(reps.select("rid"), "rid").select(F.col("rid").alias("node"), F.col("n_shingles").alias("n"), "subs")
    sub = nodes.select("node", "n", F.posexplode("subs").alias("place", "h"))
    shared = sub.groupBy("h").count().filter("count > 1").select("h")
    live = sub.join(shared, "h").groupBy("node").agg(
        F.first("n").alias("n"),
        F.collect_list(F.when(F.col("place") < subkeys, F.col("h"))).alias("a"),
        F.collect_list(F.when(F.col("place") >= subkeys, F.col("h"))).alias("b"),
    )
    live = written(live, "sub-keys")
    pairs = live.select("node", "n", "b", F.explode("a").alias("a")).select("node", "n", "a", F.explode("b").alias("b"))
    keys = pairs.select(F.xxhash64("a", "b").alias("key"), "node", "n")
    both = keys.groupBy("key").agg(F.count("*").alias("shared")).filter("shared > 1")
    return written(keys.join(both, "key"), "keys"), live


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs (node, other)`` whose full sets are similar enough, as ``(u, v)``."""
    a = sets.select("node", F.col("grams").alias("x"))
    b = sets.select(F.col("node").alias("other"), F.col("grams").alias("y"))
    both = pairs.join(a, "node").join(b, "other")
    common = F.size(F.array_intersect("x", "y"))
    counted = both.select("node", "other", common.alias("i"), (F.size("x") + F.size("y")).alias("t"))
    return counted.filter(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select(
        F.col("node").alias("u"), F.col("other").alias("v")
    )


def _star(keys: DataFrame, labels: DataFrame, weight: Column, percent: int) -> DataFrame:
    """One pair per node: with the weightiest centre, of all its keys, in another component."""
    own = keys.join(labels, "node").withColumn("w", weight)
    centre = own.groupBy("key").agg(F.max(F.struct("w", "node", "n", "component")).alias("c"))
    met = own.join(centre, "key").filter(
        (F.col("component") != F.col("c.component")) & _near(F.col("n"), F.col("c.n"), percent)
    )
    best = met.groupBy("node").agg(F.max(F.struct("c.w", "c.node")).alias("c"))
    return best.select("node", F.col("c.node").alias("other"))


def _apart(keys: DataFrame, live: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs that share a key while in different components, and can be similar enough.

    A shingle that no other component has cannot be common to such a pair. The f
    of n shingles left are also marked in a bit map: each bit that only one side
    has stands for a shingle that the other lacks. So at most ``f`` less those
    bits, on either side, are common, and similarity needs
    ``(100 + percent) * common >= percent * (n + m)``.
    """
    mixed = keys.join(labels, "node")
    open_keys = mixed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi")
    nodes = mixed.join(open_keys.select("key"), "key").select("node", "n", "component").distinct()
    nodes = written(nodes, "open")
    grams = nodes.join(sets, "node").select("node", "component", F.explode("grams").alias("gram"))
    foreign = grams.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi")
    word, bit = F.pmod("gram", F.lit(MAP_WORDS)), F.pmod(F.shiftright("gram", 8), F.lit(64)).cast("int")
    marks = [F.coalesce(F.bit_or(F.when(word == k, F.call_function("shiftleft", F.lit(1).cast("long"), bit))), F.lit(0).cast("long")) for k in range(MAP_WORDS)]
    left = grams.join(foreign.select("gram"), "gram").groupBy("node").agg(
        F.count("*").alias("f"), *(m.alias(f"x{k}") for k, m in enumerate(marks))
    )
    # The smallest partner that sizes allow has percent / 100 of the node's shingles.
    left = nodes.join(left, "node").filter((100 + percent) * 100 * F.col("f") >= percent * (100 + percent) * F.col("n"))
    words = [f"x{k}" for k in range(MAP_WORDS)]
    own = live.select("node", "a", "b").join(left.select("node", "n", "component", "f", *words), "node")
    own = own.withColumn("sub", F.explode("a"))
    other = own.select("sub", *(F.col(c).alias(f"{c}_") for c in own.columns if c != "sub"))
    lacking = lambda i, j: sum((F.bit_count(F.col(f"x{k}{i}").bitwiseAND(F.bitwise_not(F.col(f"x{k}{j}")))) for k in range(MAP_WORDS)), F.lit(0))
    common = F.least(F.col("f") - lacking("", "_"), F.col("f_") - lacking("_", ""))
    on = (F.col("node") < F.col("node_")) & (F.col("component") != F.col("component_")) & _near(F.col("n"), F.col("n_"), percent)
    on &= (100 + percent) * common >= percent * (F.col("n") + F.col("n_"))
    # A shared key is a shared sub-key of either kind; the first shared one of a speaks for all.
    on &= F.arrays_overlap("b", "b_") & (F.array_min(F.array_intersect("a", "a_")) == F.col("x.sub"))
    both = own.alias("x").join(other.alias("y"), (F.col("x.sub") == F.col("y.sub")) & on)
    return both.select("node", F.col("node_").alias("other"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after the components at the ends of ``links`` became one."""
    a = labels.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    b = labels.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    roots = contract(links.join(a, "u").join(b, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    moved = labels.join(roots.select(F.col("node").alias("component"), "root"), "component", "left")
    return written(moved.select("node", F.coalesce("root", "component").alias("component")), "labels")


def _labels(docs: DataFrame, profile: DataFrame, size: int, percent: int, subkeys: int) -> DataFrame:
    """``(node, component)`` of the nodes that share a key with another one."""
    keys, live = _keys(profile, subkeys)
    degree = written(keys.groupBy("node").agg(F.sum("shared").alias("degree")), "degree")
    rows = profile.join(degree, profile["rid"] == degree["node"]).select("node", "doc_id", "th").alias("r")
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")
    wanted = texts.join(rows, F.col("r.doc_id").eqNullSafe(F.col("d")) & (F.col("r.th") == F.col("t"))).select("node", "text")
    sets = wanted.mapInArrow(_full_sets(size), "node long, grams array<long>").dropDuplicates(["node"])
    sets = written(sets, "sets")
    labels = degree.select("node", F.col("node").alias("component"))
    weighted = keys.join(degree, "node")
    tested = None
    turn = 0
    while True:
        weight = F.col("degree") if turn == 0 else F.xxhash64("node", F.lit(turn))
        pairs = _star(weighted, labels, weight, percent)
        pairs = written(pairs if tested is None else pairs.join(tested, ["node", "other"], "left_anti"), "pairs")
        links = written(_confirmed(pairs, sets, percent), "links")
        tried, found = pairs.count(), links.count()
        tested = pairs if tested is None else tested.union(pairs)
        if found:
            labels = _joined(labels, links)
        if found * WORTH < tried or not found:
            break
        turn += 1
    turned = tested.select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other"))
    pairs = _apart(keys, live, labels, sets, percent).join(turned, ["node", "other"], "left_anti")
    links = written(_confirmed(pairs, sets, percent), "links")
    return labels if links.isEmpty() else _joined(labels, links)


def _with_components(docs: DataFrame, size: int, percent: int, width: int, subkeys: int) -> DataFrame:
    """Per input row: rid, doc_id, th, n_shingles, component_id, group (null: no set)."""
    ship(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    profile = written(rows.mapInArrow(_profile(size, width, subkeys), _PROFILE), "profile")
    labels = _labels(docs.select(F.col("doc_id").cast("long"), "text"), profile, size, percent, subkeys)
    groups = profile.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least"))
    groups = groups.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = groups.join(least, "component").select("s1", "s2", "component", "component_id")
    empty = F.col("n_shingles") == 0
    return profile.drop("subs").join(groups, ["s1", "s2"], "left").select(
        "rid",
        "doc_id",
        "th",
        "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(~empty, F.col("component")).alias("group"),
    )


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, width: int = WIDTH, subkeys: int = SUBKEYS
) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: n_shingles, component_id and kept."""
    out = _with_components(docs, size, percent, width, subkeys)
    return out.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, width: int = WIDTH, subkeys: int = SUBKEYS) -> DataFrame:
    """The rows of ``docs`` with one row of each component: the smallest doc_id (null: last), then the first row.

    Rows without words are all kept.
    """
    found = _with_components(docs.select("doc_id", "text"), size, percent, width, subkeys)
    grouped = found.filter(F.col("group").isNotNull())
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid", "th")).alias("f"))
    stay = first.select(F.col("f.doc_id").alias("_d"), F.col("f.th").alias("_t"), F.lit(False).alias("_all"))
    bare = found.filter(F.col("group").isNull()).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.lit(True).alias("_all"))
    stay = stay.union(bare.distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    near = F.col("row.doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64("row.text") == F.col("_t"))
    both = rows.join(stay, near)
    turn = F.row_number().over(Window.partitionBy("_d", "_t").orderBy("_all"))
    return both.withColumn("_turn", turn).filter("_all or _turn = 1").select("row.*")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4)
