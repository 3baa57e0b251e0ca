import heapq
import random
from collections import Counter, defaultdict

from marquee.llm import sharding
from marquee.llm.registry import QUERIES
from tests.conftest import SF_ORACLE

from .brute import crc, loads
from .conftest import make_docs


def check(rows, texts, shards):
    """The law, the groups and the slots of (doc_id, size, crc, law, shard, slot, grown) rows."""
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d, len((t or "").encode()) + 8, crc(t)) for d, t in texts
    )
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in rows:
        by_shard[r["shard"]].append(r)
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by_shard.values())
    got = sorted(sum(r["size"] for r in by_shard[k]) for k in range(shards))
    assert got == loads([t for _, t in texts], shards)


def test_query_is_longest_processing_time(spark, doc_rows):
    check(QUERIES["op6_shards"](spark, SF_ORACLE).collect(), doc_rows, 24)


def test_a_group_with_a_third_of_all_rows(spark):
    texts = ["same text"] * 100 + [f"t{'x' * (k % 50)}{k}" for k in range(200)] + [None, "", None]
    ids = [*range(300), None, None, 7]
    check(sharding.shard(make_docs(spark, texts, ids), 5).collect(), list(zip(ids, texts, strict=True)), 5)
    assert sharding.shard(make_docs(spark, []), 5).collect() == []


def test_classes_are_dealt_as_single_groups_would_be():
    draw = random.Random(3)
    for _ in range(60):
        shards = draw.randrange(1, 9)
        classes = [(s, n, s * n) for s in draw.sample(range(1, 300), 12) for n in [draw.choice([1, 3, 40, 500])]]
        dealt = dict(sharding.deal(classes, shards))
        load = [sum(s * (dealt[s][0] if k == 0 else dealt[s][k] - dealt[s][k - 1]) for s, _, _ in classes) if k < shards - 1 else None for k in range(shards)]
        load[-1] = sum(t for *_, t in classes) - sum(load[:-1])
        heap = [0] * shards
        for s, n, _ in sorted(classes, reverse=True):
            for _ in range(n):
                heapq.heapreplace(heap, heap[0] + s)
        assert sorted(load) == sorted(heap)
