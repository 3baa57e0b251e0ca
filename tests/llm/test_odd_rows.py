"""Clashing names, very long texts and repeated rows, for the operators whose own tests lack them."""

import hashlib

from pyspark.sql import functions as F

from marquee.llm import chat, leaks, neardup, secretscan, sharding, toxicity

from .brute import components, loads
from .conftest import make_docs

LONG = " ".join(f"word{k % 997}x{k}" for k in range(150_000))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_chat_with_clashing_names(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|>"), (2, 0, "assistant", None)], "conv_id long, turn int, role string, text string")
    more = turns.withColumns({n: F.lit(f"own {n}") for n in ("row", "piece", "key", "part", "loss", "kept")})
    plain = chat.read_back(chat.format_conversations(turns))
    assert rows_of(chat.read_back(chat.format_conversations(more))) == rows_of(plain)
    got = {r["conv_id"]: r for r in plain.collect()}
    assert got[1]["loss_sha256"] == hashlib.sha256(b"yo <|im_end|>").hexdigest() and got[2]["loss_chars"] == 0


def test_toxicity_with_clashing_names_and_a_long_text(spark, clashing):
    texts = [f"good day number {k}" for k in range(40)] + [f"you idiot {k}" for k in range(20)]
    df = make_docs(spark, [*texts, LONG, "good. " * 50_000 + "you idiot"])
    labels = spark.createDataFrame([(k, int(k >= 40)) for k in range(60)], "doc_id long, toxic int")
    model = toxicity.learn(clashing(df), clashing(labels))
    scored = toxicity.score(clashing(df), model)
    assert rows_of(scored.select("doc_id", "predicted")) == rows_of(toxicity.score(df, toxicity.learn(df, labels)).select("doc_id", "predicted"))
    assert {r["predicted"] for r in scored.filter("doc_id < 40 or doc_id = 60").collect()} == {0}


def test_shards_with_clashing_names_and_rounded_classes(spark, clashing):
    texts = ["x" * (sharding.EXACT + 7919 * k) for k in range(12)] + [LONG, None, "", "a", "a"]
    df = make_docs(spark, texts)
    more = clashing(df).withColumns({n: F.lit("own") for n in ("group", "class", "part", "rank", "size", "shard", "slot", "_in", "_shift")})
    rows = sharding.shard(more, 4).collect()
    assert rows_of(sharding.shard(df, 4)) == sorted(map(tuple, rows), key=repr)
    got = sorted(sum(r["size"] for r in rows if r["shard"] == k) for k in range(4))
    want = loads(texts, 4)
    assert sum(got) == sum(want) and abs(got[-1] - want[-1]) <= 0.01 * want[-1]


def test_near_duplicates_of_very_long_texts(spark, clashing):
    texts = [LONG, LONG + " and an end", LONG.replace("word5x", "other"), "short text of five words", None]
    rows = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(clashing(make_docs(spark, texts)), size=4).collect()}
    assert rows == {r[0]: r[2] for r in components(list(enumerate(texts)), 4)} and rows[1] == rows[0] == 0


def test_leaks_in_a_very_long_text(spark, clashing):
    item = " ".join(f"item{k}" for k in range(30))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    df = clashing(make_docs(spark, [LONG + " " + item, LONG, item + " " + LONG, None]))
    assert {r["doc_id"] for r in leaks.drop_leaky(df, clashing(bench)).collect()} == {1, 3}


def test_secrets_in_repeated_rows_and_a_very_long_text(spark):
    key = "AKIA" + "Q7ZP3M9XK2LT8RVB"
    texts = [f"aws key {key} here"] * 3 + [LONG[:200_000] + f" aws key {key} here", None, ""]
    df = make_docs(spark, texts, [1, 1, 1, 2, 3, 4])
    out = sorted((r["doc_id"], r["text"]) for r in secretscan.redact(df).collect() if r["text"] and r["doc_id"] < 3)
    assert [d for d, _ in out] == [1, 1, 1, 2] and all(key not in t for _, t in out) and len({t for d, t in out if d == 1}) == 1
    found = [tuple(r) for r in secretscan.scan(df).filter("doc_id = 1 and is_secret").collect()]
    assert len(found) == 3 and len(set(found)) == 1
