import random
import tracemalloc

import numpy as np
import pyarrow as pa

from marquee.llm import leaks
from marquee.llm.registry import QUERIES
from tests.conftest import SF_ORACLE

from .brute import LOWER, WORD, word_edits
from .conftest import make_docs


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def nearest_spans(rows, items):
    """Brute force: per (doc_id, item_id) the least edits over all spans of any length, if few enough."""
    out = {}
    owns = [(item_id, words(item)) for item_id, item in items]
    sets = [set(own) for _, own in owns]
    for doc_id, text in rows:
        line = words(text)
        for (item_id, own), held in zip(owns, sets, strict=True):
            n, most = len(own), len(own) // leaks.EDITS_PER
            # A span that close has at most n + most words, and all but ``most`` of the item's among them.
            known = np.concatenate([[0], np.cumsum([w in held for w in line])])
            wide = min(len(line), n + most)
            if not n or not line or (known[wide:] - known[: len(known) - wide]).max() < n - most:
                continue
            row = [0] * (len(line) + 1)
            for i, x in enumerate(own, 1):
                new = [i]
                for j, y in enumerate(line, 1):
                    new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
                row = new
            if min(row) <= most:
                out[doc_id, item_id] = min(row)
    return out


def found(df):
    return {(r["doc_id"], r["item_id"]): r["edits"] for r in df.collect()}


def test_query_matches_all_spans(spark, doc_rows):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_ORACLE}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(QUERIES["op1_benchmark_leaks"](spark, SF_ORACLE)) == nearest_spans(doc_rows, items)


def test_recall_at_the_full_distance(spark):
    draw = random.Random(5)
    items = [(k, " ".join(f"v{draw.randrange(60)}" for _ in range(draw.randrange(10, 60)))) for k in range(40)]
    texts = []
    for k in range(300):
        own = words(items[k % 40][1])
        for _ in range(len(own) // leaks.EDITS_PER):
            at, kind = draw.randrange(len(own)), draw.random()
            own[at : at + 1] = [f"v{draw.randrange(60)}"] if kind < 0.6 else [] if kind < 0.8 else [own[at], "zz"]
        texts.append(" ".join([*(f"v{draw.randrange(60)}" for _ in range(30)), *own, "tail", "end"]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = nearest_spans(list(enumerate(texts)), items)
    got = found(leaks.find_leaks(make_docs(spark, texts), bench))
    assert set(got) <= set(want) and len(want) > 100
    assert sum(got.get(k) == e for k, e in want.items()) >= 0.95 * len(want)


def test_defined_cases(spark, clashing):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (None, item), (4, "")], "item_id long, text string")
    texts = [None, "", item.upper(), "x " + item + " y", item.replace("ten", "10"), item.replace("two three", ""), "one two"]
    df = make_docs(spark, texts, [1, 2, 3, 3, 5, 6, None])
    rows = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in leaks.find_leaks(df, bench).collect()), key=repr)
    assert rows == sorted([(3, 1, 0), (3, None, 0), (3, 1, 0), (3, None, 0), (5, 1, 1), (5, None, 1)], key=repr)
    wide = clashing(df)
    clean = leaks.drop_leaky(wide, bench)
    assert clean.columns == wide.columns
    assert sorted(repr(r["text"]) for r in clean.collect()) == sorted(map(repr, [None, "", texts[5], "one two"]))
    assert leaks.find_leaks(df.limit(0), bench).collect() == [] == leaks.find_leaks(df, bench.limit(0)).collect()


def test_benchmark_in_blocks(spark, monkeypatch, doc_rows):
    bench = spark.read.parquet(f"{SF_ORACLE}/benchmark.parquet")
    docs = spark.createDataFrame(doc_rows[:200], "doc_id long, text string")
    whole = found(leaks.find_leaks(docs, bench))
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 500)
    assert found(leaks.find_leaks(docs, bench)) == whole


def test_edit_distance_is_exact_up_to_its_bound():
    draw = random.Random(2)
    for _ in range(300):
        a = [draw.randrange(4) for _ in range(draw.randrange(1, 12))]
        b = [draw.randrange(4) for _ in range(draw.randrange(1, 12))]
        assert leaks.edit_distance(a, b, 3) == min(4, word_edits(a, b))


def test_items_of_few_words_are_found_whole(spark):
    draw = random.Random(4)
    items = [(k, " ".join(f"v{draw.randrange(12)}" for _ in range(1 + k % 9))) for k in range(40)] + [(90, "v1 v2"), (91, "v1 v2"), (92, "Absent")]
    texts = [" ".join(f"V{draw.randrange(14)}" for _ in range(draw.randrange(40))) for _ in range(60)] + ["v1", "v1  v2"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = list(enumerate(texts))
    assert found(leaks.find_leaks(make_docs(spark, texts), bench)) == nearest_spans(rows, items)
    keep = {d for d, _ in rows} - {d for d, _ in nearest_spans(rows, items)}
    assert {r["doc_id"] for r in leaks.drop_leaky(make_docs(spark, texts), bench).collect()} == keep


def test_a_very_long_item_takes_little_memory():
    draw = random.Random(7)
    line = [f"w{draw.randrange(4000)}" for _ in range(12_000)]
    items = [(k, " ".join(f"x{draw.randrange(500)}" for _ in range(20))) for k in range(1000)] + [(5000, " ".join(line[300:5300]))]
    tracemalloc.start()
    finder = leaks.LeakFinder(items)
    built = tracemalloc.get_traced_memory()[1]
    text = pa.array([" ".join(line)], type=pa.large_string())
    tracemalloc.reset_peak()
    rows = [x for _, some in leaks._scan(finder, text) for x in some]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == [(0, 5000, 300, 5000, 0)]
    assert built < 60e6 and peak < 300e6


def test_inserted_and_dropped_words_cost_one_edit(spark):
    items, texts = [], []
    for k, (n, edits) in enumerate([(18, 1), (30, 2), (45, 3)]):
        own = [f"w{k}x{j}" for j in range(n)]
        items.append((k, " ".join(own)))
        more, less = own[:], own[:]
        for j in range(edits):
            more.insert((j + 1) * n // (edits + 1), "zz")
            del less[(j + 1) * n // (edits + 1)]
        for lead, tail in ((["a"] * 9, ["b"] * 9), ([], []), (["a"] * 9, []), ([], ["b"] * 9)):
            texts += [" ".join([*lead, *x, *tail]) for x in (more, less)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = make_docs(spark, texts)
    assert found(leaks.find_leaks(df, bench)) == {(d, d // 8): d // 8 + 1 for d in range(24)}
    assert leaks.drop_leaky(df, bench).count() == 0
    spans = {r["doc_id"]: (r["start_word"], r["n_words"]) for r in leaks.find_leaks(df, bench).collect()}
    assert [spans[d] for d in (0, 1, 8, 9)] == [(9, 19), (9, 17), (9, 32), (9, 28)]


def test_recall_over_spans_of_any_length(spark):
    draw = random.Random(6)
    items = [(k, " ".join(f"v{draw.randrange(60)}" for _ in range(draw.randrange(10, 60)))) for k in range(40)]
    texts = []
    for k in range(200):
        own = words(items[k % 40][1])
        for _ in range(len(own) // leaks.EDITS_PER):
            at = draw.randrange(len(own))
            own[at : at + 1] = [] if draw.random() < 0.5 else [own[at], "zz"]
        texts.append(" ".join([*(f"v{draw.randrange(60)}" for _ in range(30)), *own, *(["tail", "end"] if k % 2 else [])]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = nearest_spans(list(enumerate(texts)), items)
    got = found(leaks.find_leaks(make_docs(spark, texts), bench))
    assert set(got) <= set(want) and len(want) >= 200
    assert sum(got.get(k) == e for k, e in want.items()) >= 0.95 * len(want)


def test_edits_per_span_end():
    draw = random.Random(3)
    for _ in range(200):
        own = [draw.randrange(4) for _ in range(draw.randrange(1, 9))]
        line = [draw.randrange(4) for _ in range(draw.randrange(1, 12))]
        masks = {x: sum(1 << j for j, y in enumerate(own) if x == y) for x in own}
        want = [min(word_edits(own, line[a:b]) for a in range(b + 1)) for b in range(1, len(line) + 1)]
        assert leaks.span_edits(masks, len(own), line) == want
