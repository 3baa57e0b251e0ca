import random

import pytest

from marquee.llm import neardup
from marquee.llm.registry import QUERIES
from tests.conftest import SF_ORACLE

from .brute import components
from .conftest import make_docs


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_query_matches_all_pairs(spark, doc_rows):
    assert got(QUERIES["op8_near_duplicates"](spark, SF_ORACLE)) == sorted(components(doc_rows, 4), key=repr)


def edited(words, share, draw):
    return [w if draw.random() > share else f"x{draw.randrange(10**6)}" for w in words]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_edited_copies(spark, seed):
    draw = random.Random(seed)
    texts = []
    for _ in range(4):
        base = [f"w{draw.randrange(400)}" for _ in range(120)]
        texts += [" ".join(edited(base, draw.choice([0.0, 0.01, 0.03, 0.05]), draw)) for _ in range(60)]
    passage = [f"p{k}" for k in range(60)]
    texts += [" ".join([*passage, *(f"q{draw.randrange(10**6)}" for _ in range(60))]) for _ in range(40)]
    draw.shuffle(texts)
    rows = list(enumerate(texts))
    assert got(neardup.near_duplicates(make_docs(spark, texts), size=4)) == sorted(components(rows, 4), key=repr)


def test_defined_cases(spark):
    texts = [None, "", " \t\n", "one", "One", "one two", "a b c d", "a b c d", "A b c d e f g h i j k l m n", None]
    ids = [5, 4, 3, 9, 7, None, 2, None, 1, 5]
    rows = list(zip(ids, texts, strict=True))
    assert got(neardup.near_duplicates(make_docs(spark, texts, ids), size=4)) == sorted(components(rows, 4), key=repr)


def test_empty_table(spark, docs):
    assert neardup.near_duplicates(docs.limit(0)).collect() == []
    assert neardup.keep_one(docs.limit(0)).collect() == []


def test_keep_one_keeps_columns_and_one_row_of_each_group(spark, clashing):
    text = " ".join(f"w{k}" for k in range(50))
    df = clashing(make_docs(spark, [text, text, text + " more", None, None, "other words"], [3, 3, 8, 1, 1, None]))
    out = neardup.keep_one(df)
    assert out.columns == df.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert rows == sorted([(3, text), (1, None), (1, None), (None, "other words")], key=repr)
