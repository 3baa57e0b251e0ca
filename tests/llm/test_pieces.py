import hashlib
import random
import time

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import pieces
from marquee.llm.registry import QUERIES
from tests.conftest import SF_SMALL

from .conftest import make_docs


@pytest.fixture(scope="module")
def both():
    path = pieces.default_model()
    return pieces.encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)


def same(both, text):
    own, library = both
    ids = library.encode(text)
    assert own.encode(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids)), text


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(both, text):
    same(both, text)


def test_awkward_texts(both):
    draw = random.Random(1)
    texts = ["▁", "a▁b", "▁▁a ▁", "x" * 300, "²³ a²b", "<0x0A> <s> </s> <unk>", "\x00a\n\nb\t", "日本語のテスト", "😀😀", "हिन्दी"]
    for n in range(1, 50):
        texts += [" " * n, " " * n + "a", "b" + " " * n + "c", " " * n + ".x"]
    texts += ["".join(draw.choice("abcdefgh  ..,\n\t éüñ▁²日0123<>|$") for _ in range(40)) for _ in range(500)]
    for text in texts:
        same(both, text)


def test_prefix_table_agrees_with_merging(both):
    own, _ = both
    draw = random.Random(3)
    for _ in range(2000):
        unit = pieces.SPACE + "".join(draw.choice("aeinrstdhlouz") for _ in range(draw.randrange(1, 15)))
        assert [own.piece[i] for i in own.unit_ids(unit)] == own.merged(unit)


def plainly_merged(own, text):
    """The best-scored pair, leftmost of equals, sought anew after every merge."""
    parts = list(text)
    while True:
        pairs = [(own.score[parts[k] + parts[k + 1]], -k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in own.score]
        if not pairs:
            return parts
        k = -max(pairs)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_merging_by_heap_is_merging_by_definition(both):
    own, _ = both
    draw = random.Random(5)
    for _ in range(1500):
        text = "".join(draw.choice("aein▁▁▁▁▁▁.st") for _ in range(draw.randrange(1, 60)))
        assert own.merged(text) == plainly_merged(own, text)


def test_long_runs_of_spaces(both):
    own, library = both
    text = "a" + " " * 100_000 + "b  c" + " " * 1001
    start = time.perf_counter()
    got = own.encode(text)
    assert time.perf_counter() - start < 5  # a second or less on an idle machine
    assert got[1] == ",".join(map(str, library.encode(text))) and got[2] == text


def test_forgetting_units_changes_nothing(both):
    small = pieces.PieceEncoder(pieces.default_model(), remembered=3)
    for text in ["one two three four five one two", "a b c d e f a b c"]:
        assert small.encode(text) == both[0].encode(text)


def test_query_matches_the_library(spark, both):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in rows:
        ids = both[1].encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(both[1].decode(ids))))
    assert sorted(tuple(r) for r in QUERIES["op9_pieces"](spark, SF_SMALL).collect()) == sorted(want)


def test_defined_cases(spark, clashing, both):
    df = clashing(make_docs(spark, [None, "", "hello", "hello"], [1, None, 2, 2]))
    out = pieces.encode(df)
    assert out.columns == [*(c for c in df.columns if c != "ids"), "n_tokens", "ids", "decoded"]
    assert sorted((r["n_tokens"], r["decoded"]) for r in out.collect()) == [(0, ""), (0, ""), *[(len(both[1].encode("hello")), "hello")] * 2]
    assert pieces.encode(df.limit(0)).collect() == []
