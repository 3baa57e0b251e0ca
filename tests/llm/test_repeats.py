import random

import numpy as np
import pytest

from marquee.llm import repeats
from marquee.llm.registry import QUERIES
from tests.conftest import SF_SMALL

from .brute import without_repeats
from .conftest import make_docs


FIELDS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def got(df):
    return sorted((tuple(r) for r in df.select(FIELDS).collect()), key=repr)


def test_query_matches_every_string(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op5_repeated_bytes"](spark, SF_SMALL)) == sorted(without_repeats(rows, 400), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_passages_of_any_place_and_length(spark, seed):
    draw = random.Random(seed)
    word = lambda n: "".join(draw.choice("abcdé ") for _ in range(n))
    passages = [word(n) for n in (30, 38, 39, 40, 41, 60, 200)]
    texts = [word(draw.randrange(80)) + draw.choice(passages) + word(draw.randrange(60)) + draw.choice(passages)[draw.randrange(9) :] for _ in range(60)]
    texts += ["a" * 150, "ab" * 90, texts[0], texts[0], passages[3] * 3]
    rows = list(enumerate(texts))
    assert got(repeats.remove_repeats(make_docs(spark, texts), length=40, gram=8)) == sorted(without_repeats(rows, 40), key=repr)


def test_kept_text_holds_no_repeated_string(spark):
    shared = "".join(chr(97 + (k * k) % 23) for k in range(50)) + "é"
    texts = ["start " + shared + "aèend", "other " + shared + "béend", "no repeat here, none at all, none", None]
    rows = {r["doc_id"]: r for r in repeats.cut_texts(make_docs(spark, texts), length=40, gram=8).collect()}
    assert [rows[k]["kept_text"] for k in range(4)] == ["startaèend", "otherbéend", texts[2], ""]
    assert [rows[k]["changed"] for k in range(4)] == [True, True, False, False]


def test_extra_columns_may_have_any_name(spark, clashing):
    texts = ["x y z " * 10, "x y z " * 10, "short"]
    assert got(repeats.remove_repeats(clashing(make_docs(spark, texts)), length=40, gram=8)) == sorted(without_repeats(list(enumerate(texts)), 40), key=repr)


def test_texts_beyond_a_segment(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 64)  # windows of one text are handled 64 at a time
    draw = random.Random(9)
    word = lambda n: "".join(draw.choice("abcd ") for _ in range(n))
    passage = word(90)
    bodies = [(word(300) + passage + word(200)).encode() for _ in range(3)]
    joined = np.frombuffer(b"".join(bodies), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    small = [tuple(x.tolist() for x in part) for part in repeats.anchors(joined, at, 40, 8)]
    monkeypatch.setattr(repeats, "SEGMENT", 1 << 21)
    whole = [tuple(x.tolist() for x in part) for part in repeats.anchors(joined, at, 40, 8)]
    starts = lambda parts: {(r, s, a) for rows, _, _, first, last, own in parts for r, f, z, a in zip(rows, first, last, own, strict=True) for s in range(f, z + 1)}
    assert starts(small) == starts(whole)


def test_defined_cases(spark):
    same = "x y z " * 10
    texts, ids = [None, "", None, same, same, same + "end"], [1, 2, 1, None, 4, 4]
    want = without_repeats(list(zip(ids, texts, strict=True)), 40)
    assert got(repeats.remove_repeats(make_docs(spark, texts, ids), length=40, gram=8)) == sorted(want, key=repr)
    assert repeats.remove_repeats(make_docs(spark, [])).collect() == []


def test_levels_grow_geometrically_and_miss_no_match(monkeypatch):
    draw = np.random.default_rng(4)
    base = draw.integers(97, 100, 200, dtype=np.uint8)
    family, length, gram = repeats.IndexFamily(40), 40, 8
    bodies = []
    for _ in range(24):
        body = base[60:140].copy()
        body[draw.integers(0, 80, 2)] = 120
        bodies.append(body)
    far = np.full(4, 30)
    for low in range(0, 24, 4):
        part = np.concatenate(bodies[low : low + 4])
        at = np.arange(4) * 80
        family.add(
            repeats._matrix(part, at + far, 80 - far, length, 1), repeats._matrix(part, at + far - 1, far, length - gram, -1), 40 - (80 - far), far, np.zeros(4, np.int64)
        )
    assert [len(x) for x in family.levels] == [16, 8]
    for k, body in enumerate(bodies):
        hits = [d for d in range(0, 31) if any(j != k and (o[30 - d : 70 - d] == body[30 - d : 70 - d]).all() for j, o in enumerate(bodies))]
        assert (family._least[k], family._most[k]) == ((min(hits), max(hits)) if hits else (40, -1))
