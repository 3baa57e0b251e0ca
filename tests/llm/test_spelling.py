import random

from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import spelling
from marquee.llm.registry import QUERIES
from tests.conftest import SF_SMALL

from .brute import one_edit, spelling_variants
from .conftest import make_docs


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_matches_all_words(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    df = QUERIES["op13_spelling_variants"](spark, SF_SMALL)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert got(df) == sorted(spelling_variants(rows), key=repr)


def test_chains_ties_and_every_kind_of_edit(spark):
    draw = random.Random(2)
    words = {"letters": 700, "lettérs": 130, "lettér": 25, "lettr": 9, "lettrs": 20, "lettres": 5, "élettrs": 5, "abcdef": 30, "abcdeg": 30, "abcdeh": 6, "aaaaaa": 60, "aaaaaaa": 11, "aaaaaaaa": 5, "fedcba": 7}
    runs = [w if draw.random() < 0.7 else w.upper() if w.isascii() else w for w, n in words.items() for _ in range(n)]
    draw.shuffle(runs)
    texts = ["-1_".join(runs[k : k + 40]) for k in range(0, len(runs), 40)]
    rows = list(enumerate(texts))
    out = got(spelling.variants(make_docs(spark, texts)))
    assert out == sorted(spelling_variants(rows), key=repr)
    roots = {r[0]: r[2] for r in out}
    assert roots["lettér"] == "letters" and roots["aaaaaaaa"] == "aaaaaaaa"


def test_random_words_of_few_letters(spark):
    draw = random.Random(8)
    texts = [" ".join("".join(draw.choice("abÿ") for _ in range(draw.randrange(3, 9))) for _ in range(300)) for _ in range(30)]
    want = spelling_variants(list(enumerate(texts)), least_count=2, ratio=2)
    assert got(spelling.variants(make_docs(spark, texts), least_count=2, ratio=2)) == sorted(want, key=repr)


def test_defined_cases(spark, clashing):
    text = "Wörter×÷Wörter " * 6 + "wordword " * 7
    texts, ids = [None, "", text, text, "x" * 300_000 + " wordwörd" * 5, " 123 "], [1, 2, None, 4, 4, 6]
    df = make_docs(spark, texts, ids)
    want = sorted(spelling_variants(list(zip(ids, texts, strict=True))), key=repr)
    assert got(spelling.variants(clashing(df))) == want
    assert spelling.variants(df.limit(0)).collect() == []


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.text("abcé", min_size=6, max_size=12), st.integers(0, 12), st.sampled_from("abcdé"), st.sampled_from(["in", "out", "swap"]))
def test_near_words_share_a_signature(word, at, letter, edit):
    at = min(at, len(word) - 1)
    other = word[:at] + (letter + word[at:] if edit == "in" else word[at + 1 :] if edit == "out" else letter + word[at + 1 :])
    if not one_edit(word, other) or len(other) < 6:
        return
    assert plain_signatures(word) & plain_signatures(other)


def plain_signatures(word):
    """The signatures by their definition, without hashes."""
    own, out = spelling.parts(), set()
    held = ["".join(sorted(c for c in word if c in p)) for p in own]
    for shorter in (len(word) - 1, len(word)):
        half = shorter // 2
        for end in (("first", word[:half]), ("last", word[len(word) - half :])):
            out |= {(shorter, end, i, j, held[i], held[j]) for i in range(4) for j in range(i)}
    return out
