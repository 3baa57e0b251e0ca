"""Spelling variants: words one edit apart, found by PartEnum signatures.

A word's letter multiset is a binary vector with a place for the first, second,
... occurrence of each letter. One inserted or deleted letter moves it by one
place, one replaced letter by two. The letters are dealt into ``PARTS`` parts;
at most two parts can differ, so two near words agree on all other parts: every
choice of ``PARTS - 2`` parts, with the letters that the word has in them, is a
signature, and near words share one. Two words of L and L or L + 1 letters that
are one edit apart also share their first or last L // 2 letters; a signature
holds L and these, too, so that a common multiset alone does not make a group.
An equi-join on the signatures gives the candidates, whose edit distance decides
inside the join.

Runs are counted with partial aggregation before the shuffle. All steps are
DataFrame expressions.

Defined cases: null and empty texts have no runs; a null doc_id reads as an
empty string in the hash. Repeated rows count each. Code points are told apart
beyond A-Z (no folding, U+00D7 and U+00F7 are run characters as any in the
range). A tie for the form goes to the smallest word in code-point order. An
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import table, written

# The run characters, and the planted slip's divisor.
RUN = "[A-Za-zÀ-ÿ]+"
SLIP = 199

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form occurs at least this many times as often as the word.
FORM_RATIO = 5
#: Parts of the alphabet, and how many of them one edit can touch.
PARTS, TOUCHED = 4, 2

# Letters from frequent to rare, dealt to the parts in turn to even them out.
BY_FREQUENCY = "etaoinshrdlucmfwypvbgkqjxz"


def parts() -> list[str]:
    """The letters of each part: A-Z never occur, the others by rule."""
    letters = BY_FREQUENCY + "".join(chr(c) for c in range(0xC0, 0x100))
    return [letters[k::PARTS] for k in range(PARTS)]


def slipped(doc_id: Column, run: Column, slip: int = SLIP) -> Column:
    """The run, one code point short where the slip's hash says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    short = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2, F.length(run)))
    return F.when(h % slip == 0, short).otherwise(run)


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """``(word, n)`` of the long and frequent enough words of all texts."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.translate(F.col("text"), upper, upper.lower())
    runs = docs.select(F.col("doc_id").alias("d"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    # A slip only shortens: shorter runs never become words.
    words = runs.filter(F.length("run") >= least_letters).select(slipped(F.col("d"), F.col("run"), slip).alias("word"))
    counts = words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def signatures(words: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """``(sig, shorter, word, n)``: each word's signatures, for partners of its own length and of one more or less.

    ``shorter`` is the length L of the shorter word of the pairs that the signature is for.
    """
    own = parts()
    ordered = F.array_join(F.array_sort(F.split("word", "")), "")
    held = words.select("word", "n", F.length("word").alias("m"), ordered.alias("letters"))
    for k in range(PARTS):
        others = "".join(x for j, x in enumerate(own) if j != k)
        held = held.withColumn(f"p{k}", F.translate("letters", others, ""))
    lengths = F.filter(F.array(F.col("m") - 1, F.col("m")), lambda x: x >= least_letters)
    held = held.withColumn("shorter", F.explode(lengths))
    half = F.shiftright("shorter", 1)
    ends = [("first", F.substr("word", F.lit(1), half)), ("last", F.substr("word", F.col("m") - half + 1, half))]
    choices = list(combinations(range(PARTS), PARTS - TOUCHED))
    sig = [
        F.xxhash64(F.lit(end), F.lit(c), F.col("shorter"), text, *(F.col(f"p{k}") for k in choice))
        for end, text in ends
        for c, choice in enumerate(choices)
    ]
    return held.select(F.explode(F.array(*sig)).alias("sig"), F.col("shorter").cast("int").alias("shorter"), "word", "n")


def near_pairs(words: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """``(a, na, b, nb)``: all pairs of words exactly one edit apart, once each, ``a`` first in code-point order."""
    sig = signatures(words, least_letters)
    left = sig.select("sig", F.col("word").alias("a"), F.col("n").alias("na"))
    right = sig.select(F.col("sig").alias("sig_b"), "shorter", F.col("word").alias("b"), F.col("n").alias("nb"))
    # Two words of L + 1 letters meet under L, too; they are compared under L + 1.
    fit = (F.col("a") < F.col("b")) & (F.least(F.length("a"), F.length("b")) == F.col("shorter"))
    met = left.join(right.hint("merge"), (F.col("sig") == F.col("sig_b")) & fit & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "na", "b", "nb").distinct()


def with_forms(words: DataFrame, pairs: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """``words`` with near-word count, form and the form's count."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    # Greatest count first, then the smallest word: the least of (-count, word).
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other"))).alias("best"))
    joined = words.join(best, "word", "left")
    often = -F.col("best.less") >= ratio * F.col("n")
    return joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(often, F.col("best.other")).alias("form"),
        F.when(often, -F.col("best.less")).alias("form_n"),
    )


def with_roots(forms: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """``forms`` with the word at the end of each chain of forms, by doubling.

    Counts grow by ``ratio`` from word to form, so the greatest count bounds the
    chain and with it the rounds.
    """
    greatest = forms.agg(F.max("n")).first()[0] or 1
    links = math.ceil(math.log(greatest, ratio)) + 1
    to = forms.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(links)))):
        onward = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = written(to.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return forms.join(to, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, slip: int = SLIP, ratio: int = FORM_RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the vocabulary."""
    words = written(vocabulary(docs, least_letters, least_count, slip), "words")
    forms = written(with_forms(words, near_pairs(words, least_letters), ratio), "forms")
    return with_roots(forms, ratio).select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
