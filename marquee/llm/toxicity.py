"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer turns a clause's words into symbols: insults (words and
stems weighted from labelled documents), threats, targets, negations, reporting
verbs, others. Transducers for negation, reported speech and target direction
are composed with it into one machine, whose output is a clause's events:
plain or directed insults and threats, negated and reported ones. A document's
score is logistic in the weights of its matched clauses by event; how far
negation or reporting excuses an insult is fitted, not assumed.

Only training is bounded: lexicon and logistic weights come from at most
``FIT_DOCS`` labelled documents of either label. A word's evidence is counted
over distinct neighbourhoods, so copies of a document count once. Scores read
whole texts.

Defined cases: null, empty and wordless texts match no clause and get the base
score; without labels, or with one label only, every score is 0. Repeated rows
are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import ship, table, written

#: Most labelled documents of either label used for training.
FIT_DOCS = 3000
#: Most words and stems of the lexicon.
LEXICON = 5000
STEMS = (4, 5, 6, 7)
#: Occurrences beyond which a form's count needs no finer look.
EVIDENCE = 64

# Closed word classes of the four languages.
THREATS = "kill hurt destroy beat burn shoot stab töten umbringen schlagen verletzen tuer frapper brûler blesser matar golpear quemar herir"
TARGETS = "you your yours he she they them him her du dich dir ihr euch sie tu toi vous ton ta vos tú usted ustedes vosotros ti"
NEGATIONS = "not no never neither nor isn aren don nicht kein keine nie niemals ne pas jamais aucun ni nunca jamás tampoco"
REPORTING = "said says say told wrote quoted called claims sagte sagt schrieb meinte nannte dit disait écrit appelle dijo dice escribió llamó"

EVENTS = ("insult", "directed", "threat", "aimed_threat", "negated", "reported")
_WORDS = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")

Arcs = dict[tuple[int, str], tuple[int, str]]


class Transducer:
    """Arcs from (state, symbol) to (state, output); a symbol without an arc passes unchanged."""

    def __init__(self, arcs: Arcs):
        self.arcs = arcs

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, symbol))


def compose(first: Transducer, second: Transducer, symbols: tuple[str, ...]) -> Transducer:
    """The machine that feeds ``first``'s output to ``second``, over reachable state pairs."""
    number = {(0, 0): 0}
    arcs: Arcs = {}
    open_pairs = [(0, 0)]
    while open_pairs:
        pair = open_pairs.pop()
        for symbol in symbols:
            a, between = first.step(pair[0], symbol)
            b, out = second.step(pair[1], between)
            if (a, b) not in number:
                number[a, b] = len(number)
                open_pairs.append((a, b))
            arcs[number[pair], symbol] = (number[a, b], out)
    return Transducer(arcs)


_SYMBOLS = ("I", "T", "U", "N", "R", "o")


def negation(reach: int = 3) -> Transducer:
    """Insults and threats at most ``reach`` words after a negation are negated."""
    arcs: Arcs = {(s, "N"): (reach, "N") for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, x): (s - 1, "negated") for x in "IT"} | {(s, x): (s - 1, x) for x in "URo"}
    return Transducer(arcs)


def reported() -> Transducer:
    """What follows a reporting verb in its clause is reported."""
    return Transducer({(0, "R"): (1, "R"), (1, "I"): (1, "reported"), (1, "T"): (1, "reported")})


def direction() -> Transducer:
    """Insults and threats in a clause with a target before them are directed."""
    return Transducer(
        {(0, "U"): (1, "U"), (0, "I"): (0, "insult"), (0, "T"): (0, "threat"), (1, "I"): (1, "directed"), (1, "T"): (1, "aimed_threat")}
    )


def grammar() -> Transducer:
    return compose(compose(negation(), reported(), _SYMBOLS), direction(), _SYMBOLS)


class ClauseScorer:
    """Runs the composed grammar over the clauses that hold an insult or a threat."""

    def __init__(self, lexicon: dict[str, float], weights: list[float] | None = None):
        self.lexicon = lexicon
        self.weights = weights
        self.machine = grammar()
        self.closed = {w: s for s, words in (("T", THREATS), ("U", TARGETS), ("N", NEGATIONS), ("R", REPORTING)) for w in words.split()}
        self.known: dict[str, tuple[str, float]] = {}

    def symbol(self, word: str) -> tuple[str, float]:
        """A lower-cased word's symbol and weight."""
        if (got := self.known.get(word)) is None:
            if len(self.known) > 300_000:
                self.known.clear()
            forms = [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]
            weight = max((self.lexicon.get(f, 0.0) for f in forms), default=0.0)
            kind = "I" if weight else self.closed.get(word, "o")
            got = self.known[word] = (kind, weight or float(kind == "T"))
        return got

    def features(self, text: str | None) -> list[float]:
        """Per event, the summed weight of the clauses in which it is matched."""
        sums = dict.fromkeys(EVENTS, 0.0)
        low = (text or "").lower()
        if any(self.symbol(w)[1] for w in set(_WORDS.findall(low))):
            for clause in _CLAUSE.split(low):
                found = [self.symbol(w) for w in _WORDS.findall(clause)]
                if any(weight for _, weight in found):
                    for event, weight in self.clause(found).items():
                        sums[event] += weight
        return [math.log1p(sums[e]) for e in EVENTS]

    def clause(self, found: list[tuple[str, float]]) -> dict[str, float]:
        """The heaviest match of each event in a clause of symbols."""
        state, best = 0, {}
        for symbol, weight in found:
            state, out = self.machine.step(state, symbol)
            if weight and out in EVENTS:
                best[out] = max(weight, best.get(out, 0.0))
        return best

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        z = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], self.features(text), strict=True))
        return round(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), 6)


def _training(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``(text, toxic)`` of at most ``most`` labelled documents of either label that are not held out."""
    fit = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    fit = fit.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = fit.filter("toxic = 1").orderBy(*order).limit(most).union(fit.filter("toxic = 0").orderBy(*order).limit(most))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.join(F.broadcast(some), "doc_id").select("text", "toxic")  # at most 2 * most ids


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (word or stem, label, neighbourhood) of each batch; a text gives each form's first place."""
    for batch in batches:
        rows = set()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = _WORDS.findall((text or "").lower())
            first: dict[str, str] = {}
            for before, word, after in zip(["", *words[:-1]], words, [*words[1:], ""], strict=True):
                if len(word) >= STEMS[0]:
                    for form in (word, *(word[:k] + "*" for k in STEMS if len(word) > k)):
                        first.setdefault(form, f"{before} {after}")
            rows.update((form, toxic, near) for form, near in first.items())
        kinds = (pa.string(), pa.int32(), pa.string())
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["form", "toxic", "near"])


def learn_lexicon(training: DataFrame) -> dict[str, float]:
    """Words and stems that labelled toxic texts have and clean ones lack, with weights up to 1."""
    ship(training.sparkSession)
    seen = training.mapInArrow(_evidence, "form string, toxic int, near string")
    place = F.xxhash64("near")
    counts = seen.groupBy("form").agg(
        F.count_distinct(F.when(F.col("toxic") == 1, place)).alias("n1"), F.count_distinct(F.when(F.col("toxic") == 0, place)).alias("n0")
    )
    counts = written(counts, "forms")
    total = counts.agg(F.sum("n1"), F.sum("n0")).first()
    if not total[0] or not total[1]:
        return {}
    share = total[0] / (total[0] + total[1])
    # The least count at which, were labels chance, hardly one form so frequent would be all toxic.
    sizes = counts.groupBy(F.least(F.col("n1") + F.col("n0"), F.lit(EVIDENCE)).alias("t")).count().collect()
    often = lambda n: sum(r["count"] for r in sizes if r["t"] >= n)
    least = next((n for n in range(3, EVIDENCE) if often(n) * share**n <= 0.5), EVIDENCE)
    odds = F.log((F.col("n1") + 0.5) / (F.col("n0") + 0.5) * F.lit((1 - share) / share))
    good = counts.filter((F.col("n1") >= least) & (F.col("n0") * 20 * share <= F.col("n1") * (1 - share)))
    rows = good.select("form", odds.alias("w")).orderBy(F.desc("w"), "form").limit(LEXICON).collect()
    top = max((r["w"] for r in rows), default=1.0)
    return {r["form"]: max(r["w"] / top, 0.05) for r in rows}


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 60) -> list[float]:
    """Logistic weights, intercept first, by Newton steps; events only ever add to a score."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    keep = np.full(x.shape[1], ridge * len(y) / 10)
    keep[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (balance * (p - y)) + keep * w
        hessian = (x * (balance * p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        w[1:] = np.maximum(w[1:], 0.0)
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCS) -> ClauseScorer:
    training = written(_training(docs, labels, most), "toxic-training")
    lexicon = learn_lexicon(training)
    if not lexicon:
        return ClauseScorer({})
    scorer = ClauseScorer(lexicon)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.features(t) for t in texts])

    rows = training.select(features("text").alias("x"), "toxic").collect()  # at most 2 * most short rows
    scorer.weights = fit_weights(np.array([r["x"] for r in rows]), np.array([float(r["toxic"]) for r in rows]))
    return scorer


def score(docs: DataFrame, scorer: ClauseScorer) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: doc_id, held_out, score and predicted."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), scores("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
