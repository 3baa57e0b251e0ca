import math

from marquee.llm import toxicity
from marquee.llm.registry import QUERIES
from tests.conftest import SF_ORACLE

from .conftest import make_docs

BIG = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = QUERIES["op4_toxicity"](spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic) and toxic
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)


def test_every_row_has_a_score(spark, docs):
    rows = QUERIES["op4_toxicity"](spark, SF_ORACLE).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def scorer():
    return toxicity.ClauseScorer({"idiot": 1.0, "moro*": 0.5, "moron": 0.5}, [-2.0, 3.0, 3.0, 1.0, 3.0, 0.0, 0.0])


def events(text):
    return {e for e, f in zip(toxicity.EVENTS, scorer().features(text), strict=True) if f}


def test_grammar():
    assert events("an idiot") == {"insult"}
    assert events("you are an idiot") == {"directed"}
    assert events("you are not an idiot") == {"negated"}
    assert events("not that he is such an idiot") == {"directed"}
    assert events("he said idiot") == {"reported"}
    assert events("he said it. idiot") == {"insult"}
    assert events("i will kill you. you kill") == {"threat", "aimed_threat"}
    assert events("a moronic idea, morality") == {"insult"}
    assert events("") == events(None) == events("a word") == set()


def test_scores_sum_clauses_not_words():
    one, two, same = (scorer().features(t)[0] for t in ("idiot", "idiot. idiot", "idiot idiot"))
    assert one == same < two and math.isclose(two, math.log1p(2))


def test_defined_cases(spark):
    texts = [f"good day number {k}" for k in range(40)] + [f"you idiot {k}" for k in range(20)]
    df = make_docs(spark, [*texts, None, "", texts[-1]], [*range(60), None, 61, 59])
    labels = spark.createDataFrame([(k, int(k >= 40)) for k in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == 63
    assert {r["predicted"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 40} == {0}
    for label in (labels.limit(0), labels.filter("toxic = 1")):
        none = toxicity.learn(df, label)
        assert {r["score"] for r in toxicity.score(df, none).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).collect() == []
