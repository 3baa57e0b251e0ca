import corpus_pipeline
import duckdb

from __spark_entry__ import oracle_sql, queries
from marquee.llm import pieces, secretscan
from marquee.llm.common import written
from marquee.llm.registry import QUERIES, SQL
from tests.conftest import SF_ORACLE, SF_SMALL

from .brute import components
from .conftest import make_docs
from .test_leaks import nearest_spans


def test_all_are_registered():
    assert [k for k in queries() if k.startswith("op")] and set(QUERIES) | {"pipeline"} <= set(queries())
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))
    assert set(SQL) <= set(oracle_sql())


def test_stages_against_brute_force(spark, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_ORACLE}/documents.parquet')")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({SQL['op10_quality_rules']}) WHERE kept").fetchall()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF_ORACLE}/benchmark.parquet").select("item_id", "text").collect()]
    now, stages = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, SF_ORACLE), "test-stage")
        stages[name] = now
        assert name == "encoding" or now.dtypes == docs.dtypes
    rows = {n: {r["doc_id"]: r["text"] for r in df.collect()} for n, df in stages.items() if n != "encoding"}
    assert set(rows["quality_rules"]) == good
    kept = {d for d, _, _, keep in components(sorted(rows["quality_rules"].items()), 5) if keep}
    assert set(rows["near_duplicates"]) == kept
    leaky = {d for d, _ in nearest_spans(sorted(rows["near_duplicates"].items()), items)}
    assert set(rows["decontamination"]) == kept - leaky and leaky
    assert set(rows["secrets"]) == set(rows["decontamination"])
    changed = {d for d, t in rows["secrets"].items() if t != rows["decontamination"][d]}
    assert changed == {d for d, t in rows["secrets"].items() if secretscan.MASK in t} and changed
    last = {r["doc_id"]: r for r in stages["encoding"].collect()}
    assert set(last) == set(rows["secrets"]) and all(r["lossless"] for r in last.values())
    own = pieces.encoder(pieces.default_model())
    assert all(own.decode([int(x) for x in r["ids"].split(",")])[1:] == rows["secrets"][d].replace(pieces.SPACE, " ") for d, r in last.items())


def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, SF_ORACLE)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "lossless"] and out.count() > 0


def test_stages_take_nulls_empty_tables_and_any_column_names(spark, clashing):
    good = " ".join(f"the word{k} of a story" for k in range(40))
    df = clashing(make_docs(spark, [None, "", good, good, good + " end", "short"], [1, 2, 3, 3, None, 6]))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF_SMALL)
        rows = out.collect()
        assert stage(spark, df.limit(0), SF_SMALL).collect() == []
        if name == "encoding":
            assert len(rows) == 6 and all(r["lossless"] for r in rows)
        else:
            assert out.columns == df.columns
            assert all(r["key"] == "own key" and r["__quality_m"] == "own __quality_m" for r in rows)
