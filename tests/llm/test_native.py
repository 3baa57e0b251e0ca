import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from marquee.llm import licenses, quality
from marquee.llm.registry import QUERIES, SQL
from tests.conftest import SF_ORACLE

from .conftest import make_docs


def plan(df):
    return df._jdf.queryExecution().toString()


def test_quality_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_ORACLE}/documents.parquet')")
    df = QUERIES["op10_quality_rules"](spark, SF_ORACLE)
    rel = con.execute(SQL["op10_quality_rules"])
    assert [d[0] for d in rel.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
    assert not re.search("Exchange|Python|Arrow|Pandas", plan(df))


def test_labelled_good_documents_stay_and_bad_ones_go(spark, docs):
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet").select("doc_id", "quality")
    rows = QUERIES["op10_quality_rules"](spark, SF_ORACLE).join(labels, "doc_id").filter("not base_failed").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in rows)


def test_filters_and_joins_on_verdicts_measure_once(spark, docs):
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet").select("doc_id", "quality")
    scored = QUERIES["op10_quality_rules"](spark, SF_ORACLE)
    plain = {r["doc_id"]: r for r in scored.collect()}
    for condition, keep in [("not base_failed", lambda r: not r["base_failed"]), ("kept and n_words > 60", lambda r: r["kept"] and r["n_words"] > 60)]:
        df = scored.filter(condition)
        assert df._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1
        assert {r["doc_id"] for r in df.collect()} == {d for d, r in plain.items() if keep(r)}
    joined = scored.filter("kept").join(labels, "doc_id").filter("not base_failed")
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1
    assert joined.count() == sum(1 for r in labels.collect() if plain[r["doc_id"]]["kept"])


def test_repeated_windows_in_a_very_long_text(spark):
    words = [f"w{k}" for k in range(200_000)]
    texts = [" ".join(words), " ".join([*words, *words[:5]]), " ".join(words[:3] * 40_000)]
    rows = sorted(quality.score(make_docs(spark, texts)).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_words"], r["n_repeat_words"]) for r in rows] == [(200_000, 0), (200_005, 10), (120_000, 120_000)]


def test_quality_defined_cases(spark, clashing):
    good = " ".join(f"the word{k} of" for k in range(30))
    texts = [None, "", " \n\t", good, good + "\n" + good, "# " * 60 + good, "a b " * 40, "the one"]
    df = clashing(make_docs(spark, texts, [1, 2, None, 4, 4, 6, 7, 8]))
    verdicts = {r["n_words"]: (r["base_failed"], r["kept"], r["n_repeat_words"]) for r in quality.score(df).collect()}
    assert verdicts[0] == (True, False, 0) and verdicts[90] == (False, True, 0)
    assert verdicts[180] == (True, False, 180) and verdicts[80] == (True, False, 80) and verdicts[150][:2] == (False, False) or verdicts[150][0]
    out = quality.keep_good(df)
    assert out.columns == df.columns and [r["text"] for r in out.collect()] == [good]
    assert quality.keep_good(df.limit(0)).collect() == [] == quality.score(df.limit(0)).collect()


def test_every_rule_can_reject(spark):
    base = " ".join(f"the word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]} of" for k in range(40))
    bad = {
        "long_words": " ".join(f"the {'x' * 60}{'abcdefghij'[k % 10]}{'klmnop'[k // 10]}" for k in range(50)),
        "symbols": base + " # # # # # # # # # # # # # # # # #",
        "few_stop_words": " ".join(f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(60)),
        "repeated_lines": base + "\nsame line\nsame line\nsame line\nsame line",
        "ellipsis_lines": base + "...\nmore...",
        "bullet_lines": "\n".join(f"- {base[k * 90 : k * 90 + 90]}" for k in range(5)),
        "shouting": base.upper(),
        "digits": " ".join(f"the {k}1234567" for k in range(100, 140)),
        "short_words": " ".join(f"{a} {b}" for a in "abcdefghi" for b in "jklmnop"),
    }
    rows = quality.score(make_docs(spark, list(bad.values()))).collect()
    assert all(name in r["broken_rules"].split(",") and not r["kept"] for name, r in zip(bad, rows, strict=True))
    assert set(bad) == {r[0] for r in quality.RULES}


NOTICE = {
    "apache": "Licensed under the Apache License", "mit": "Released under the MIT", "gpl": "GNU General Public",
    "cc_by_nc": "CC BY-NC", "proprietary": "All rights reserved",
}


def test_licenses_match_the_planted_notices(spark, doc_rows):
    df = QUERIES["op7_licenses"](spark, SF_ORACLE)
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in df.collect() if r["confirmed"]}
    want = {(d, k, f) for d, t in doc_rows for k, line in enumerate((t or "").split("\n")) for f, mark in NOTICE.items() if mark in line}
    assert got == want
    assert not re.search("Python|Pandas|Arrow", plan(df))


@pytest.fixture(scope="module")
def license_model(spark, docs):
    return licenses.fit(docs)


def test_every_name_is_told_and_look_alikes_are_unknown(spark, license_model):
    lines = [(f, f"Code provided under {n}, see file") for f, names in licenses.FAMILIES.items() for n in names]
    lines += [("unknown", x) for x in ("my license plate", "a licensed plumber wrote a letter", "reserved for the gpl of nothing in particular here today")]
    rows = {r["doc_id"]: r["family"] for r in licenses.scan(make_docs(spark, [x for _, x in lines]), license_model).collect()}
    assert {k: rows.get(k, "unknown") for k in range(len(lines))} == {k: f for k, (f, _) in enumerate(lines)}


SHORT = [
    ("gpl", "Licensed under GPLv3."), ("gpl", "Released under the GPLv2+ terms"), ("mit", "Licensed under MIT."), ("lgpl", "LGPLv2.1"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions"),
    ("unknown", "to any person obtaining a seat"), ("unknown", "nothing of the kind"),
]


def test_short_forms_and_bodies_are_found(spark, license_model):
    rows = {r["doc_id"]: r["family"] for r in licenses.scan(make_docs(spark, [x for _, x in SHORT]), license_model).collect()}
    assert {k: rows.get(k, "unknown") for k in range(len(SHORT))} == {k: f for k, (f, _) in enumerate(SHORT)}


def judge(model, line):
    """Plain Python: the best family, its probability, and whether a template confirms it, of one line."""
    words = licenses._words(line)
    grams = {*words, *licenses._pairs(line)}
    weights = [w for w in model.weights if w["gram"] in grams]
    z = {f: sum(w[f] for w in weights) + b for f, b in model.intercepts.items()}
    family = max(z, key=lambda f: (z[f], f))
    probability = 1 / sum(math.exp(v - z[family]) for v in z.values())
    if family == "unknown" or probability <= model.cut:
        return None
    two = set(licenses._pairs(line))
    near = [len({*licenses._words(n)} & {*words}) / len({*licenses._words(n)}) for n in licenses.FAMILIES[family]]
    if len(two) >= licenses.LEAST_PAIRS and family in licenses.BODIES:
        near.append(len(two & {p for body in licenses.BODIES[family] for p in licenses._pairs(body)}) / len(two))
    sure = max(near) >= licenses.CONFIRM
    return (family if sure else "unknown", round(probability, 4), sure)


def test_licenses_equal_brute_force_over_every_line(spark, docs, doc_rows, license_model):
    extra = [f"{x}\n{y} by the {k}" for k, (_, x) in enumerate(SHORT) for _, y in SHORT]
    extra += [lead.format(n) + " and more of the story" for names in licenses.FAMILIES.values() for n in names for lead in licenses.LEADS[:4]]
    rows = doc_rows + [(-1 - k, x) for k, x in enumerate(extra)]
    df = docs.select("doc_id", "text").union(make_docs(spark, extra, [-1 - k for k in range(len(extra))]).select("doc_id", "text"))
    got = sorted((r["doc_id"], r["paragraph"], r["family"], round(r["probability"], 4), r["confirmed"]) for r in licenses.scan(df, license_model).collect())
    kinds = {line: judge(license_model, line) for line in {line for _, t in rows for line in (t or "").split("\n")}}
    want = sorted((d, k, *kinds[line]) for d, t in rows for k, line in enumerate((t or "").split("\n")) if kinds[line])
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-4 for g, w in zip(got, want, strict=True))


def test_every_line_of_the_corpus_is_counted(spark, docs, doc_rows):
    listed = licenses.in_notices(licenses.examples(spark))
    lines = [{*licenses._words(x), *licenses._pairs(x)} for _, t in doc_rows for x in (t or "").split("\n")]
    want = Counter(tuple(sorted(x & listed.keys())) for x in lines if x and x.isdisjoint(licenses.telling_words()))
    assert want.total() > licenses.CORPUS_WEIGHT
    rows = licenses.corpus_grams(docs, [*listed]).collect()
    assert len(rows) == len(lines) and Counter(tuple(r["grams"]) for r in rows if r["grams"] is not None) == want


def test_short_and_very_long_lines_count_in_the_fit(spark):
    texts = ["granted"] * 300 + ["plain words " * 300 + "warranties"] * 300
    grams = {w["gram"] for w in licenses.fit(make_docs(spark, texts)).weights}
    assert {"hereby", "apache"} <= grams and grams.isdisjoint({"granted", "warranties"})


def test_alike_lines_count_each_for_the_cut(spark):
    zero = dict.fromkeys([*licenses.FAMILIES, "unknown"], 0.0)
    model = licenses.LicenseModel([{"gram": "granted", **zero, "mit": 5.0}, {"gram": "shall", **zero, "unknown": 3.0}], zero | {"unknown": 1.0}, 0.5)
    lines = spark.createDataFrame([(["granted"], 3), (["granted", "shall"], 2), (["shall"], 5), ([], 90)], "grams array<string>, n long")
    got = sorted((r["share"], r["n"]) for r in licenses.reached(model, lines).collect())
    first, second = math.exp(5) / (math.exp(5) + 10 + math.exp(1)), math.exp(5) / (math.exp(5) + 10 + math.exp(4))
    assert got == [(0.0, 5), (0.0, 90), (math.ceil(second * 1e6) / 1e6, 2), (math.ceil(first * 1e6) / 1e6, 3)]


def test_license_scan_of_long_hot_and_clashing_rows(spark, license_model, clashing):
    notice = "Licensed under the Apache License, Version 2.0."
    texts = ["word " * 400_000 + notice, *[notice] * 300, "plain"]
    df = clashing(make_docs(spark, texts)).withColumns({"said": F.lit("x"), "family": F.lit("x"), "paragraph": F.lit(7)})
    rows = licenses.scan(df, license_model).collect()
    assert {r["doc_id"] for r in rows if r["confirmed"] and r["family"] == "apache"} >= set(range(1, 301))
    assert {r["paragraph"] for r in rows} == {0} and max(r["doc_id"] for r in rows) < 301


def test_license_defined_cases(spark, license_model):
    text = "Licensed under the Apache License, Version 2.0.\n\nLicensed under the Apache License, Version 2.0."
    df = make_docs(spark, [None, "", "plain text", text, text], [1, 2, 3, None, 4])
    rows = sorted(((r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scan(df, license_model).collect()), key=repr)
    assert rows == sorted([(None, 0, "apache"), (None, 2, "apache"), (4, 0, "apache"), (4, 2, "apache")], key=repr)
    assert licenses.scan(df.limit(0), license_model).collect() == []
