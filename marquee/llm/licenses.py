"""Licence scan: a trained paragraph classifier in DataFrame operations.

Paragraphs (lines) become sparse word 1- and 2-grams. A multinomial logistic
regression over licence families and an unknown class is fitted on notices
written by rule from family names, on sentences of licence bodies, on sentences
about licences that grant none, and on every line of the corpus that has words and
no telling word of a licence name. Its features are the n-grams that are ``LIFT``
times as frequent in licence paragraphs as in these lines (a pair of words only
where one of the words is), counted over all of them; its weights are a table of
them. Lines with the same features are one example that weighs as many; together
the lines of a corpus weigh ``CORPUS_WEIGHT`` notices, however many they are.

Every text is taken apart into words. A line without a weighted word has the
intercepts for its scores, which stay below the cut (``fit`` sees to it): it is
unknown by the model, so only the other lines are summed up. The
cut is calibrated on the same lines, each judged by a model fitted without its
half of them: no more than ``FALSE_SHARE`` of them may reach it.

A prediction is confirmed by comparison with the family's templates: most words
of one of its names, or a line that is mostly one of its bodies.

Defined cases: null and empty texts have no paragraphs; a line that the model
takes for no licence gives no row, a prediction that no template confirms gives
a row as unknown. Repeated rows and lines each count. An empty table gives an
empty result; further columns are not carried. Paragraphs are numbered from 0.
A notice wrapped over several lines is judged line by line.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import table, written
from marquee.operators.broadcast import checked_broadcast_join

#: Most that all lines of the corpus weigh together as examples of the unknown class; a notice weighs 1.
CORPUS_WEIGHT = 2000
#: How much more frequent n-grams with a weight are in licence paragraphs.
LIFT = 4
UNKNOWN = "unknown"
#: Share of the corpus's unknown lines that may reach the cut.
FALSE_SHARE = 0.002
#: Share of a name's words that must be in a paragraph to confirm its family, or of the
#: paragraph's word pairs that must be in a body, where it has at least so many.
CONFIRM, LEAST_PAIRS = 0.75, 4

# Licence families and the names they go by.
FAMILIES = {
    "agpl": ["GNU Affero General Public License version 3", "AGPL 3.0"],
    "apache": ["Apache License, Version 2.0", "Apache-2.0"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License"],
    "cc_by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc_by_nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc_by_sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl": ["GNU General Public License, version 3", "GPL 2.0", "GPL version 3"],
    "lgpl": ["GNU Lesser General Public License version 2.1", "LGPL 3.0"],
    "mit": ["MIT License", "MIT Licence", "under MIT"],
    "mpl": ["Mozilla Public License 2.0", "MPL 2.0"],
    "proprietary": ["All rights reserved"],
}
# Sentences of the licences themselves.
BODIES = {
    "apache": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
# What notices say around a name, and sentences about licences that grant none.
LEADS = (
    "{}", "{}.", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.",
    "Distributed under the terms of the {}", "This software is available under the {}.", "SPDX-License-Identifier: {}",
    "Copyright 2020 the authors. {}", "Permission is granted under the {}.", "See the {} for details.",
)
NO_GRANT = (
    "my driving license expired", "the license plate was blue", "a fishing license costs more", "general rules of the public house",
    "the court reserved its judgment", "all rights and duties of members", "she gave permission to leave", "version 3 of the story",
    "the apache people of the plains", "a license to print money", "creative work in common rooms", "the public and the general",
    "mit der zeit", "reserved seats for all", "no license is needed here", "the terms of the treaty",
)
# Words of names and notices that ordinary text has, too.
PLAIN = ("version", "the", "of", "by", "all", "general", "public", "clause", "rights", "international", "mit")


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table, built by Spark from one literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


#: A number with its points, and the ``v`` that joins it to a name (GPLv3).
NUMBER = "(?<=[a-z])v?[0-9]+(?:[.][0-9]+)*|[0-9]+(?:[.][0-9]+)*"


def tokens(line: Column) -> Column:
    """Lower-case words; a number, with its points, becomes ``0``."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(line), NUMBER, " 0"), "[^a-z0]+"), "")


def pairs(words: Column) -> Column:
    """Neighbouring words; the elements alone enter the function, as an array in it would be made anew for each."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def ngrams(words: Column) -> Column:
    return F.array_distinct(F.concat(words, pairs(words)))


def _words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0]+", re.sub(NUMBER, " 0", text.lower())) if w]


def _pairs(text: str) -> list[str]:
    words = _words(text)
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def telling_words() -> list[str]:
    """Words of names that ordinary text lacks: a line with one is no sure example of the unknown class."""
    return sorted({w for names in FAMILIES.values() for n in names for w in _words(n)} - set(PLAIN) - {"0", "under"})


def paragraphs(docs: DataFrame) -> DataFrame:
    """``(doc_id, paragraph, line)`` of all lines."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))


def _notices() -> list[dict]:
    out = [{"line": lead.format(name), "family": family} for family, names in FAMILIES.items() for name in names for lead in LEADS]
    for family, own in BODIES.items():
        for words in (body.split() for body in own):  # whole, and in parts as lines break
            for n in (8, 14, len(words)):
                out += [{"line": " ".join(words[k : k + n]), "family": family} for k in range(0, max(1, len(words) - n + 1), 3)]
    return out


def examples(spark: SparkSession) -> DataFrame:
    """Labelled paragraphs written by rule: ``(family, grams)``."""
    rows = _notices() + [{"line": x, "family": UNKNOWN} for x in NO_GRANT]
    said = _table(spark, rows, "line string, family string").withColumn("words", tokens(F.col("line")))
    return written(said.select("family", ngrams(F.col("words")).alias("grams")).coalesce(1), "licence-examples")


def corpus_grams(docs: DataFrame, listed: list[str]) -> DataFrame:
    """``(half, grams)`` of all lines: which of the listed n-grams (pairs of listed words) each has; null if it is no sure example or has no words."""
    lines = paragraphs(docs).withColumn("words", tokens(F.col("line")))
    own = F.transform("words", lambda w: F.when(w.isin(listed), w))
    sure = (F.size("words") > 0) & ~F.arrays_overlap("words", F.array(*map(F.lit, telling_words())))
    lines = lines.select((F.pmod(F.xxhash64("line"), F.lit(2)) == 0).alias("half"), F.when(sure, own).alias("own"))
    n = F.greatest(F.size("own") - 1, F.lit(0))
    two = F.zip_with(F.slice("own", F.lit(1), n), F.slice("own", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    # Null where a word is not listed.
    return lines.select("half", F.array_sort(F.array_distinct(F.filter(F.concat("own", two), lambda g: g.isin(listed)))).alias("grams"))


class LicenseModel:
    """Weights per n-gram and family (a pair has one only beside a word of it), intercepts, and the calibrated cut."""

    def __init__(self, weights: list[dict], intercepts: dict[str, float], cut: float):
        self.weights, self.intercepts, self.cut = weights, intercepts, cut

    def may_count(self, words: Column) -> Column:
        """Whether a weighted n-gram can be among the words; without a weighted word, the intercepts decide."""
        return F.arrays_overlap(words, F.array(*(F.lit(w["gram"]) for w in self.weights if " " not in w["gram"])))

    def probabilities(self, lines: DataFrame) -> DataFrame:
        """The distinct ``said`` (words joined by spaces) of ``lines`` with the best family and its probability."""
        return self.best(lines.select("said", F.explode_outer(ngrams(F.split("said", " "))).alias("gram")), "said")

    def best(self, grams: DataFrame, *keys: str) -> DataFrame:
        """Per group of ``(*keys, gram)`` rows the best family and its probability."""
        families = sorted(self.intercepts)
        weights = _table(grams.sparkSession, self.weights, "gram string, " + ", ".join(f"`{f}` double" for f in families))
        sums = grams.join(F.broadcast(weights), "gram", "left").groupBy(*keys).agg(*(F.coalesce(F.sum(f"`{f}`"), F.lit(0.0)).alias(f) for f in families))
        scores = [F.struct((F.col(f) + self.intercepts[f]).alias("z"), F.lit(f).alias("family")) for f in families]
        ranked = sums.select(*keys, F.array(*scores).alias("s")).withColumn("top", F.array_max("s"))
        total = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + F.exp(x["z"] - F.col("top.z")))
        return ranked.select(*keys, F.col("top.family").alias("family"), (1 / total).alias("probability"))


def in_notices(notices: DataFrame) -> dict[str, int]:
    """The n-grams that licence paragraphs written by rule have twice at least, and in how many."""
    grams = notices.filter(F.col("family") != UNKNOWN).select(F.explode("grams").alias("gram"))
    return {r["gram"]: r["count"] for r in grams.groupBy("gram").count().filter("count >= 2").orderBy(F.desc("count"), "gram").collect()}


def features(notices: DataFrame, listed: dict[str, int], corpus: DataFrame) -> list[str]:
    """The listed n-grams to weigh: with ``LIFT`` times their share of all lines of the corpus; pairs, where one of their words is."""
    counts = {r["gram"]: r["count"] for r in corpus.select(F.explode("grams").alias("gram")).groupBy("gram").count().collect()}
    known, lines = notices.filter(F.col("family") != UNKNOWN).count(), corpus.count()
    kept = [g for g, n in listed.items() if n * lines >= LIFT * known * counts.get(g, 0)]
    return [g for g in kept if " " not in g or not {*kept}.isdisjoint(g.split(" "))]


def trained(notices: DataFrame, lines: DataFrame, vocabulary: list[str]) -> LicenseModel:
    """The model of the notices and of ``lines (grams, n)``, each standing for ``n`` unknown lines."""
    names = sorted([*FAMILIES, UNKNOWN])
    each = min(1.0, CORPUS_WEIGHT / max(1, lines.agg(F.sum("n")).first()[0] or 0))
    rows = notices.select("family", "grams", F.lit(1.0).alias("weight")).union(lines.select(F.lit(UNKNOWN), "grams", F.col("n") * each))
    label = F.array_position(F.array(*map(F.lit, names)), F.col("family")).cast("double") - 1
    counted = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True).transform(rows)
    model = LogisticRegression(family="multinomial", regParam=0.001, maxIter=60, weightCol="weight").fit(counted.withColumn("label", label))
    matrix = model.coefficientMatrix.toArray()
    weights = [{"gram": g, **{f: round(float(matrix[k, j]), 6) for k, f in enumerate(names)}} for j, g in enumerate(vocabulary)]
    return LicenseModel(weights, {f: round(float(model.interceptVector[k]), 6) for k, f in enumerate(names)}, 0.5)


def reached(model: LicenseModel, lines: DataFrame) -> DataFrame:
    """``(share, n)``: the probability of a licence, 0 where unknown is likelier, of ``lines (grams, n)``; rounded up to six digits."""
    judged = model.best(lines.select("grams", "n", F.explode_outer("grams").alias("gram")), "grams", "n")
    share = F.when(F.col("family") == UNKNOWN, 0.0).otherwise(F.ceil(F.col("probability") * 1e6) / 1e6)
    return judged.select(share.alias("share"), "n")


def fit(docs: DataFrame) -> LicenseModel:
    notices = examples(docs.sparkSession)
    listed = in_notices(notices)
    corpus = written(corpus_grams(docs, [*listed]), "licence-corpus").filter("grams is not null")
    vocabulary = features(notices, listed, corpus)
    alike = corpus.select("half", F.filter("grams", lambda g: g.isin(vocabulary)).alias("grams")).groupBy("half", "grams").agg(F.count("*").alias("n"))
    alike = written(alike, "licence-unknown")
    halves = alike.filter("half"), alike.filter("not half")
    found, *without = (trained(notices, lines, vocabulary) for lines in (alike, *halves[::-1]))
    judged = map(reached, without, halves)
    share = next(judged).union(next(judged)).agg(F.percentile("share", 1 - FALSE_SHARE, F.col("n"))).first()[0]
    # With the intercepts alone, no family's probability passes this bound.
    bare = max(v for f, v in found.intercepts.items() if f != UNKNOWN) - found.intercepts[UNKNOWN]
    found.cut = max(0.5, share or 0.0, 1 / (1 + math.exp(-bare)))
    return found


def scan(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """Per paragraph that the model takes for a licence: doc_id, paragraph, family (unknown if not confirmed), probability, confirmed.

    Whole texts are asked for a weighted word first, then the lines of those that have one.
    """
    model = model or fit(docs)
    spark = docs.sparkSession
    some = docs.select("doc_id", "text").filter(model.may_count(tokens(F.col("text"))))
    lines = paragraphs(some).filter(model.may_count(tokens(F.col("line"))))
    lines = written(lines.select("doc_id", "paragraph", F.concat_ws(" ", tokens(F.col("line"))).alias("said")), "licence-lines")
    # Lines of the same words are judged once.
    best = model.probabilities(lines.select("said").distinct()).filter((F.col("family") != UNKNOWN) & (F.col("probability") > model.cut))
    names = [{"family": f, "held": sorted(set(_words(name))), "body": False} for f, own in FAMILIES.items() for name in own]
    bodies = [{"family": f, "held": sorted({p for body in own for p in _pairs(body)}), "body": True} for f, own in BODIES.items()]
    templates = _table(spark, names + bodies, "family string, held array<string>, body boolean")
    words = F.split("said", " ")
    two = F.array_distinct(pairs(words))
    in_body = F.when(F.size(two) >= LEAST_PAIRS, F.size(F.array_intersect(two, "held")) / F.size(two))
    near = F.when(F.col("body"), in_body).otherwise(F.size(F.array_intersect("held", words)) / F.size("held"))
    close = best.join(F.broadcast(templates), "family").groupBy("said", "family", "probability").agg(F.max(near).alias("near"))
    sure = F.col("near") >= CONFIRM
    judged = close.select(
        "said", F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"), F.round("probability", 6).alias("probability"), sure.alias("confirmed")
    )
    # One line may be in most documents: its verdict goes to the rows, or the rows are salted.
    with_verdict = checked_broadcast_join(lines, judged, ["said"], salt_by=("doc_id", "paragraph"))
    return with_verdict.select("doc_id", "paragraph", "family", "probability", "confirmed")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
