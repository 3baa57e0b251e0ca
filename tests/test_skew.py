"""A group holding a third of all rows: what crosses the shuffle stays bounded
by (map partitions x groups x n), never by the size of the hot group."""

import pytest
from pyspark.sql import functions as F

from marquee.operators import (
    most_voted_per_year,
    movies_per_year,
    recommend_by_genre,
    top10_rated_per_year,
    yearly_summary,
)

MAPS = 16
ROWS = 300_000
GROUPS = 50  # plus the hot group


def _walk(node):
    yield node
    if "QueryStage" in node.nodeName():
        yield from _walk(node.plan())
        return
    children = node.children()
    for i in range(children.size()):
        yield from _walk(children.apply(i))


def shuffled_records(df, expect_shuffle: bool = True) -> int:
    """Records written by every shuffle of the executed (adaptive) plan."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()  # run this very plan (AQE finalises it and fills its metrics)
    jplan = qe.executedPlan()
    final = jplan.executedPlan() if jplan.nodeName().startswith("AdaptiveSparkPlan") else jplan
    total, seen = 0, False
    for node in _walk(final):
        if "QueryStage" in node.nodeName() and node.plan().nodeName() == "Exchange":
            total += node.plan().metrics().get("shuffleRecordsWritten").get().value()
            seen = True
    assert seen or not expect_shuffle, "no shuffle found: the plan was not measured"
    return total


@pytest.fixture(scope="module")
def skewed(spark):
    """Movies where startYear 1900 (and genre 'Hot') holds a third of the rows."""
    ids = spark.range(ROWS, numPartitions=MAPS)
    hot = F.col("id") % 3 == 0
    return ids.select(
        F.concat(F.lit("tt"), F.col("id").cast("string")).alias("tconst"),
        F.lit("movie").alias("type"),
        F.col("id").cast("string").alias("originalTitle"),
        F.when(hot, F.lit(1900)).otherwise(F.lit(2000) + F.col("id") % GROUPS).cast("int").alias("startYear"),
        F.lit(None).cast("int").alias("endYear"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise((F.col("id") * 7919 % 101) / 10.0).alias("rating"),
        ((F.col("id") * 104729) % 5000).cast("int").alias("votes"),
        F.array(F.when(hot, F.lit("Hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % GROUPS).cast("string")))).alias(
            "genres"
        ),
    )


def test_top10_shuffle_is_bounded(skewed):
    bound = 10 * MAPS * (GROUPS + 1)
    records = shuffled_records(top10_rated_per_year(skewed))
    assert 0 < records <= bound  # vs 300,000 rows in, 100,000 of them in one year


def test_aggregates_combine_map_side(skewed):
    bound = MAPS * (GROUPS + 1)
    assert shuffled_records(movies_per_year(skewed)) <= bound
    assert shuffled_records(most_voted_per_year(skewed)) <= bound  # one row per year and map partition


def test_summary_shuffle_is_bounded(skewed):
    groups = GROUPS + 1
    # count + two rankings cut in one pass + the lists by year + the per-year join sides
    bound = MAPS * groups + 2 * 10 * MAPS * groups + 2 * 10 * groups + 6 * groups
    assert shuffled_records(yearly_summary(skewed)) <= bound


def test_recommendation_does_not_shuffle_the_movies(skewed):
    recs = recommend_by_genre(skewed)
    assert shuffled_records(recs, expect_shuffle=False) == 0  # broadcast join of the checked candidate table
    assert recs.where(F.col("genre") == "Hot").count() == ROWS // 3  # every hot movie gets one


def test_hot_group_results_match_brute_force(skewed):
    top = {r.tconst for r in top10_rated_per_year(skewed).where("year = 1900").collect()}
    brute = (
        skewed.where("startYear = 1900 AND rating IS NOT NULL")
        .orderBy(F.col("rating").desc(), F.col("votes").desc(), F.col("tconst"))
        .limit(10)
    )
    assert top == {r.tconst for r in brute.collect()}


def test_large_n_falls_back_to_bucketed_cut(spark, skewed):
    # n above the partial-limit threshold: the salted two-round cut must give
    # exactly the plain window result.
    from marquee.operators.topn import best_rated_order, top_n_per_group

    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5")
    try:
        cut = top_n_per_group(skewed.where("rating IS NOT NULL"), ["startYear"], best_rated_order(), 10)
        got = sorted((r.startYear, r["rank"], r.tconst) for r in cut.collect())
        assert "_bucket" in cut._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", before)
    plain = top_n_per_group(skewed.where("rating IS NOT NULL"), ["startYear"], best_rated_order(), 10)
    assert got == sorted((r.startYear, r["rank"], r.tconst) for r in plain.collect())
    assert len(got) == 10 * (GROUPS + 1)


def test_fan_in_round_bounds_the_final_task(spark, skewed):
    from marquee.operators.topn import best_rated_order, top_n_per_group

    rated = skewed.where("rating IS NOT NULL")
    plain = top_n_per_group(rated, ["startYear"], best_rated_order(), 10)
    tiered = top_n_per_group(rated, ["startYear"], best_rated_order(), 10, fan_in=4)
    assert sorted(map(tuple, tiered.collect())) == sorted(map(tuple, plain.collect()))
    # the last exchange (into the final ranking) carries at most n x fan_in rows per group
    qe = tiered._jdf.queryExecution()
    qe.toRdd().count()
    final = qe.executedPlan().executedPlan()
    exchanges = [
        int(node.plan().metrics().get("shuffleRecordsWritten").get().value())
        for node in _walk(final)
        if "QueryStage" in node.nodeName() and node.plan().nodeName() == "Exchange"
    ]
    assert len(exchanges) == 2
    assert min(exchanges) <= 10 * 4 * (GROUPS + 1)


def test_summary_with_fan_in_matches(skewed):
    a = sorted(map(repr, yearly_summary(skewed).collect()))
    b = sorted(map(repr, yearly_summary(skewed, fan_in=4).collect()))
    assert a == b
