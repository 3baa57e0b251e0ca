"""Print the executed physical plan of every job (after AQE) and the records
each plan's shuffles wrote; the output is committed as PLANS.md.

Usage: python tools/plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from marquee.functions.columns import year_report  # noqa: E402
from marquee.operators import (  # noqa: E402
    join_titles_ratings,
    most_voted_per_year,
    movies_per_year,
    recommend_by_genre,
    top2_rated_per_genre,
    top10_rated_per_year,
    yearly_summary,
)
from marquee.operators.ordering import order_by_group_key  # noqa: E402
from marquee.plans import jobs  # noqa: E402
from marquee.runtime import build_session, scratch_path  # noqa: E402
from marquee.schemas import MOVIES_COLUMNS  # noqa: E402
from marquee.sinks.text import kv_lines, ranked_lines, recommendation_lines  # noqa: E402
from marquee.sinks.parquet import write_movies_parquet, write_summary_parquet  # noqa: E402
from marquee.sources import driver as D  # noqa: E402
from marquee.sources.parquet import read_movies_parquet, read_summary_parquet  # noqa: E402
from marquee.sources.tsv import read_ratings_tsv, read_titles_tsv, write_ratings_tsv, write_titles_tsv  # noqa: E402


def walk(node):
    yield node
    if "QueryStage" in node.nodeName():
        yield from walk(node.plan())
        return
    ch = node.children()
    for i in range(ch.size()):
        yield from walk(ch.apply(i))


def report(title, df):
    qe = df._jdf.queryExecution()
    qe.toRdd().count()  # run this very plan (AQE finalises it and fills its metrics)
    jplan = qe.executedPlan()
    final = jplan.executedPlan() if jplan.nodeName().startswith("AdaptiveSparkPlan") else jplan
    shuffles = [
        int(n.plan().metrics().get("shuffleRecordsWritten").get().value())
        for n in walk(final)
        if "QueryStage" in n.nodeName() and n.plan().nodeName() == "Exchange"
    ]
    print(f"## {title}\n")
    print(f"Shuffle records written per exchange: {shuffles or 'none'}\n")
    print("```")
    print(final.toString().rstrip())
    print("```\n")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session()
    titles = write_titles_tsv(D.order_titles(spark, sf), scratch_path(spark, "p_titles"), "bzip2")
    ratings = write_ratings_tsv(D.order_ratings(spark, sf), scratch_path(spark, "p_ratings"), "bzip2")
    t, r = read_titles_tsv(spark, titles), read_ratings_tsv(spark, ratings)
    movies = write_movies_parquet(join_titles_ratings(t, r), scratch_path(spark, "p_movies"))
    parts = write_movies_parquet(D.part_movies(spark, sf), scratch_path(spark, "p_parts"))
    n_titles = D.order_titles(spark, sf).count()
    print(f"# Physical plans ({sf}, {n_titles} titles, local session)\n")
    print("Final plans after adaptive execution of exactly what each job writes (sinks and")
    print("output sorts included), produced by `tools/plans.py`; inputs are the order")
    print("catalogue as bzip2 TSV (jobs 1-3) and the movie tables. Shuffle records count")
    print("every row written by each exchange, in plan order (top-down).\n")
    report("Job 1: join, movies only, text lines", jobs.movies_text_lines(t, r, "F"))
    report("Job 2: join, all titles, text lines", jobs.titles_text_lines(t, r))
    built = join_titles_ratings(t, r).select(*MOVIES_COLUMNS).sortWithinPartitions("type", "tconst")
    report("Job 3: join, all titles, movie table as written (clustered by type)", built)
    m = lambda cols: read_movies_parquet(spark, movies, cols)
    report("Job 4: movies per year, text lines", kv_lines(movies_per_year(m("movies_per_year"), "F"), "year", ["count"]))
    voted = most_voted_per_year(m("most_voted_per_year"), "F")
    report("Job 5: most voted per year, text lines", kv_lines(voted, "year", ["tconst", "title", "votes"]))
    report("Job 6: top 10 rated per year, text lines", ranked_lines(top10_rated_per_year(m("top10_rated_per_year"), "F"), "year"))
    summary = yearly_summary(m("yearly_summary"), "F")
    report("Job 7: yearly summary", summary)
    spath = write_summary_parquet(summary, scratch_path(spark, "p_summary"))
    report("Job 8: year report, ordered by year", order_by_group_key(year_report(read_summary_parquet(spark, spath)), "year"))
    g = read_movies_parquet(spark, parts, "by_genre")
    report("Job 9: top 2 rated per genre, text lines", ranked_lines(top2_rated_per_genre(g, "ECONOMY"), "genre"))
    report(
        "Job 10: recommendation lines (candidate table materialised and size-checked first; "
        "the one shuffle is the output's sort by tconst)",
        recommendation_lines(recommend_by_genre(g, "ECONOMY")),
    )
    spark.stop()


if __name__ == "__main__":
    main()
