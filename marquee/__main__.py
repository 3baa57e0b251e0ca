"""Command line: one sub-command per job of the original batch project.

    python -m marquee build-movies --titles T.tsv.gz --ratings R.tsv.gz --out movies/
    python -m marquee rejects --titles T.tsv.gz --ratings R.tsv.gz --out odd/   # short and overlong lines
    python -m marquee movies-per-year --movies movies/ --out q1/
    python -m marquee yearly-summary --movies movies/ --out summary/
    python -m marquee year-report --summary summary/ --out report/
    python -m marquee queries --movies movies/ --out results/      # jobs 4-6
    python -m marquee genres --movies movies/ --out results/       # jobs 9-10

Runs under ``spark-submit`` on a cluster, or locally when no master is set.
"""

from __future__ import annotations

import argparse
import os
import time

from .plans import jobs
from .runtime import build_session
from .schemas import MOVIE


def main(argv: list[str] | None = None, stop: bool = False) -> None:
    """Parse the arguments and run one job; ``stop`` ends the session afterwards."""
    p = argparse.ArgumentParser(prog="marquee")
    sub = p.add_subparsers(dest="cmd", required=True)

    def add(name, *, tsv=False, movies=False, summary=False, kind=True):
        s = sub.add_parser(name)
        if tsv:
            s.add_argument("--titles", required=True)
            s.add_argument("--ratings", required=True)
            s.add_argument("--partitions", type=int, default=None,
                           help="repartition right after reading (for unsplittable .gz input)")
        if movies:
            s.add_argument("--movies", required=True)
        if summary:
            s.add_argument("--summary", required=True)
        s.add_argument("--out", required=True)
        if kind:
            s.add_argument("--kind", default=MOVIE, help="the title type counted as a movie")
        return s

    add("movies-text", tsv=True)
    add("titles-text", tsv=True, kind=False)
    add("build-movies", tsv=True, kind=False)
    add("rejects", tsv=True, kind=False)
    for name in ("movies-per-year", "most-voted-per-year", "top10-rated-per-year", "yearly-summary",
                 "top2-rated-per-genre", "recommend-by-genre", "queries", "genres"):
        add(name, movies=True)
    add("year-report", summary=True, kind=False)
    a = p.parse_args(argv)

    spark = build_session()
    start = time.perf_counter()
    out = a.out
    if a.cmd == "movies-text":
        jobs.run_movies_text(spark, a.titles, a.ratings, out, a.kind, a.partitions)
    elif a.cmd == "titles-text":
        jobs.run_titles_text(spark, a.titles, a.ratings, out, a.partitions)
    elif a.cmd == "build-movies":
        jobs.run_build_movies(spark, a.titles, a.ratings, out, a.partitions)
    elif a.cmd == "rejects":
        jobs.run_rejects(spark, a.titles, a.ratings, out)
    elif a.cmd == "movies-per-year":
        jobs.run_movies_per_year(spark, a.movies, out, a.kind)
    elif a.cmd == "most-voted-per-year":
        jobs.run_most_voted_per_year(spark, a.movies, out, a.kind)
    elif a.cmd == "top10-rated-per-year":
        jobs.run_top10_rated_per_year(spark, a.movies, out, a.kind)
    elif a.cmd == "yearly-summary":
        jobs.run_yearly_summary(spark, a.movies, out, a.kind)
    elif a.cmd == "year-report":
        jobs.run_year_report(spark, a.summary, out)
    elif a.cmd == "top2-rated-per-genre":
        jobs.run_top2_rated_per_genre(spark, a.movies, out, a.kind)
    elif a.cmd == "recommend-by-genre":
        jobs.run_recommend_by_genre(spark, a.movies, out, a.kind)
    elif a.cmd == "queries":
        jobs.run_movies_per_year(spark, a.movies, os.path.join(out, "movies_per_year"), a.kind)
        jobs.run_most_voted_per_year(spark, a.movies, os.path.join(out, "most_voted_per_year"), a.kind)
        jobs.run_top10_rated_per_year(spark, a.movies, os.path.join(out, "top10_rated_per_year"), a.kind)
    elif a.cmd == "genres":
        jobs.run_genres(spark, a.movies, out, a.kind)
    print(f"{a.cmd}: {(time.perf_counter() - start) * 1000:.0f} ms")
    if stop:
        spark.stop()


def cli() -> None:
    """Console entry point."""
    main(stop=True)


if __name__ == "__main__":
    cli()
