"""The command line against the batch jobs."""

import os

from marquee.__main__ import main as cli

from .fixture_rows import write_inputs


def test_cli_runs_the_jobs(spark, tmp_path):
    titles, ratings = write_inputs(str(tmp_path / "in"))
    movies = str(tmp_path / "movies")
    cli(["build-movies", "--titles", titles, "--ratings", ratings, "--out", movies])
    cli(["queries", "--movies", movies, "--out", str(tmp_path / "res")])
    cli(["genres", "--movies", movies, "--out", str(tmp_path / "res")])
    assert sorted(os.listdir(tmp_path / "res")) == [
        "most_voted_per_year", "movies_per_year", "recommend_by_genre", "top10_rated_per_year", "top2_rated_per_genre",
    ]
    cli(["yearly-summary", "--movies", movies, "--out", str(tmp_path / "summary")])
    cli(["year-report", "--summary", str(tmp_path / "summary"), "--out", str(tmp_path / "report")])
    report = "".join(
        open(os.path.join(tmp_path / "report", f), encoding="utf-8").read()
        for f in sorted(os.listdir(tmp_path / "report"))
        if f.startswith("part-")
    )
    assert report.startswith("2000\t5\ttt02\t")
    cli(["movies-text", "--titles", titles, "--ratings", ratings, "--out", str(tmp_path / "j1"), "--partitions", "3"])
    cli(["titles-text", "--titles", titles, "--ratings", ratings, "--out", str(tmp_path / "j2")])
    assert spark.read.text(str(tmp_path / "j1")).count() == 11
    assert spark.read.text(str(tmp_path / "j2")).count() == 12
    cli(["rejects", "--titles", titles, "--ratings", ratings, "--out", str(tmp_path / "odd")])
    odd = [r.value.split("\t")[:3] for r in spark.read.text(str(tmp_path / "odd")).collect()]
    assert odd and all(f in ("titles", "ratings") and v in ("short", "long") and int(n) != {"titles": 9, "ratings": 3}[f] for f, v, n in odd)
    assert spark.range(1).count() == 1  # the session is still usable
