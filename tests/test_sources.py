"""What a source does with input that does not have the declared form."""

import gzip
import re

import pytest
from pyspark.sql import functions as F

from marquee.operators import join_movies_ratings, join_titles_ratings, yearly_summary
from marquee.schemas import RAW_RATINGS
from marquee.sinks.parquet import write_movies_parquet, write_summary_parquet
from marquee.sources import driver as D
from marquee.sources.parquet import read_movies_parquet, read_summary_parquet
from marquee.sources.tsv import count_rejects, read_ratings_raw, read_titles_raw, read_titles_tsv, rejected_lines

from .conftest import SF_SMALL

LINES = [
    "h\t" * 8 + "h",
    "tt1\tmovie\tA \"quoted\tA\t0\t1999\t\\N\t90\tDrama,\\N",
    "tt2\tMovie\t B \tB\t0\t2000\t\\N\t\\N\t\\N",
    "tt3\tmovie",
    "",
    "tt4\tmovie\tD\tD\t0\t2001\t\\N\t5\tComedy\tone more\tand another",
    "\tmovie\tno id\tE\t0\t2001\t\\N\tx\t",
    "tt5\t\tF\tF\t0\t20é1\t\\N\t5\tComedy",
]


def written(tmp_path, codec=None):
    """Two files, each with its header, plain or gzipped."""
    folder = tmp_path / (codec or "plain")
    folder.mkdir()
    for k, lines in enumerate([LINES, [LINES[0], *(x.replace("tt", "uu") for x in LINES[1:])]]):
        body = ("\n".join(lines) + "\n").encode()
        (folder / f"{k}.tsv{'.gz' if codec else ''}").write_bytes(gzip.compress(body) if codec else body)
    return str(folder)


def rows(df):
    return sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", [None, "movie", ""])
def test_lines_spread_before_parsing_read_as_the_parser_does(spark, tmp_path, kind):
    plain, zipped = written(tmp_path), written(tmp_path, "gz")
    want = rows(read_titles_raw(spark, plain, kind=kind))
    assert want and want == rows(read_titles_raw(spark, plain, 3, kind)) == rows(read_titles_raw(spark, zipped, kind=kind))
    assert rows(read_titles_tsv(spark, plain)) == rows(read_titles_tsv(spark, zipped))


def test_gzip_is_parsed_after_the_exchange_that_the_join_uses(spark, tmp_path):
    zipped = written(tmp_path, "gz")
    titles, ratings = read_titles_raw(spark, zipped), read_ratings_raw(spark, zipped)
    for joined in (join_titles_ratings(titles, ratings), join_movies_ratings(titles, ratings)):
        p = plan(joined)
        assert len(re.findall("Exchange hashpartitioning", p)) == 2
    # the scan gives whole lines; fields are cut above the exchange
    p = plan(titles)
    assert "ReadSchema: struct<value:string>" in p and p.index("split(value") < p.index("Exchange hashpartitioning")


def test_short_and_long_lines_are_counted_and_kept_whole(spark, tmp_path):
    for path in (written(tmp_path), written(tmp_path, "gz")):
        assert count_rejects(spark, path) == {"ok": 8, "short": 2, "long": 2}
        bad = {(r.value[2:], r.fields, r.verdict) for r in rejected_lines(spark, path).collect()}
        assert bad == {(LINES[3][2:], 2, "short"), (LINES[5][2:], 11, "long")}
    ratings = tmp_path / "r.tsv"
    ratings.write_text("h\th\th\na\t1\t2\nb\t1\nc\t1\t2\t3\n")
    assert count_rejects(spark, str(ratings), RAW_RATINGS) == {"ok": 1, "short": 1, "long": 1}
    empty = tmp_path / "e.tsv"
    empty.write_text("h\n")
    assert count_rejects(spark, str(empty)) == {"ok": 0, "short": 0, "long": 0}


def test_a_missing_or_differently_typed_column_raises(spark, tmp_path):
    movies = D.order_movies(spark, SF_SMALL)
    path = write_movies_parquet(movies, str(tmp_path / "movies"))
    assert read_movies_parquet(spark, path).count() == movies.count()
    good = spark.read.parquet(path)
    lacking, odd = str(tmp_path / "lacking"), str(tmp_path / "odd")
    good.drop("votes").write.parquet(lacking)
    good.withColumn("votes", F.col("votes").cast("string")).write.parquet(odd)
    with pytest.raises(ValueError, match="votes: missing"):
        read_movies_parquet(spark, lacking)
    with pytest.raises(ValueError, match="votes: string instead of bigint"):
        read_movies_parquet(spark, odd, "top10_rated_per_year")
    # a query that does not ask for the column may read on
    assert read_movies_parquet(spark, lacking, "movies_per_year").count() == movies.count()
    extra = str(tmp_path / "extra")
    good.withColumn("more", F.lit(1)).write.parquet(extra)
    assert read_movies_parquet(spark, extra).columns == good.columns


def test_summary_footer(spark, tmp_path):
    summary = yearly_summary(D.order_movies(spark, SF_SMALL), "F")
    path = write_summary_parquet(summary, str(tmp_path / "summary"))
    assert read_summary_parquet(spark, path).count() == summary.count()
    odd = str(tmp_path / "odd")
    spark.read.parquet(path).withColumn("top10", F.transform("top10", lambda e: e.dropFields("votes"))).write.parquet(odd)
    with pytest.raises(ValueError, match="top10"):
        read_summary_parquet(spark, odd)
