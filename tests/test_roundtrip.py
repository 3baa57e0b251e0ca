"""Write titles and ratings in the raw TSV layout with Spark, read them back
through the sources: the typed rows must come back unchanged."""

import os
import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee.runtime import scratch_path
from marquee.schemas import RATINGS, TITLES
from marquee.sources import read_ratings_tsv, read_titles_tsv, write_ratings_tsv, write_titles_tsv
from marquee.sources.parquet import read_lookup
from marquee.sinks.text import write_ranked_text

# Text a tab-separated line can carry: anything but tab, line breaks, the
# writer's internal separator and NUL (the reader's "no quote" character);
# quotes, backslashes, blanks and unicode included.
TEXT = st.text(
    alphabet=st.characters(blacklist_characters="\t\n\r\u0001\u0000", blacklist_categories=("Cs",)), max_size=12
).filter(lambda s: s != "\\N")
WORD = st.text(alphabet=string.ascii_letters + "-'", min_size=1, max_size=8)
YEAR = st.one_of(st.none(), st.integers(1870, 2030))


@st.composite
def title_rows(draw):
    n = draw(st.integers(1, 12))
    ids = draw(st.lists(st.text(alphabet=string.ascii_lowercase + string.digits + " ", min_size=1, max_size=6).map(
        lambda s: "tt" + s), min_size=n, max_size=n, unique=True))
    rows = []
    for tconst in ids:
        rows.append((
            tconst,
            draw(st.sampled_from(["movie", "short", "tvSeries", ""])),
            draw(TEXT),
            draw(TEXT),
            draw(st.sampled_from(["0", "1"])),
            draw(YEAR),
            draw(YEAR),
            draw(st.one_of(st.none(), st.integers(0, 999))),
            draw(st.one_of(st.none(), st.lists(WORD, min_size=1, max_size=3))),
        ))
    return rows


@settings(max_examples=12, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=title_rows())
def test_titles_round_trip(spark, rows):
    df = spark.createDataFrame(rows, TITLES)
    back = read_titles_tsv(spark, write_titles_tsv(df, scratch_path(spark, "rt_titles")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


@settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(
        st.tuples(
            st.text(alphabet=string.ascii_lowercase, min_size=1, max_size=5).map(lambda s: "tt" + s),
            st.one_of(st.none(), st.integers(0, 100).map(lambda x: x / 10)),
            st.one_of(st.none(), st.integers(0, 3_000_000)),
        ),
        min_size=1,
        max_size=10,
        unique_by=lambda r: r[0],
    )
)
def test_ratings_round_trip(spark, rows):
    df = spark.createDataFrame(rows, RATINGS)
    back = read_ratings_tsv(spark, write_ratings_tsv(df, scratch_path(spark, "rt_ratings")))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_compressed_round_trip(spark):
    rows = [("tt1", "movie", "a", '"b\\', "0", 2000, None, 90, ["Drama", "Comedy"])]
    df = spark.createDataFrame(rows, TITLES)
    for codec, ext in (("gzip", ".gz"), ("bzip2", ".bz2")):
        path = write_titles_tsv(df, scratch_path(spark, "rt_c"), codec)
        parts = [f for f in os.listdir(path.replace("file:", "")) if f.startswith("part-")]
        assert parts and all(f.endswith(ext) for f in parts)  # really compressed
        back = read_titles_tsv(spark, path)
        assert [tuple(r) for r in back.collect()] == rows


def test_lookup_round_trip(spark):
    top = spark.createDataFrame(
        [("Drama", 1, "tt2", "B", 9.5, 12), ("Drama", 2, "tt1", "A", 9.0, -1)],
        "genre string, rank int, tconst string, title string, rating double, votes int",
    )
    back = read_lookup(spark, write_ranked_text(top, scratch_path(spark, "rt_lookup"), "genre"))
    assert [tuple(r) for r in back.orderBy(F.col("rating").desc()).collect()] == [
        ("Drama", "tt2", "B", 9.5, 12),
        ("Drama", "tt1", "A", 9.0, -1),
    ]


def test_unrepresentable_genre_lists_read_back_missing(spark):
    rows = [
        ("tt1", "movie", "a", "a", "0", 2000, None, None, []),
        ("tt2", "movie", "b", "b", "0", 2000, None, None, [None]),
        ("tt3", "movie", "c", "c", "0", 2000, None, None, None),
        ("tt4", "movie", "d", "d", "0", 2000, None, None, [None, "Drama"]),
    ]
    back = read_titles_tsv(spark, write_titles_tsv(spark.createDataFrame(rows, TITLES), scratch_path(spark, "rt_g")))
    got = {r.tconst: r.genres for r in back.collect()}
    assert got == {"tt1": None, "tt2": None, "tt3": None, "tt4": [None, "Drama"]}
