import pytest

from tests.conftest import SF_ORACLE

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_ORACLE}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture()
def clashing(spark):
    """Adds columns whose names the operators use inside or in their results."""

    def add(df):
        from pyspark.sql import functions as F

        names = ["rid", "th", "n_shingles", "component_id", "kept", "s1", "key", "node", "score", "path", "ids", "row", "turn", "__quality_m", "_d"]
        return df.withColumns({n: F.lit(f"own {n}") for n in names})

    return add
