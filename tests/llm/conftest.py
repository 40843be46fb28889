import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) rows, with extra columns whose names the operators use inside."""

    def make(rows, extra=True):
        df = spark.createDataFrame(list(rows), "doc_id long, text string")
        if not extra:
            return df
        from pyspark.sql import functions as F

        names = ("_k1", "_k2", "n", "key", "id", "gone", "fingerprint", "component_id", "h1", "_s", "_score", "hash", "start", "n_lines", "_row", "a.b")
        return df.select("doc_id", "text", *[F.lit(n).alias(n) for n in names], F.lit("en").alias("lang"))

    return make


@pytest.fixture(scope="session")
def sf_dir():
    """The smallest test tables."""
    import os

    at = "/root/testdata/sf0.001"
    if not os.path.isdir(at):
        pytest.skip("no test tables")
    return at
