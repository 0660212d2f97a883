import pytest
from pyspark.sql import functions as F

from pricelens.session import ship_package

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of (doc_id, text) rows."""
    ship_package(spark)

    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def clashing():
    """A table with more columns, named like those that operators make."""

    def make(df):
        for name in ("score", "shard", "n", "p", "tokens", "rate", "node", "_id", "features"):
            df = df.withColumn(name, F.lit(name))
        return df

    return make
