import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark):
    """A table of documents from a list of texts; ids count from 0."""

    def make(values, extra=()):
        rows = [(i, v, "en", "s", None if v is None else len(v)) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, DOCS)
        for name in extra:
            df = df.withColumn(name, F.lit("own"))
        return df

    return make
