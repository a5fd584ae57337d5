import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, first=0, extra=False):
        rows = [(first + i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        return df.selectExpr("*", "'x' as score", "1 as n_words", "'a' as kept", "doc_id as node") if extra else df

    return make
