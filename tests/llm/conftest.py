import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
#: Names that operators use themselves, as further columns of their input.
CLASH = ["score", "fp", "component_id", "lang_pred", "n_tokens", "slot", "shard", "keys", "node", "at", "passages", "ids", "kind"]


@pytest.fixture()
def docs(spark):
    """Builds a documents table from texts, or from (doc_id, text) pairs, with
    further columns whose names clash with the operators' own."""
    def make(rows):
        rows = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        df = spark.createDataFrame(rows, DOCS)
        from pyspark.sql import functions as F
        return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])
    return make


@pytest.fixture()
def empty(docs):
    return docs([])
