import pytest
from pyspark.sql import types as T

from tablesmith.llm.common import prepare

FIELDS = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("size_", T.StringType()), ("row", T.LongType())]
SCHEMA = T.StructType([T.StructField(n, t) for n, t in FIELDS])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, source) rows, with extra columns whose names the operators use inside."""
    prepare(spark)

    def make(rows, lang="en"):
        return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", 7) for i, t, s in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, repeated and equal texts; null ids and sources."""
    long = " ".join(f"word{k % 977}x{k % 31}" for k in range(60_000))
    plain = " ".join(f"plain{k}" for k in range(80))
    return [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, long, "b"), (5, plain, "a"), (5, plain, "a"), (6, plain, "b"), (None, plain + " end", None), (7, "one", "b"), (7, "1234 ###", "b")]
