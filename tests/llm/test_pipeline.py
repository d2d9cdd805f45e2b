"""The stages one after the other, and every query over the smallest tables next to its SQL."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import compare, connect
from tablesmith.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not Path(SF_DIR).exists():
        pytest.skip("test tables are not here")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], SQL.get(name), SF_DIR)
    assert ok, note


def test_stages_take_effect(spark, make_docs, odd_rows, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item, copied = prose(40), prose(90)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = odd_rows + [(20, prose(30), "a"), (21, copied, "a"), (22, copied + " tail", "b"), (23, prose(40) + " " + item, "a"), (24, prose(60), "c")]
    rows += [(30 + k, f"{prose(60)} password={rng.randrange(16**16, 16**17):018x} {prose(9)}", "a") for k in range(9)] + [(50 + k, f"{prose(60)} {rng.randrange(10**15, 10**16)}", "b") for k in range(9)]
    docs = make_docs(rows)
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id for r in docs.collect()})
    clean = {24, *range(30, 39), *range(50, 59)}
    assert seen[0] == clean | {None, 5, 6, 21, 22, 23}
    assert seen[1] == clean | {5, 21, 23}
    assert seen[2] == seen[3] == clean | {5, 21}
    assert docs.filter(F.col("text").contains("password=[SECRET]")).count() >= 1 and docs.filter(F.col("text").rlike("password=[0-9a-f]{18}")).count() == 0
    assert {"size", "source_size", "target", "taken"} <= set(docs.columns)
