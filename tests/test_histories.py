"""Journey repairs on a stream against the batch job."""

import uuid
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablesmith.operators.synthesize import Settings
from tablesmith.plans.scenario import Validation, validate
from tablesmith.spec import ColumnSpec, EventSpec, Spec
from tablesmith.streaming import histories as H
from tablesmith.streaming.records import repair_stream, write_stream

SPEC = Spec((ColumnSpec("row", "int"), ColumnSpec("owner", "string", nullable=True), ColumnSpec("tags", "string", nullable=True)),
            events=(EventSpec("VIEW", 1), EventSpec("CLICK", 2)), entity_key="owner")
SET = Settings(seed=3, as_of=datetime(2024, 6, 1))
OPTIONS = Validation(order="row", journeys=True)


def faulty(spark, n=400):
    """Journeys with gaps, times and sequences that go back, taken ids, changing and missing owners; one journey is hot."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("row"), F.when(i % 11 == 0, None).when(i % 13 == 0, "").when(i % 3 == 0, "J-hot").otherwise(F.concat(F.lit("J"), i % 17)).alias("journey_id"),
        F.when(i % 6 == 0, None).when(i % 5 == 1, "T-shared").otherwise(F.concat(F.lit("T"), F.floor(i / 3).cast("string"))).alias("transaction_id"),
        F.element_at(F.array(F.lit("VIEW"), F.lit("CLICK"), F.lit("OTHER"), F.lit(None)), (i % 4 + 1).cast("int")).alias("event_type"),
        F.when(i % 4 > 0, i % 9).cast("int").alias("event_sequence"),
        F.when(i % 19 > 0, F.timestamp_micros(1_700_000_000_000_000 + (i * 7919 % 400) * 1_000_003)).cast("timestamp_ntz").alias("event_timestamp"),
        F.when(i % 5 > 1, F.concat(F.lit("O"), i % 4)).alias("owner"), F.when(i % 2 == 0, F.concat(F.lit("t"), i)).alias("tags"))


def texts(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("cuts", [[0, 400], [0, 90, 91, 260, 400]])
def test_arrival_in_order_with_restarts_gives_the_batch_result(spark, tmp_path, cuts):
    rows = faulty(spark)
    want = validate(rows, SPEC, SET, OPTIONS)
    source, out, name = str(tmp_path / "in"), str(tmp_path / "out"), f"histories-{uuid.uuid4().hex}"
    for low, high in zip(cuts, cuts[1:]):
        rows.filter(F.col("row").between(low, high - 1)).orderBy(F.rand(1)).write.mode("append").parquet(source)
        stream = repair_stream(spark.readStream.schema(rows.schema).parquet(source), SPEC, SET, OPTIONS)
        query = write_stream(stream, out, name, continuous=False)  # a new query each time, from the checkpoint
        assert query.awaitTermination(120)
    assert texts(spark.read.parquet(out), want.columns) == texts(want, want.columns)


def test_numeric_owner_without_transaction_ids(spark, tmp_path):
    spec = Spec((ColumnSpec("row", "int"), ColumnSpec("owner", "int", nullable=True)), events=SPEC.events, entity_key="owner")
    rows = faulty(spark, 60).drop("transaction_id", "tags").withColumn("owner", F.when(F.col("row") % 4 > 1, F.col("row") * 10**12))
    want = validate(rows, spec, SET, OPTIONS)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(source)
    stream = repair_stream(spark.readStream.schema(rows.schema).parquet(source), spec, SET, OPTIONS)
    assert write_stream(stream, out, f"histories-{uuid.uuid4().hex}", continuous=False).awaitTermination(120)
    assert texts(spark.read.parquet(out), want.columns) == texts(want, want.columns)


class Kept:
    """State of one key."""

    def __init__(self, value=None):
        self.value = value

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def frames(arrivals, size=50):
    """Frames of a key's rows, and how many of them were read so far."""
    read = [0]

    def made():
        for at in range(0, len(arrivals), size):
            read[0] += 1
            some = arrivals[at:at + size]
            yield pd.DataFrame({"key": "k", "arrival": some, "record": [{"i": i} for i in some], "repeated": False, "sequence": [i * 7 % 31 for i in some],
                                "moment": [i * 13 % 97 for i in some], "entity": [None if i % 3 else f"e{i}" for i in some]})
    return made(), read


@pytest.mark.parametrize("before", [None, (True,)])
def test_rows_of_a_taken_id_pass_while_they_are_read(before):
    arrivals = [i * 37 % 1000 + 5 for i in range(1000)]
    rows, read = frames(arrivals)
    step = H.TakenIds(None)
    step.state = Kept(before)
    passing = step.handleInputRows(("T",), rows, None)
    out = [next(passing)]
    assert read[0] == 1
    out = pd.concat([*out, *passing])
    assert sorted(out["arrival"]) == sorted(arrivals) and all(r["i"] == i for r, i in zip(out["record"], out["arrival"]))
    assert list(out[~out["repeated"].astype(bool)]["arrival"]) == ([] if before else [5])
    assert step.state.value == (True,)


@pytest.mark.parametrize("before", [None, (20, 50, None), (40, 200, "e0")])
def test_a_journey_of_many_rows_is_followed_in_frames(monkeypatch, before):
    monkeypatch.setattr(H, "FRAME_ROWS", 7)
    arrivals = [i * 37 % 1000 for i in range(1000)]
    sizes, whole = [], {}
    for run_rows in (90, 5000):
        monkeypatch.setattr(H.in_order, "__defaults__", (run_rows,))
        step = H.JourneySoFar(None)
        step.state = Kept(before)
        parts = list(step.handleInputRows(("J",), frames(arrivals)[0], None))
        out = pd.concat(parts, ignore_index=True)
        sizes.append(max(map(len, parts)))
        whole[run_rows] = (out.to_dict("list"), step.state.value)
        assert list(out["arrival"]) == sorted(arrivals)
    assert sizes == [90, 1000] and whole[90] == whole[5000]
