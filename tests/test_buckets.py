"""Stateful steps that take the keys of a bucket together, against the same steps key by key."""

import random
import uuid
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablesmith.operators.synthesize import Settings
from tablesmith.plans.scenario import Validation, validate
from tablesmith.spec import ColumnSpec, EventSpec, Spec
from tablesmith.streaming import buckets as B
from tablesmith.streaming import histories as H
from tablesmith.streaming.records import repair_stream, write_stream

SCHEMA = pa.schema([("arrival", pa.int64()), ("record", pa.struct([("transaction_id", pa.string()), ("journey_id", pa.string()), ("n", pa.int64())])),
                    ("transaction_hash", pa.int64()), ("journey_hash", pa.int64()), ("sequence", pa.int32()), ("moment", pa.int64()), ("entity", pa.string())])


class Value:
    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class Map:
    def __init__(self):
        self.values, self.calls = {}, 0

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.values.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.values[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        self.values.pop(key, None)


class Handle:
    """State of one bucket."""

    def __init__(self):
        self.value, self.map = Value(), Map()

    def getValueState(self, *args):  # noqa: N802
        return self.value

    def getMapState(self, *args):  # noqa: N802
        return self.map


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def step_of(kind, expire_after=None):
    step, handle = kind(expire_after), Handle()
    step.init(handle)
    return step, handle


def spread(number):
    return number * 0x9E3779B97F4A7C15 % 2**64 - 2**63


def some_rows(n, keys, seed, first=0):
    """Rows in any order of arrival; ids are drawn from a few or many, and hashes differ in all digits."""
    draw = random.Random(seed)
    made = []
    for i in range(n):
        t, j = draw.randrange(keys), draw.randrange(keys)
        made.append({"arrival": first + i, "record": {"transaction_id": f"t{t}", "journey_id": f"j{j}", "n": i}, "transaction_hash": spread(t),
                     "journey_hash": spread(j), "sequence": draw.randrange(50), "moment": draw.randrange(-100, 10**6), "entity": draw.choice([None, None, "e1", "e2", ""])})
    draw.shuffle(made)
    return made


def through(step, rows, now=0, size=40):
    """A bucket's rows through a step, as they came in stretches."""
    cut = [pa.Table.from_pylist(rows[at:at + size], SCHEMA) for at in range(0, len(rows), size)]
    frames = [pd.DataFrame({"rows": [B._bytes(t) for t in cut[at:at + 3]]}) for at in range(0, len(cut), 3)]
    return [r for frame in step.handleInputRows((5,), iter(frames), Clock(now)) for b in frame["rows"] for r in B._table(b).to_pylist()]


def key_by_key(kind, rows, states):
    """The same rows through the step for one key."""
    out, column = {}, "transaction_id" if kind is H.TakenIds else "journey_id"
    for key in sorted({r["record"][column] for r in rows}):
        own = pd.DataFrame([{**r, "repeated": False} for r in rows if r["record"][column] == key])
        step = kind(None)
        step.state = states.setdefault(key, Kept())
        for frame in step.handleInputRows((key,), iter([own]), None):
            out |= {r["arrival"]: r for r in frame.to_dict("records")}
    return out


class Kept:
    """State of one key."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def small(monkeypatch):
    """Windows, runs, pages and stretches of a few rows."""
    for name, n in (("WINDOW_ROWS", 100), ("RUN_BATCH", 7), ("PAGE_KEYS", 4), ("STRETCH_ROWS", 30)):
        monkeypatch.setattr(B, name, n)


@pytest.mark.parametrize("in_memory", [True, False])
@pytest.mark.parametrize("keys", [1, 9, 300])
def test_buckets_give_what_the_steps_give_key_by_key(monkeypatch, in_memory, keys):
    if not in_memory:
        small(monkeypatch)
    taken, ids = step_of(B.TakenIdBuckets)
    journeys, handle = step_of(B.JourneyBuckets)
    one_taken, one_journey = {}, {}
    for batch in range(3):
        rows = some_rows(700, keys, batch, first=batch * 1000)
        got = {r["arrival"]: r for r in through(taken, rows)}
        want = key_by_key(H.TakenIds, rows, one_taken)
        assert len(got) == len(rows) and {a: r["repeated"] for a, r in got.items()} == {a: bool(r["repeated"]) for a, r in want.items()}
        assert all(got[r["arrival"]]["record"] == r["record"] for r in rows)
        got = {r["arrival"]: r for r in through(journeys, rows)}
        want = key_by_key(H.JourneySoFar, rows, one_journey)
        assert {a: (r["sequence"], r["moment"], r["entity"]) for a, r in got.items()} == {
            a: (r["sequence"], r["moment"], None if pd.isna(r["entity"]) else r["entity"]) for a, r in want.items()}
        assert all(got[r["arrival"]]["record"] == r["record"] for r in rows)
    held = [r for (page, ), (b,) in handle.map.values.items() for r in B._table(b).to_pylist()]
    assert sorted((r["key"], (r["sequence"], r["moment"], r["entity"])) for r in held) == sorted((k, s.value) for k, s in one_journey.items())
    if keys == 300 and not in_memory:
        assert handle.value.value[0] >= 6 and len(handle.map.values) > 40


def test_state_is_read_and_written_by_pages():
    step, handle = step_of(B.TakenIdBuckets)
    assert not any(r["repeated"] for r in through(step, [dict(r, record={**r["record"], "transaction_id": f"x{i}"}, transaction_hash=int(h)) for i, (r, h) in enumerate(zip(
        some_rows(20_000, 5, 1), np.random.default_rng(1).integers(-2**63, 2**63 - 1, 20_000)))], size=5000))
    assert handle.map.calls + handle.value.calls < 200  # and not one or two for each of 20,000 ids
    before = handle.map.calls
    key = B._table(next(iter(handle.map.values.values()))[0]).to_pylist()[0]
    assert through(step, [dict(some_rows(1, 5, 1)[0], record={"transaction_id": key["key"], "journey_id": "j", "n": 0}, transaction_hash=key["hash"])])[0]["repeated"]
    assert handle.map.calls == before + 1  # one page is read, none written


def test_rows_without_arrival_come_last():
    rows = [dict(r, arrival=a, record={**r["record"], "journey_id": "j", "transaction_id": "t"}, journey_hash=1, transaction_hash=1, sequence=s, moment=s)
            for r, a, s in zip(some_rows(3, 1, 1), [None, 7, 3], [9, 4, 6])]
    assert {r["arrival"]: r["sequence"] for r in through(step_of(B.JourneyBuckets)[0], rows)} == {3: 6, 7: 6, None: 9}
    assert [r["arrival"] for r in through(step_of(B.TakenIdBuckets)[0], rows) if not r["repeated"]] == [3]


def test_a_key_unseen_for_long_is_forgotten():
    taken = step_of(B.TakenIdBuckets, 100)[0]
    rows = lambda *ids: [dict(r, record={**r["record"], "transaction_id": t}, transaction_hash=hash(t)) for r, t in zip(some_rows(len(ids), 1, 1), ids)]
    marked = lambda now, *ids: [r["record"]["transaction_id"] for r in through(taken, rows(*ids), now) if r["repeated"]]
    assert marked(1000, "a", "b") == []
    assert marked(1050, "a", "c") == ["a"]
    assert sorted(marked(1120, "a", "b", "c")) == ["a", "c"]  # b was seen 120 ms ago, a and c 70
    assert marked(1220, "a", "b", "c") == []


def test_a_shared_id_sends_one_row_of_a_pack(monkeypatch):
    monkeypatch.setattr(B, "PACK_ROWS", 250)
    rows = [dict(r, record={**r["record"], "transaction_id": t}, transaction_hash=h) for i, r in enumerate(some_rows(1000, 5, 3))
            for t, h in [("", None) if i % 5 == 0 else ("shared", 77)]]
    table = pa.Table.from_pylist(rows, SCHEMA)
    out = [(b, r) for batch in B.by_transaction(iter(table.to_batches(max_chunksize=50))) for b, s in zip(batch["bucket"].to_pylist(), batch["rows"].to_pylist()) for r in B._table(s).to_pylist()]
    assert sorted(r["arrival"] for _, r in out) == list(range(1000))
    sent = [r for b, r in out if b < B.BUCKETS]
    assert len(sent) == 4 and not any(r["repeated"] for r in sent) and 77 % B.BUCKETS in {b for b, _ in out}
    assert min(r["arrival"] for r in rows if r["transaction_hash"]) in {r["arrival"] for r in sent}
    assert all(r["repeated"] == (r["transaction_hash"] is not None) for b, r in out if b >= B.BUCKETS)


def test_a_stream_updates_state_by_buckets(spark, tmp_path):
    """As many ids and journeys as rows: the result is the batch job's, from at most one update of state a bucket and step."""
    spec = Spec((ColumnSpec("row", "int"), ColumnSpec("owner", "string", nullable=True)), events=(EventSpec("VIEW", 1), EventSpec("CLICK", 2)), entity_key="owner")
    settings, options = Settings(seed=3, as_of=datetime(2024, 6, 1)), Validation(order="row", journeys=True)
    i = F.col("id")
    rows = spark.range(6000).select(
        i.alias("row"), F.when(i % 10 > 0, F.concat(F.lit("J"), i)).alias("journey_id"), F.concat(F.lit("T"), F.when(i % 10 > 0, i).otherwise(1)).alias("transaction_id"),
        F.lit("VIEW").alias("event_type"), (i % 7).cast("int").alias("event_sequence"), F.timestamp_micros(i * 1_000_003).cast("timestamp_ntz").alias("event_timestamp"),
        F.when(i % 2 == 0, F.concat(F.lit("O"), i)).alias("owner"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.write.parquet(source)
    stream = repair_stream(spark.readStream.schema(rows.schema).parquet(source), spec, settings, options)
    query = write_stream(stream, out, f"buckets-{uuid.uuid4().hex}", continuous=False)
    assert query.awaitTermination(120)
    steps = [s["numRowsUpdated"] for p in query.recentProgress for s in p["stateOperators"] if p["numInputRows"]]
    assert len(steps) == 2 and max(steps) <= B.BUCKETS
    want = validate(rows, spec, settings, options)
    assert sorted(map(repr, spark.read.parquet(out).select(*want.columns).collect())) == sorted(map(repr, want.collect()))
