"""Journey repairs on records as they arrive, from keyed state.

Two stateful steps do what ``journeys.repair_orders`` finds in a batch: one keyed by transaction id remembers which ids
are taken, one keyed by journey remembers the last sequence, the latest time and the entity key. State is a few values
per key in RocksDB; a restart goes on from the checkpoint. The wide row passes through untouched, and the repairs
themselves are the batch job's expressions.

Both steps take the keys of a bucket together (``buckets``). ``TakenIds`` and ``JourneySoFar`` are the same steps for one key
at a time, on pandas frames: what the buckets are held against in the tests.

Where rows arrive in order (every micro-batch holds later arrivals than the ones before) the result is the batch job's.
Rows of one micro-batch may come in any order. A row that arrives late is held against the rows that came before it.
With ``expire_after`` a key unseen for that long is forgotten: its ids count as new again and its journey starts anew. Off
local mode the executors' Python needs this package (``--py-files``).
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator
from itertools import batched
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tablesmith.operators import journeys as J
from tablesmith.operators.ordered import check_order
from tablesmith.operators.synthesize import Settings
from tablesmith.spec import EventSpec
from tablesmith.streaming.buckets import followed, key_hash

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_ID = "\x00"  # starts the key of rows that have no id and so no history
RUN_ROWS = 20_000  # rows of a journey that are sorted in memory
FRAME_ROWS = 500  # rows of each run in memory while runs are merged


# Columns between the steps. Python sees them as fields of named tuples, so their names don't begin with "_"; the
# record itself is packed in one of them.
PASSED = ["arrival", "record"]


def _run(held: list[pd.DataFrame]) -> BinaryIO:
    """Rows sorted by arrival in a temporary file, a frame at a time."""
    rows, file = pd.concat(held, ignore_index=True).sort_values("arrival", ignore_index=True), tempfile.TemporaryFile()
    for at in range(0, len(rows), FRAME_ROWS):
        pickle.dump(rows.iloc[at:at + FRAME_ROWS], file)
    file.seek(0)
    return file


def _rows(run: BinaryIO) -> Iterator[tuple]:
    with run:
        while True:
            try:
                yield from pickle.load(run).itertuples(index=False)
            except EOFError:
                return


def in_order(rows: Iterator[pd.DataFrame], run_rows: int = RUN_ROWS) -> Iterator[pd.DataFrame]:
    """The same rows by arrival, in frames; at most about ``run_rows`` of them and a frame of each run are in memory."""
    held, runs, columns = [], [], None
    for some in rows:
        columns = list(some.columns)
        held.append(some)
        if sum(map(len, held)) >= run_rows:
            runs.append(_run(held))
            held = []
    if not runs:
        yield pd.concat(held, ignore_index=True).sort_values("arrival", ignore_index=True)
        return
    if held:
        runs.append(_run(held))
    at = columns.index("arrival")
    for some in batched(heapq.merge(*map(_rows, runs), key=lambda row: row[at]), run_rows):
        yield pd.DataFrame(some, columns=columns)


class _Keyed(StatefulProcessor):
    """One value of state per key; the rows of a key pass in frames."""

    STATE = ""

    def __init__(self, expire_after: int | None):
        self.expire_after = expire_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("so_far", self.STATE, self.expire_after)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[0].startswith(NO_ID):
            yield from map(self.without_history, rows)
        else:
            yield from self.follow(rows, self.state.get() if self.state.exists() else None)

    def without_history(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def follow(self, rows: Iterator[pd.DataFrame], before: tuple | None) -> Iterator[pd.DataFrame]:
        raise NotImplementedError


class TakenIds(_Keyed):
    """Marks every row but the first of a transaction id."""

    STATE = "taken boolean"

    def without_history(self, rows):
        return rows[PASSED].assign(repeated=False)

    def follow(self, rows, before):
        self.state.update((True,))
        first = None  # the earliest row so far
        for some in rows:
            marked = some[PASSED].assign(repeated=True)
            if before is None:
                marked = pd.concat([*([] if first is None else [first]), marked], ignore_index=True)
                at = marked["arrival"].idxmin()
                first, marked = marked.loc[[at]], marked.drop(index=at)
            if len(marked):
                yield marked
        if first is not None:
            yield first.assign(repeated=False)


class JourneySoFar(_Keyed):
    """Adds the highest sequence, the latest time and the first entity key of the journey, this row included."""

    STATE = "sequence int, moment bigint, entity string"

    def without_history(self, rows):
        return rows[[*PASSED, "repeated", "sequence", "moment", "entity"]]

    def follow(self, rows, before):
        sequence, moment, entity = before or (None, None, None)
        for some in in_order(rows):
            high, late, owners = some["sequence"].cummax(), some["moment"].cummax(), []
            if sequence is not None:
                high, late = high.clip(lower=sequence), late.clip(lower=moment)
            for own in some["entity"]:
                entity = own if entity is None and not pd.isna(own) else entity
                owners.append(entity)
            sequence, moment = int(high.iloc[-1]), int(late.iloc[-1])
            yield some[[*PASSED, "repeated"]].assign(sequence=high, moment=late, entity=pd.Series(owners, dtype=object))
        self.state.update((sequence, moment, entity))


def repair_journeys(stream: DataFrame, order: str, events: tuple[EventSpec, ...], settings: Settings, entity_key: str | None = None,
                    expire_after: int | None = None) -> DataFrame:
    """``journeys.repair_journeys`` on a stream. ``expire_after`` is in milliseconds of processing time.

    The session must keep state in RocksDB (``keep_state_in_rocksdb``).
    """
    check_order(stream, order)
    stream = J.with_issues(stream)
    has_ids = "transaction_id" in stream.columns

    def unpacked(df: DataFrame) -> DataFrame:
        return df.select("record.*", *[F.col(c).alias(f"__{c}") for c in df.columns])

    entity = F.col(entity_key).cast("string") if entity_key else F.lit(None).cast("string")
    own = stream.select(
        F.col(order).cast("bigint").alias("arrival"), F.struct(*stream.columns).alias("record"),
        *[key_hash(F.col(f"{kind}_id")).alias(f"{kind}_hash") for kind in ("transaction", "journey") if has_ids or kind == "journey"],
        J._sequences(events)[2].alias("sequence"), F.unix_micros(J._time_or(settings).cast("timestamp")).alias("moment"), entity.alias("entity"))
    scanned = unpacked(followed(own, has_ids, expire_after))
    ruled = scanned.withColumns({"__seq": F.col("__sequence"), "__ts": F.timestamp_micros("__moment").cast("timestamp_ntz")})
    if entity_key:
        ruled = ruled.withColumn("__entity", F.col("__entity").cast(stream.schema[entity_key].dataType))
    fixed = J.fill_ids(ruled, order, settings)
    if has_ids:
        fixed = J._renewed(fixed, order, settings, "transaction_id")
    return J._follow_history(J.set_sequences(fixed, events), settings, entity_key).select(*stream.columns)


def keep_state_in_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
