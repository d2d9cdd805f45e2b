"""Rows of a stream that follow earlier rows of their key, many keys at a time.

A stateful step costs about a millisecond for each of its keys, and each record it makes a Python object of costs more than
the repairs. So the steps are keyed by a bucket of the key's hash, and records reach them as stretches: bytes of an Arrow
stream that holds some hundred rows of one bucket. A bucket's rows are followed in Arrow and NumPy columns, by arrival.

State has one entry per key, as a step for each key would, in pages of a map state. A page holds about PAGE_KEYS keys; the
pages of a bucket are split as they grow, so a batch reads and writes the pages of the keys it names and no others.

A task holds PACK_ROWS rows or PACK_BYTES while it packs, and WINDOW_ROWS rows or WINDOW_BYTES of a bucket; a bucket with
more is sorted in runs on the task's own disk and followed window by window. Of a transaction id, a task sends the earliest
row of each pack only, so an id on much of the table doesn't gather in one task; rows of a hot journey do. Which row that is
follows from the order of a task's rows: a task that runs again must get them in the same order, as it does from files.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BUCKETS = 1024  # of a key; a stream's state is laid out by it, so it must stay as it is
PASSING = 64  # further ones, for rows that need no state
PACK_ROWS, PACK_BYTES = 200_000, 32 << 20
WINDOW_ROWS, WINDOW_BYTES = 200_000, 32 << 20
STRETCH_ROWS, STRETCH_BYTES = 5_000, 1 << 20
RUN_BATCH = 4_000  # rows of each run in memory while runs are merged
PAGE_KEYS = 500
OUT_ROWS = 10_000
STRETCH = "bucket int, rows binary"
LAST = np.iinfo(np.int64).max


def key_hash(id_column: Column) -> Column:
    """Where the state of an id lies; null for rows that have no id and so no history."""
    own = id_column.cast("string")
    return F.when(own.isNull() | (own == ""), F.lit(None)).otherwise(F.xxhash64(own))


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _cut(table: pa.Table) -> Iterator[bytes]:
    """The rows in stretches, all but the largest rows in some megabytes at most."""
    most = max(1, min(STRETCH_ROWS, STRETCH_BYTES * table.num_rows // max(1, table.nbytes)))
    return (_bytes(table.slice(at, most)) for at in range(0, table.num_rows, most))


def _table(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(rows)).read_all()


def _column(table: pa.Table, name: str) -> pa.Array:
    whole = table.column(name).combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)


def _whole(table: pa.Table, name: str, missing: int = 0) -> np.ndarray:
    return pc.fill_null(_column(table, name), missing).to_numpy(zero_copy_only=False)


def _ids(table: pa.Table, name: str) -> pa.Array:
    ids = _column(table, "record").field(name)
    return ids if pa.types.is_string(ids.type) else ids.cast(pa.string())


def _with(table: pa.Table, **columns: pa.Array) -> pa.Table:
    for name, values in columns.items():
        at = table.schema.get_field_index(name)
        table = table.append_column(name, values) if at < 0 else table.set_column(at, table.schema.field(at), values)
    return table


def _arrivals(table: pa.Table) -> np.ndarray:
    return _whole(table, "arrival", LAST)


def _coded(ids: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The number of each row's key, the first row of each key, and the keys."""
    coded = ids.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return codes, np.unique(codes, return_index=True)[1], coded.dictionary


def _held(tables: Iterable[pa.Table], rows: int, size: int) -> Iterator[pa.Table]:
    """The same rows in tables of about ``rows`` rows or ``size`` bytes."""
    held, n, b = [], 0, 0
    for some in tables:
        held.append(some)
        n, b = n + some.num_rows, b + some.nbytes
        if n >= rows or b >= size:
            yield pa.concat_tables(held).combine_chunks()
            held, n, b = [], 0, 0
    if n:
        yield pa.concat_tables(held).combine_chunks()


def _stretches(table: pa.Table, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    dealt, sorted_ = table.take(pa.array(order)).combine_chunks(), bucket[order]
    names, starts = np.unique(sorted_, return_index=True)
    made, size = [], 0
    for name, start, end in zip(names.tolist(), starts, [*starts[1:], len(sorted_)]):
        for rows in _cut(dealt.slice(start, end - start)):
            made.append((name, rows))
            size += len(rows)
            if size >= STRETCH_BYTES:
                yield _batch(made)
                made, size = [], 0
    if made:
        yield _batch(made)


def _batch(made: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([b for b, _ in made], pa.int32()), pa.array([r for _, r in made], pa.binary())], ["bucket", "rows"])


def _bucket(table: pa.Table, hashes: str, stateful: np.ndarray) -> np.ndarray:
    """The bucket of the key's hash, or of the arrival for rows that need no state."""
    keyed = _whole(table, hashes).view(np.uint64) % np.uint64(BUCKETS)
    other = _arrivals(table).view(np.uint64) % np.uint64(PASSING) + np.uint64(BUCKETS)
    return np.where(stateful, keyed, other).astype(np.int32)


def _present(table: pa.Table, hashes: str) -> np.ndarray:
    return _column(table, hashes).is_valid().to_numpy(zero_copy_only=False)


def by_transaction(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches by transaction id. Rows behind an earlier one of their id in the same pack are marked and need no state."""
    for table in _held((pa.Table.from_batches([b]) for b in batches), PACK_ROWS, PACK_BYTES):
        earliest = np.zeros(table.num_rows, bool)
        present = np.flatnonzero(_present(table, "transaction_hash"))
        present = present[np.argsort(_arrivals(table)[present], kind="stable")]
        earliest[present[_coded(_ids(table, "transaction_id").take(pa.array(present)))[1]]] = True
        repeated = np.zeros(table.num_rows, bool)
        repeated[present] = ~earliest[present]
        yield from _stretches(_with(table, repeated=pa.array(repeated)), _bucket(table, "transaction_hash", earliest))


def by_journey(batches: Iterator[pa.RecordBatch], packed: bool) -> Iterator[pa.RecordBatch]:
    tables = (_table(r.as_py()) for b in batches for r in b.column("rows")) if packed else (pa.Table.from_batches([b]) for b in batches)
    for table in _held(tables, PACK_ROWS, PACK_BYTES):
        yield from _stretches(table, _bucket(table, "journey_hash", _present(table, "journey_hash")))


def unpack(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in batch.column("rows"):
            yield from _table(rows.as_py()).select(columns).to_batches(max_chunksize=OUT_ROWS)


class _Run:
    """Rows sorted by arrival in a temporary file, read a batch at a time."""

    def __init__(self, table: pa.Table):
        self.file: BinaryIO = tempfile.TemporaryFile()
        order = np.argsort(_arrivals(table), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        self.cuts = _arrivals(table)[::RUN_BATCH].tolist()
        with pa.ipc.new_stream(self.file, table.schema) as out:
            out.write_table(table, max_chunksize=RUN_BATCH)
        self.file.seek(0)
        self.batches, self.head = iter(pa.ipc.open_stream(self.file)), None

    def below(self, cut: int | None) -> Iterator[pa.Table]:
        """The next rows, up to those that arrived at the cut or later."""
        while True:
            if self.head is None:
                batch = next(self.batches, None)
                if batch is None:
                    return
                self.head = pa.Table.from_batches([batch])
            n = self.head.num_rows if cut is None else int(np.searchsorted(_arrivals(self.head), cut))
            if n:
                yield self.head.slice(0, n)
            if n < self.head.num_rows:
                self.head = self.head.slice(n)
                return
            self.head = None


def in_windows(tables: Iterable[pa.Table]) -> Iterator[pa.Table]:
    """The same rows in windows, each of which arrived after those before it; rows of a window are in any order."""
    held = _held(tables, WINDOW_ROWS, WINDOW_BYTES)
    first, second = next(held, None), next(held, None)
    if second is None:
        yield from [] if first is None else [first]
        return
    runs = [_Run(first), _Run(second), *map(_Run, held)]
    first = second = None
    cuts = sorted(c for run in runs for c in run.cuts)
    step = max(1, len(cuts) // len(runs))  # so many batches make a window of about a run's size
    for cut in [*dict.fromkeys(cuts[step::step]), None]:
        parts = [part for run in runs for part in run.below(cut)]
        if parts:
            yield pa.concat_tables(parts).combine_chunks()


class Pages:
    """One row of state per key of a bucket, in pages by further digits of the key's hash."""

    def __init__(self, handle: StatefulProcessorHandle, values: list[tuple[str, pa.DataType]], expire_after: int | None):
        self.schema = pa.schema([("key", pa.string()), ("hash", pa.int64()), *values, ("seen", pa.int64())])
        self.expire_after = expire_after
        self.depth = handle.getValueState("depth", "depth int", expire_after)
        # Streams begun with state per id kept a value of this name under other keys, so Spark refuses their checkpoints.
        self.pages = handle.getMapState("so_far", "page int", "rows binary", expire_after)

    def _page(self, hashes: np.ndarray, depth: int) -> np.ndarray:
        return (hashes.view(np.uint64) // np.uint64(BUCKETS) & np.uint64((1 << depth) - 1)).astype(np.int64)

    def _read(self, page: int, now: int) -> pa.Table:
        found = self.pages.getValue((page,))
        rows = self.schema.empty_table() if found is None else _table(bytes(found[0]))
        # State of a key ends as Spark's would: so long after the batch that saw it last.
        return rows if self.expire_after is None else rows.filter(pc.greater(rows["seen"], now - self.expire_after))

    def _write(self, rows: pa.Table, pages: Iterable[int], depth: int) -> None:
        """Place rows, which are all those of the pages."""
        at = self._page(_whole(rows, "hash"), depth)
        order = np.argsort(at, kind="stable")
        rows, (names, starts) = rows.take(pa.array(order)).combine_chunks(), np.unique(at[order], return_index=True)
        for page, start, end in zip(names.tolist(), starts, [*starts[1:], rows.num_rows]):
            self.pages.updateValue((page,), (_bytes(rows.slice(start, end - start)),))
        for page in set(pages) - set(names.tolist()):
            self.pages.removeKey((page,))

    def update(self, keys: pa.Array, hashes: np.ndarray, now: int, follow: Callable[[pa.Table], dict[str, pa.Array]]) -> None:
        """Give ``follow`` the rows of different keys (null where there are none) and keep the values it returns for them."""
        depth = (self.depth.get() or (0,))[0]
        touched = np.unique(self._page(hashes, depth)).tolist()
        held = pa.concat_tables([self._read(p, now) for p in touched]).combine_chunks()
        at = pc.index_in(keys, value_set=_column(held, "key"))
        before = held.take(at)
        after = pa.table({"key": keys, "hash": pa.array(hashes), **follow(before), "seen": pa.array(np.full(len(keys), now))}).cast(self.schema)
        if self.expire_after is None:  # what stays the same is not written
            same = at.is_valid()
            for name in self.schema.names[2:-1]:
                a, b = _column(before, name), _column(after, name)
                same = pc.and_(same, pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null())))
            after = after.filter(pc.invert(same))
            touched = np.unique(self._page(_whole(after, "hash"), depth)).tolist()
            held = held.filter(pa.array(np.isin(self._page(_whole(held, "hash"), depth), touched)))
        if not touched:
            return
        rows = pa.concat_tables([held.filter(pc.invert(pc.is_in(held["key"], value_set=_column(after, "key")))), after]).combine_chunks()
        more = max(0, math.ceil(math.log2(max(1, rows.num_rows) / (PAGE_KEYS * len(touched)))))
        if more:
            for page in set(range(1 << depth)) - set(touched):
                if (others := self._read(page, now)).num_rows:
                    self._write(others, [page], depth + more)
        if more or self.expire_after is not None:
            self.depth.update((depth + more,))
        self._write(rows, touched, depth + more)


class _Buckets(StatefulProcessor):
    """Follows the rows of a bucket, window by window, each against the state the earlier ones left."""

    VALUES: list[tuple[str, pa.DataType]] = []

    def __init__(self, expire_after: int | None):
        self.expire_after = expire_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = Pages(handle, self.VALUES, self.expire_after)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[0] >= BUCKETS:
            yield from (some[["rows"]] for some in rows)
            return
        now = 0 if self.expire_after is None else timerValues.getCurrentProcessingTimeInMs()
        for table in in_windows(_table(r) for some in rows for r in some["rows"]):
            yield from (pd.DataFrame({"rows": [rows]}) for rows in _cut(self.follow(table, now)))

    def follow(self, table: pa.Table, now: int) -> pa.Table:
        raise NotImplementedError


class TakenIdBuckets(_Buckets):
    """Marks every row but the first of a transaction id."""

    VALUES = []

    def follow(self, table, now):
        order = np.argsort(_arrivals(table), kind="stable")
        codes, firsts, keys = _coded(_ids(table, "transaction_id").take(pa.array(order)))
        repeated = np.ones(table.num_rows, bool)

        def mark(before: pa.Table) -> dict:
            new = _column(before, "key").is_null().to_numpy(zero_copy_only=False)
            repeated[order[firsts[new]]] = False
            return {}

        self.pages.update(keys, _whole(table, "transaction_hash")[order][firsts], now, mark)
        return _with(table, repeated=pa.array(repeated))


class JourneyBuckets(_Buckets):
    """Raises sequence and time to the highest of the journey so far, and gives its rows its first entity key."""

    VALUES = [("sequence", pa.int32()), ("moment", pa.int64()), ("entity", pa.string())]

    def follow(self, table, now):
        order = np.argsort(_arrivals(table), kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        codes, firsts, keys = _coded(_ids(table, "journey_id").take(pa.array(order)))
        lasts = len(codes) - 1 - np.unique(codes[::-1], return_index=True)[1]
        kind = table.schema.field("entity").type
        entities = _column(table, "entity").cast(pa.string()).take(pa.array(order))
        found: dict[str, pa.Array] = {}

        def run(before: pa.Table) -> dict:
            after = {}
            for name, least in (("sequence", np.iinfo(np.int32).min), ("moment", np.iinfo(np.int64).min)):
                high = pd.Series(_whole(table, name)[order]).groupby(codes).cummax().to_numpy()
                high = np.maximum(high, _whole(before, name, int(least))[codes])
                found[name], after[name] = pa.array(high[back]), pa.array(high[lasts])
            known = np.flatnonzero(entities.is_valid().to_numpy(zero_copy_only=False))
            named, at = np.unique(codes[known], return_index=True)
            begins = np.full(len(keys), LAST)  # where each journey is first named here
            begins[named] = known[at]
            earlier = _column(before, "entity")
            own = entities.take(pa.array(np.where(begins == LAST, 0, begins), mask=begins == LAST))
            after["entity"] = pc.coalesce(earlier, own)
            begins[earlier.is_valid().to_numpy(zero_copy_only=False)] = -1
            shown = (np.arange(len(codes)) >= begins[codes])[back]
            found["entity"] = after["entity"].take(pa.array(codes[back], mask=~shown)).cast(kind)
            return after

        self.pages.update(keys, _whole(table, "journey_hash")[order][firsts], now, run)
        return _with(table, **found)


def _stateful(stretches: DataFrame, processor: _Buckets) -> DataFrame:
    mode = "None" if processor.expire_after is None else "ProcessingTime"
    return stretches.groupBy("bucket").transformWithStateInPandas(processor, "rows binary", "Append", mode)


def followed(rows: DataFrame, has_ids: bool, expire_after: int | None) -> DataFrame:
    """Rows (arrival, record, their ids' hashes, sequence, moment, entity) with ``repeated`` and the values of their journey so far."""
    if has_ids:
        marked = _stateful(rows.mapInArrow(by_transaction, STRETCH), TakenIdBuckets(expire_after))
        dealt = marked.mapInArrow(partial(by_journey, packed=True), STRETCH)
    else:
        rows = rows.withColumn("repeated", F.lit(False))
        dealt = rows.mapInArrow(partial(by_journey, packed=False), STRETCH)
    names = ["arrival", "record", "repeated", "sequence", "moment", "entity"]
    result = T.StructType([T.StructField(n, T.BooleanType()) if n == "repeated" else T.StructField(n, rows.schema[n].dataType) for n in names])
    return _stateful(dealt, JourneyBuckets(expire_after)).mapInArrow(partial(unpack, columns=names), result)
