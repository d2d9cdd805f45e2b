"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes of all texts are put in groups by their leading bytes, most significant digit first, and only through
``depth`` bytes: two suffixes in one group after the last pass begin with equal windows, and that is all that is asked.
A group with a single document is dropped after each pass, so most suffixes leave early.

* Only suffixes at *anchors* take part. The anchor of a window is the position in it whose first ``digit`` bytes hash
  least, so equal windows have equal anchors, and about one suffix in fourteen is an anchor.
* Pass 1 groups anchors by the first ``digit`` bytes.
* Pass 2 groups what is left by all bytes that windows around the anchor can hold. Where a smaller document has them
  all, every window there is a repetition, and the anchor needs no further pass.
* Pass 3 groups the single windows of anchors that share their digit with another surrounding: the edges of repetitions.

Digits are compared by 64-bit hashes. In a pass each file of texts sends its distinct digits, packed by bucket, with the
least document of each; a bucket answers with one or two bits for each. So a digit that a third of all documents share
is one entry a file, and the answers are short. Texts are written once to files in the shared folder and don't move.

Defined results: a null text is empty; texts shorter than ``depth`` lose nothing; equal ids are one document (nothing
is removed for a copy under the same id); rows without an id come after all others and lose what those have; an empty
table gives an empty one; further columns stay out of the result. Ids are whole numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import byte_column, mix64, quoted, saved
from tablesmith.session import shared_folder

LAST = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Radix:
    depth: int = 50  # bytes of a repetition
    digit: int = 24  # bytes of the first digit
    file_bytes: int = 32 << 20  # text in a file
    chunk_bytes: int = 1 << 20  # text looked at in one go
    bucket_entries: int = 2_000_000

    @property
    def reach(self) -> int:
        """How far a window may begin before its anchor."""
        return self.depth - self.digit


class Chunk:
    """Some texts of a file end to end, with running sums that give the hash of any stretch."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, radix: Radix):
        n = len(data)
        self.data, self.starts, self.radix = data, starts, radix
        powers = np.cumprod(np.full(n + 1, _BASE, np.uint64))
        self.back = np.cumprod(np.full(n + 1, _INVERSE, np.uint64))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n])])
        self.low, self.high = np.repeat(starts[:-1], np.diff(starts)), np.repeat(starts[1:], np.diff(starts))
        windows = np.arange(max(0, n - radix.depth + 1))
        self.windows = windows[windows + radix.depth <= self.high[:len(windows)]]
        self.anchor_of = self._anchors()
        marked = np.zeros(n + 1, bool)
        marked[self.anchor_of] = True
        self.anchors = np.flatnonzero(marked)
        self.number = np.cumsum(marked) - 1  # of the anchor at a place

    def hashed(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))

    def _anchors(self) -> np.ndarray:
        """The anchor of each window: the least digit in it, the first of equal ones."""
        if not len(self.windows):
            return np.zeros(0, np.int64)
        at = np.arange(len(self.data) - self.radix.digit + 1)
        mask = np.uint64((1 << int(len(at)).bit_length()) - 1)
        least = (self.hashed(at, at + self.radix.digit) & ~mask) | at.astype(np.uint64)
        width, span = self.radix.reach + 1, 1
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
        return (least[self.windows] & mask).astype(np.int64)

    def digits(self) -> np.ndarray:
        return self.hashed(self.anchors, self.anchors + self.radix.digit)

    def around(self) -> tuple[np.ndarray, np.ndarray]:
        return np.maximum(self.anchors - self.radix.reach, self.low[self.anchors]), np.minimum(self.anchors + self.radix.depth, self.high[self.anchors])

    def surroundings(self) -> np.ndarray:
        begin, end = self.around()
        return mix64(self.hashed(begin, end) + (self.anchors - begin).astype(np.uint64))


class TextFile:
    """One file of texts, in chunks; anchors of the whole file lie end to end."""

    def __init__(self, path: str, files: pafs.FileSystem, radix: Radix):
        self.radix, self.path, self.files = radix, path, files
        digits, around, docs = [], [], []
        for chunk, ids in self.chunks():
            digits.append(chunk.digits())
            around.append(chunk.surroundings())
            docs.append(ids[np.searchsorted(chunk.starts, chunk.anchors, side="right") - 1])
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.digits, self.around, self.docs = join(digits, np.uint64), join(around, np.uint64), join(docs, np.int64)

    def chunks(self) -> Iterator[tuple[Chunk, np.ndarray]]:
        with self.files.open_input_file(self.path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=256):
                data, starts = byte_column(batch, "raw")
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                first = 0
                while first < len(ids):  # texts up to the chunk's size, one at least
                    last = max(first + 1, int(np.searchsorted(starts, starts[first] + self.radix.chunk_bytes, side="right")) - 1)
                    yield Chunk(data[starts[first]:starts[last]], starts[first:last + 1] - starts[first], self.radix), ids[first:last]
                    first = last

    def flags(self, answers: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """After pass 2, for each anchor: whether all around it is in a smaller document, and whether its windows need pass 3."""
        repeated, needed = np.zeros(len(self.digits), bool), np.zeros(len(self.digits), bool)
        if len(self.digits) and 1 in answers:
            shared = np.flatnonzero(answers[1][_number(self.digits)[1]] > 0)
            if len(shared) and 2 in answers:
                entry, least = self._surroundings(shared)[3:]
                answer = answers[2][entry]
                repeated[shared] = ((answer & 1) > 0) | (self.docs[shared] > least[entry])
                needed[shared] = ~repeated[shared] & ((answer & 2) > 0)
        return repeated, needed

    def _surroundings(self, shared: np.ndarray):
        """Distinct (digit, surrounding) of the anchors given, in order: digit, surrounding, least document; and each anchor's entry."""
        order = np.lexsort((self.docs[shared], self.around[shared], self.digits[shared]))
        d, a, docs = self.digits[shared][order], self.around[shared][order], self.docs[shared][order]
        first = np.ones(len(d), bool)
        first[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1])
        entry = np.empty(len(d), np.int64)
        entry[order] = np.cumsum(first) - 1
        return d[first], a[first], docs[first], entry, docs[first]

    def edge_windows(self, repeated: np.ndarray, needed: np.ndarray) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray, np.ndarray]]:
        """(chunk, ids, windows, hashes) of the windows whose anchor needs pass 3, chunk by chunk."""
        at = 0
        for chunk, ids in self.chunks():
            own = needed[at:at + len(chunk.anchors)]
            at += len(chunk.anchors)
            # Only the window's own anchor is sure to be one in every document that holds the window.
            picked = chunk.windows[own[chunk.number[chunk.anchor_of]]]
            yield chunk, ids, picked, chunk.hashed(picked, picked + self.radix.depth)


def _number(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_inverse=True)


def _least(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, the least document of each, and the entry of every row."""
    order = np.lexsort((docs, hashes))
    h, d = hashes[order], docs[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    entry = np.empty(len(h), np.int64)
    entry[order] = np.cumsum(first) - 1
    return h[first], d[first], entry


def _packed(file: str, bits: int, hashes: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries in the order of their hashes, one row for each bucket that has any."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    bounds = list(zip([0, *cuts], [*cuts, len(hashes)])) if len(hashes) else []
    for k in range(0, len(bounds), 256):
        part = bounds[k:k + 256]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(bucket[a]) for a, _ in part], pa.int64()), pa.array([file] * len(part), pa.string()),
             *(pa.array([c[a:b].tobytes() for a, b in part], pa.binary()) for c in columns)], ["bucket", "file", *(f"c{k}" for k in range(len(columns)))])


def _read(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]


def _answered(table: pa.Table, answers: list[np.ndarray], step: int) -> pa.Table:
    return pa.table({"file": table.column("file"), "step": pa.array([step] * len(answers), pa.int32()), "bucket": table.column("bucket"),
                     "answer": pa.array([x.astype(np.uint8).tobytes() for x in answers], pa.binary())})


def _split(values: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(x) for x in parts])[:-1])


def _shared_digits(table: pa.Table) -> pa.Table:
    """Pass 1: 1 for digits of more than one document. c0: short digits, c1: whether one file has several documents."""
    parts, several = _read(table, "c0", np.uint32), _read(table, "c1", np.uint8)
    _, entry, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    inside = np.bincount(entry, weights=np.concatenate(several), minlength=len(counts)) > 0
    return _answered(table, _split(((counts > 1) | inside)[entry], parts), 1)


def _shared_surroundings(table: pa.Table) -> pa.Table:
    """Pass 2: bit 0 where a smaller document has the same surroundings, bit 1 where the digit has others too."""
    digits, around, docs = _read(table, "c0", np.uint64), _read(table, "c1", np.uint64), _read(table, "c2", np.int64)
    d, a, own = np.concatenate(digits), np.concatenate(around), np.concatenate(docs)
    order = np.lexsort((own, a, d))
    d, a, least = d[order], a[order], own[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1])
    group = np.cumsum(first) - 1
    new_digit = np.ones(len(d), bool)
    new_digit[1:] = d[1:] != d[:-1]
    number = np.cumsum(new_digit) - 1
    several = np.bincount(number, weights=first)[number] > 1
    answer = np.empty(len(d), np.uint8)
    answer[order] = (least > least[first][group]) + 2 * several
    return _answered(table, _split(answer, digits), 2)


def _shared_windows(table: pa.Table) -> pa.Table:
    """Pass 3: 1 where a smaller document has the same window."""
    hashes, docs = _read(table, "c0", np.uint64), _read(table, "c1", np.int64)
    own = np.concatenate(docs)
    _, least, entry = _least(np.concatenate(hashes), own)
    return _answered(table, _split(own > least[entry], hashes), 3)


def _answers(table: pa.Table) -> dict[int, np.ndarray]:
    """Answers of each pass for one file, in the order the file sent its entries."""
    found: dict[int, list[tuple[int, bytes]]] = {}
    for step, bucket, answer in zip(*(table.column(c).to_pylist() for c in ("step", "bucket", "answer"))):
        if step:
            found.setdefault(step, []).append((bucket, answer))
    return {step: np.frombuffer(b"".join(x for _, x in sorted(rows)), np.uint8) for step, rows in found.items()}


def write_texts(docs: DataFrame, folder: str, radix: Radix, id: str, text: str) -> DataFrame:
    """Write texts to files of about ``file_bytes`` and return (file, bytes)."""
    rows = docs.select(F.coalesce(quoted(id).cast("long"), F.lit(int(LAST))).alias("doc"), quoted(id).isNull().alias("none"),
                       F.coalesce(quoted(text).cast("binary"), F.lit(b"")).alias("raw"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pafs.FileSystem.from_uri(folder)
        sink = name = attempt = None
        size = number = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                name, attempt, size = f"part-{TaskContext.get().partitionId():06d}-{number:04d}", f"{path}/_{uuid.uuid4().hex}", 0
                sink = pq.ParquetWriter(files.open_output_stream(attempt), batch.schema, compression="zstd", use_dictionary=False, write_statistics=False)
            sink.write_batch(batch)
            size += batch.column(2).nbytes
            if size >= radix.file_bytes:
                yield close(files, path, sink, attempt, name, size)
                sink, number = None, number + 1
        if sink is not None:
            yield close(files, path, sink, attempt, name, size)

    def close(files, path, sink, attempt, name, size) -> pa.RecordBatch:
        sink.close()
        files.move(attempt, f"{path}/{name}")
        return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([size], pa.int64())], ["file", "bytes"])

    files, path = pafs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    return saved(rows.mapInArrow(write, "file string, bytes long"))


REPLY = "file string, step int, bucket long, answer binary"


def remove_repeats(docs: DataFrame, radix: Radix = Radix(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_bytes, spans, kept): the removed runs of bytes of each document (start, end), and what is left."""
    folder = f"{shared_folder(docs.sparkSession)}/texts-{uuid.uuid4().hex}"
    texts = write_texts(docs, folder, radix, id, text)
    n_files, total = texts.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bits = max(0, int(total // 12 // radix.bucket_entries).bit_length())
    replies = texts.select("file", F.lit(0).alias("step"), F.lit(-1).cast("long").alias("bucket"), F.lit(b"").alias("answer"))

    def opened(name: str) -> TextFile:
        files, path = pafs.FileSystem.from_uri(folder)
        return TextFile(f"{path}/{name}", files, radix)

    def digits(table: pa.Table) -> Iterator[pa.RecordBatch]:
        name = table.column("file")[0].as_py()
        file = opened(name)
        # A short digit has the bits after the bucket's; a chance collision only lets an anchor into pass 2.
        values, least, entry = _least(file.digits, file.docs)
        several = np.zeros(len(values), np.uint8)
        several[entry[file.docs > least[entry]]] = 1
        short = ((values << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        return _packed(name, bits, values, short, several)

    def surroundings(table: pa.Table) -> Iterator[pa.RecordBatch]:
        name, answers = table.column("file")[0].as_py(), _answers(table)
        file = opened(name)
        shared = np.flatnonzero(answers[1][_number(file.digits)[1]] > 0) if 1 in answers else np.zeros(0, np.int64)
        d, a, docs, _, _ = file._surroundings(shared)
        return _packed(name, bits, d, d, a, docs)

    def windows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        name, answers = table.column("file")[0].as_py(), _answers(table)
        file = opened(name)
        hashes, owners, _ = edges(file, *file.flags(answers))
        values, least, _ = _least(hashes, owners)
        return _packed(name, bits, values, values, least)

    def result(table: pa.Table) -> Iterator[pa.RecordBatch]:
        name, answers = table.column("file")[0].as_py(), _answers(table)
        file = opened(name)
        repeated, needed = file.flags(answers)
        hashes, owners, chunks = edges(file, repeated, needed)
        _, least, entry = _least(hashes, owners)
        smaller = (answers[3][entry] > 0) | (owners > least[entry]) if len(hashes) else np.zeros(0, bool)
        at = seen = 0
        for data, starts, ids, low, high, begin in chunks:
            cover = np.zeros(len(data) + 1, np.int32)
            whole = repeated[at:at + len(low)]
            picked = begin[smaller[seen:seen + len(begin)]]
            for places, step in ((low[whole], 1), (high[whole], -1), (picked, 1), (picked + radix.depth, -1)):
                np.add.at(cover, places, step)
            at, seen = at + len(low), seen + len(begin)
            yield _documents(data, starts, ids, np.cumsum(cover[:-1]) > 0)

    def edges(file: TextFile, repeated: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Hashes and documents of the windows of pass 3, and of every chunk what the result needs of it."""
        hashes, owners, chunks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for chunk, ids, begin, found in file.edge_windows(repeated, needed):
            hashes.append(found)
            owners.append(ids[np.searchsorted(chunk.starts, begin, side="right") - 1])
            chunks.append((chunk.data, chunk.starts, ids, *chunk.around(), begin))
        return np.concatenate(hashes), np.concatenate(owners), chunks

    def by_file(rows: DataFrame):
        # Answers are short, the work behind them isn't: as many partitions as files, whatever the bytes say.
        return rows.repartition(max(1, min(n_files, 100_000)), "file").groupBy("file")

    for emit, answer, columns in ((digits, _shared_digits, 2), (surroundings, _shared_surroundings, 3), (windows, _shared_windows, 2)):
        sent = by_file(replies).applyInArrow(_whole(emit, ["bucket", "file"], columns), "bucket long, file string" + "".join(f", c{k} binary" for k in range(columns)))
        replies = replies.unionByName(saved(sent.groupBy("bucket").applyInArrow(answer, REPLY)))
    found = by_file(replies).applyInArrow(_results(result), "doc long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return found.withColumn("doc", F.when(F.col("doc") != int(LAST), F.col("doc")))


def _whole(emit: Callable, names: list[str], columns: int):
    kinds = [("bucket", pa.int64()), ("file", pa.string()), *((f"c{k}", pa.binary()) for k in range(columns))]

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(emit(table)), pa.schema(kinds))

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("spans", _SPANS), ("kept", pa.binary())])


def _documents(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    rows = []
    for k, doc in enumerate(ids):
        a, b = int(starts[k]), int(starts[k + 1])
        own = gone[a:b]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
        rows.append((int(doc), b - a, [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])], data[a:b][~own].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_RESULT)], schema=_RESULT)


def _results(result: Callable):
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(result(table)), _RESULT)

    return run
