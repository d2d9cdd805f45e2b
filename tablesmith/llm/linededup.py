"""Line dedup by a sharded minimal perfect hash over distinct lines.

A line's key is the line without white space at its ends, A-Z lower-cased; keys of at least ``min_chars`` code points
count. A key that at least ``min_docs`` documents hold loses its lines in all of them but the one with the largest id.

* Documents are hashed once, in *blocks* (the partitions they are read in): 128 bits for each line that counts.
* Hashes are counted with a combine before the shuffle: the number of documents and the largest id.
* Distinct hashes are dealt to shards by their leading bits. A shard is a minimal perfect hash (bit arrays, one after the
  other, a key moves on to the next while it collides) and arrays in its order: fingerprints, counts, largest ids.
* Blocks probe the shards: a block sends each shard its distinct hashes in one packed row, and gets back those above
  the limit with their largest id. A line in every document is one probe for each block, so no shard is hot. There are
  never more rows than lines, and documents themselves move only once, with the lines they lose.

Every probe is for an indexed hash; a fingerprint that differs means that the tables changed in between, and fails.

Defined results: a null or empty text is one empty line; every row is a document of its own, so rows with equal ids each
count, and all rows with the largest id keep their lines; rows without an id come before all others; an empty table gives
an empty one; further columns stay as they are. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import fresh, mix64, quoted, saved, text_key

SPACES = b" \t\n\x0b\x0c\r"
NO_ID = -(2**63)
HASH = np.dtype([("high", "<u8"), ("low", "<u8")])
HIT = np.dtype([("high", "<u8"), ("low", "<u8"), ("last", "<i8")])


@dataclass(frozen=True)
class Lines:
    """Limits, and keys for each shard (on average)."""

    min_chars: int = 20
    min_docs: int = 3
    shard_keys: int = 1 << 16


def line_hashes(raw: bytes, min_chars: int) -> tuple[bytes, list[int]]:
    """Packed 128-bit hashes of a text's lines that count, and the places of these lines."""
    hashes, places = [], []
    for k, line in enumerate(raw.split(b"\n")):
        key = line.strip(SPACES).lower()  # of bytes: A-Z only
        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
            hashes.append(xxhash.xxh3_128_digest(key))
            places.append(k)
    return b"".join(hashes), places


def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys fall in the bit array of a level."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    return (mix64(keys["high"] ^ salt) + mix64(keys["low"] + salt)) % np.uint64(size)


@dataclass
class PerfectHash:
    """Bit arrays by level. A key's number is the rank of its bit, so n keys have the numbers 0 to n - 1."""

    levels: list[np.ndarray]

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        """For distinct keys; about three bits a key."""
        levels = []
        while len(keys):
            size = max(2 * len(keys), 8)
            at = slots(keys, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return PerfectHash(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for keys that fall on no bit."""
        found, left, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, bits in enumerate(self.levels):
            at = slots(keys[left], level, len(bits))
            rank = np.cumsum(bits) - 1 + before
            here = bits[at]
            found[left[here]] = rank[at[here]]
            left, before = left[~here], before + int(bits.sum())
        return found

    def packed(self) -> tuple[bytes, list[int]]:
        return b"".join(np.packbits(x).tobytes() for x in self.levels), [len(x) for x in self.levels]

    @staticmethod
    def unpacked(data: bytes, sizes: list[int]) -> PerfectHash:
        levels, start = [], 0
        for size in sizes:
            end = start + (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data[start:end], np.uint8), count=size).astype(bool))
            start = end
        return PerfectHash(levels)


def _joined(blobs: Iterable[bytes], kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _hashed(min_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        for batch in batches:
            found = [line_hashes(x or b"", min_chars) for x in batch["raw"].to_pylist()]
            some = pa.array([bool(p) for _, p in found], pa.bool_())
            out = pa.table({"block": pa.array([block] * len(found), pa.int64()), "document": batch["document"], "id": batch["id"],
                            "hashes": pa.array([h for h, _ in found], pa.binary()), "places": pa.array([p for _, p in found], pa.list_(pa.int32()))})
            yield from out.filter(some).to_batches()

    return run


def _held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch of documents: its distinct hashes, in how many documents, and the largest id."""
    for batch in batches:
        own = [np.unique(np.frombuffer(h, HASH)) for h in batch["hashes"].to_pylist()]
        if own:
            ids = np.repeat(batch["id"].to_numpy(), [len(x) for x in own])
            keys, inverse, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
            last = np.full(len(keys), NO_ID, np.int64)
            np.maximum.at(last, inverse, ids)
            yield pa.RecordBatch.from_arrays([pa.array(keys["high"].view(np.int64)), pa.array(keys["low"].view(np.int64)), pa.array(counts.astype(np.int64)), pa.array(last)],
                                             ["high", "low", "docs", "last"])


def _build(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
    keys = np.empty(part.num_rows, HASH)
    keys["high"], keys["low"] = (part[x].to_numpy().view(np.uint64) for x in ("high", "low"))
    index = PerfectHash.build(keys)
    number = index.numbers(keys)
    prints, counts, last = np.empty(len(keys), np.uint32), np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64)
    prints[number] = keys["low"].astype(np.uint32)
    counts[number] = np.minimum(part["docs"].to_numpy(), 2**32 - 1)
    last[number] = part["last"].to_numpy()
    bits, sizes = index.packed()
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "bits": [bits], "sizes": pa.array([sizes], pa.list_(pa.int32())),
                     "prints": [prints.tobytes()], "counts": [counts.tobytes()], "last": [last.tobytes()]})


def shard_of(high: np.ndarray, bits: int) -> np.ndarray:
    return (high >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(high), np.int64)


def _probes(bits: int):
    """A block's distinct hashes, sorted, so those of a shard stand together; a block read by several tasks asks in each."""
    def packs(block: int, found: list[bytes]) -> pa.RecordBatch:
        keys = np.unique(_joined(found, HASH))
        shards, starts = np.unique(shard_of(keys["high"], bits), return_index=True)
        blobs = [keys[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(keys)])]
        return pa.RecordBatch.from_arrays([pa.array(shards), pa.array([block] * len(shards), pa.int64()), pa.array(blobs, pa.binary())], ["shard", "block", "hashes"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found = -1, []
        for batch in batches:
            for at, hashes in zip(batch["block"].to_pylist(), batch["hashes"].to_pylist()):
                if at != block and found:
                    yield packs(block, found)
                    found = []
                block = at
                found.append(hashes)
        if found:
            yield packs(block, found)

    return run


def _answer(min_docs: int):
    def run(key: tuple[pa.Scalar, ...], probes: pa.Table, shard: pa.Table) -> pa.Table:
        if not probes.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "hits": pa.array([], pa.binary())})
        index = PerfectHash.unpacked(shard["bits"][0].as_py(), shard["sizes"][0].as_py())
        prints, counts, last = (np.frombuffer(shard[x][0].as_py(), kind) for x, kind in (("prints", np.uint32), ("counts", np.uint32), ("last", np.int64)))
        blocks, packs = probes["block"].to_pylist(), [np.frombuffer(x, HASH) for x in probes["hashes"].to_pylist()]
        keys = np.concatenate(packs)
        number = index.numbers(keys)
        if (number < 0).any() or (prints[number] != keys["low"].astype(np.uint32)).any():
            raise ValueError("a line is not in the index: its table changed while it was read")
        hit = counts[number] >= min_docs
        found = np.empty(int(hit.sum()), HIT)
        found["high"], found["low"], found["last"] = keys["high"][hit], keys["low"][hit], last[number[hit]]
        ends = np.cumsum(hit)[np.cumsum([len(x) for x in packs]) - 1]
        blobs = [found[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]
        return pa.table({"block": pa.array(blocks, pa.int64()), "hits": pa.array(blobs, pa.binary())}).filter(pa.array([len(x) > 0 for x in blobs]))

    return run


def _lost(key: tuple[pa.Scalar, ...], lines: pa.Table, answers: pa.Table) -> pa.Table:
    """The places of lines to drop, for the documents of a block that lose some."""
    hits = np.unique(_joined(answers["hits"].to_pylist(), HIT))
    documents, lost = [], []
    if len(hits):
        keys = np.empty(len(hits), HASH)
        keys["high"], keys["low"] = hits["high"], hits["low"]
        for document, id, hashes, places in zip(lines["document"].to_pylist(), lines["id"].to_pylist(), lines["hashes"].to_pylist(), lines["places"].to_pylist()):
            own = np.frombuffer(hashes, HASH)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            drop = (keys[at] == own) & (hits["last"][at] != id)
            if drop.any():
                documents.append(document)
                lost.append(np.asarray(places, np.int32)[drop].tobytes())
    return pa.table({"document": pa.array(documents, pa.string()), "lost": pa.array(lost, pa.binary())})


def _without(text: str, n_lines: str, n_dropped: str, lost: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines, dropped = [], [], []
            for raw, places in zip(batch[text].to_pylist(), batch[lost].to_pylist()):
                parts = (raw or "").split("\n")
                gone = set(np.frombuffer(places or b"", np.int32).tolist())
                kept.append("\n".join(x for k, x in enumerate(parts) if k not in gone) if gone else raw)
                lines.append(len(parts))
                dropped.append(len(gone))
            made = {text: pa.array(kept, pa.string()), n_lines: pa.array(lines, pa.int64()), n_dropped: pa.array(dropped, pa.int64())}
            names = [x for x in batch.schema.names if x not in (lost, *made)]
            order = [x for x in batch.schema.names if x != lost]
            columns = {**{x: batch[x] for x in names}, **made}
            yield pa.RecordBatch.from_arrays([columns[x] for x in [*order, n_lines, n_dropped]], [*order, n_lines, n_dropped])

    return run


def index_lines(lines: DataFrame, limits: Lines = Lines()) -> tuple[DataFrame, int]:
    """The shards, one row each, over ``hashed_lines``, and the leading bits that choose a shard."""
    fields = "high long, low long, docs long, last long"
    keys = saved(lines.select("id", "hashes").mapInArrow(_held, fields).groupBy("high", "low").agg(F.sum("docs").alias("docs"), F.max("last").alias("last")))
    bits = max(0, (keys.count() // limits.shard_keys).bit_length())
    shard = F.shiftrightunsigned("high", 64 - bits) if bits else F.lit(0).cast("long")
    made = keys.withColumn("shard", shard).groupBy("shard").applyInArrow(_build, "shard long, bits binary, sizes array<int>, prints binary, counts binary, last binary")
    return saved(made), bits


def hashed_lines(docs: DataFrame, limits: Lines = Lines(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One saved row per document with lines that count: block, document (its key), id, packed hashes, places."""
    rows = docs.select(document_key(id, text).alias("document"), F.coalesce(quoted(id).cast("long"), F.lit(NO_ID)).alias("id"), quoted(text).cast("binary").alias("raw"))
    return saved(rows.mapInArrow(_hashed(limits.min_chars), "block long, document string, id long, hashes binary, places array<int>"))


def document_key(id: str, text: str):
    """Stands for a document by id and text; rows that share both lose the same lines."""
    return F.concat(F.coalesce(quoted(id).cast("string"), F.lit("")), F.lit(":"), text_key(quoted(text)))


def dedup_lines(docs: DataFrame, limits: Lines = Lines(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without repeated lines, and with n_lines (before) and n_dropped; these get underscores where the names are taken."""
    lines = hashed_lines(docs, limits, id, text)
    shards, bits = index_lines(lines, limits)
    probes = lines.select("block", "hashes").mapInArrow(_probes(bits), "shard long, block long, hashes binary")
    answers = probes.groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(_answer(limits.min_docs), "block long, hits binary")
    lost = (lines.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_lost, "document string, lost binary")
            .groupBy("document").agg(F.first("lost").alias("lost")))
    document, gone, n_lines, n_dropped = fresh(docs, "document", "lost", "n_lines", "n_dropped")
    lost = saved(lost).select(F.col("document").alias(document), F.col("lost").alias(gone))
    joined = docs.withColumn(document, document_key(id, text)).join(lost, document, "left").drop(document)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(_without(text, n_lines, n_dropped, gone), f"{fields}, {n_lines} long, {n_dropped} long")
