"""Near duplicates by weighted MinHash (BagMinHash), bands, and exact multiset overlap.

A document is the multiset of its five-word shingles; fewer words make one shingle. Similarity is weighted Jaccard:
the sum of smaller counts over the sum of larger ones.

*Signature.* Every (shingle, level of its count) is a Poisson process of points in (0, inf), each assigned to one of the
registers; a register holds the least point of all processes below the document's counts. Two documents agree in a
register with a probability equal to their weighted Jaccard similarity. Levels 2^(j-1) .. 2^j start as one process of
that many times the rate, and are split in halves (the first point goes to one half, the other half draws a later first
point) only while a point below the bound is left, so a shingle that occurs ten thousand times costs a few dozen draws.
The bound is set so that every register is filled; where one isn't, the bound is doubled.

*Bands.* Equal texts are one node. Nodes that share a band are candidates. They are compared with a few hubs of their
band first, which links the members of ordinary groups in linear work; after that only pairs of nodes whose groups are
still apart are compared, all of them. A sketch of candidates, longer than the signature and with one bit a register,
discards pairs that are four standard errors below the threshold before their shingles are fetched. Links are joined to classes by passes over the edges.

Defined results: a null text or one without words is a class of its own, and stays; equal texts share a class whatever
their other columns; repeated rows with one id and text are one document; the class id is the smallest id of its
documents (null only if all are null); an empty table gives an empty one; further columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import SHINGLE_WORDS, byte_column, fresh, mix64, quoted, saved, text_key, unit, word_hashes
from tablesmith.llm.graph import components
from tablesmith.operators.ordered import lookup_join


@dataclass(frozen=True)
class Bands:
    """At similarity 0.8, 32 bands of 6 registers miss a pair with probability 0.00006."""

    bands: int = 32
    rows: int = 6
    threshold: float = 0.8
    hubs: tuple[int, ...] = (1, 8)
    sketch: int = 2048  # registers of which candidates keep a bit each, a multiple of 64

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingles(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every five-word shingle of the texts laid end to end, and the text each is in."""
    words, text = word_hashes(data, starts)
    counts = np.bincount(text, minlength=len(starts) - 1)
    # Texts with one to four words are filled up with a mark, so that each has a single shingle.
    missing = np.where((counts > 0) & (counts < SHINGLE_WORDS), SHINGLE_WORDS - counts, 0)
    if missing.any():
        ends = np.cumsum(counts)
        at = np.repeat(ends, missing)
        words = np.insert(words, at, np.uint64(0x5BD1E995))
        text = np.insert(text, at, np.repeat(np.arange(len(counts)), missing))
    n = len(words) - SHINGLE_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        hashed = mix64(hashed + words[k:k + n])
    whole = text[:n] == text[SHINGLE_WORDS - 1:]
    return hashed[whole], text[:n][whole]


def counted(hashed: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) in order, with their counts."""
    order = np.lexsort((hashed, text))
    hashed, text = hashed[order], text[order]
    first = np.ones(len(hashed), bool)
    first[1:] = (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    return hashed[at], text[at], np.diff(np.append(at, len(hashed)))


def _exponential(seed: np.ndarray, salt: int) -> np.ndarray:
    return -np.log(unit(mix64(seed + np.uint64(salt))))


def _node(element: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The seed of a process: an element and a block of levels."""
    return mix64(element + mix64(low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + width.astype(np.uint64)))


def bag_minhash(element: np.ndarray, text: np.ndarray, count: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """Registers of each text (inf where a text has no elements), from distinct (text, element) and their counts."""
    values = np.full((n_texts, registers), np.inf)
    total = np.bincount(text, weights=count, minlength=n_texts)
    with np.errstate(divide="ignore"):
        bound = np.where(total > 0, registers * (np.log(registers) + 4) / total, 0.0)
    open_texts = total > 0
    while open_texts.any():
        mine = open_texts[text]
        _points(values, element[mine], text[mine], count[mine], bound)
        open_texts &= np.isinf(values).any(axis=1)
        bound = np.where(open_texts, bound * 2, bound)
    return values


def _points(values: np.ndarray, element: np.ndarray, text: np.ndarray, count: np.ndarray, bound: np.ndarray) -> None:
    """Lower ``values`` to all points up to the texts' bounds."""
    # One process for level 0, and one for each doubling of levels that the count reaches into.
    blocks = [(np.arange(len(element)), 0, 1)]
    low = 1
    while len(element) and (reached := np.flatnonzero(count > low)).size:
        blocks.append((reached, low, low))
        low *= 2
    index = np.concatenate([i for i, _, _ in blocks])
    lows = np.concatenate([np.full(len(i), lo, np.int64) for i, lo, _ in blocks])
    widths = np.concatenate([np.full(len(i), w, np.int64) for i, _, w in blocks])
    seed = _node(element[index], lows, widths)
    point = _exponential(seed, 1) / widths
    near = point <= bound[text[index]]
    index, lows, widths, point, seed = (x[near] for x in (index, lows, widths, point, seed))
    while (wide := widths > 1).any():
        i, lo, half, p, s = index[wide], lows[wide], widths[wide] // 2, point[wide], seed[wide]
        to_left = (mix64(s + np.uint64(2)) & np.uint64(1)) == 0
        parts = [(index[~wide], lows[~wide], widths[~wide], point[~wide], seed[~wide])]
        for left in (True, False):
            at = lo if left else lo + half
            own = _node(element[i], at, half)
            first = np.where(to_left == left, p, p + _exponential(own, 3) / half)
            live = (at < count[i]) & (first <= bound[text[i]])
            parts.append((i[live], at[live], half[live], first[live], own[live]))
        index, lows, widths, point, seed = (np.concatenate(x) for x in zip(*parts))
    n = values.shape[1]
    step = 0
    flat = values.reshape(-1)
    while len(index):
        register = mix64(seed + np.uint64(1000 + 2 * step)) % np.uint64(n)
        np.minimum.at(flat, text[index] * n + register.astype(np.int64), point)
        point = point + _exponential(seed, 1001 + 2 * step)
        live = point <= bound[text[index]]
        index, point, seed = index[live], point[live], seed[live]
        step += 1


def _signatures(bands: Bands):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts = byte_column(batch, "raw")
            n = batch.num_rows
            element, text, count = counted(*shingles(data, starts))
            values = bag_minhash(element, text, count, n, bands.registers).view(np.uint64)
            band = np.zeros((n, bands.bands), np.uint64)
            for k in range(bands.rows):
                band = mix64(band + values.reshape(n, bands.bands, bands.rows)[:, :, k])
            short = (element >> np.uint64(32)).astype(np.uint32)
            ends = np.searchsorted(text, np.arange(n + 1))
            sizes = np.add.reduceat(np.append(count, 0), np.minimum(ends[:-1], len(count))) * (np.diff(ends) > 0) if len(count) else np.zeros(n, np.int64)
            bags = [np.sort(np.repeat(short[a:b], count[a:b])).tobytes() for a, b in zip(ends[:-1], ends[1:])]
            names = [c for c in batch.schema.names if c != "raw"]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sizes, pa.int64()), pa.array(list(band.view(np.int64)), pa.list_(pa.int64())),
                 pa.array(bags, pa.binary())],
                [*names, "n", "bands", "bag"])

    return run


def signatures(docs: DataFrame, bands: Bands, id: str, text: str) -> DataFrame:
    """One saved row per document: row, doc, key, n shingles, bands, and the sorted 32-bit shingle hashes."""
    rows = docs.select(quoted(id).alias("doc"), text_key(quoted(text)).alias("key"), quoted(text).cast("binary").alias("raw"))
    kind = rows.schema["doc"].dataType.simpleString()
    signed = rows.mapInArrow(_signatures(bands), f"doc {kind}, key string, n long, bands array<long>, bag binary")
    return saved(signed.withColumn("row", F.monotonically_increasing_id()))


def _sketched(bands: Bands):
    """Add the sketch: one bit of each register of a second, longer signature, made from the bag."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                bags = [np.frombuffer(x, np.uint32) for x in batch.column(batch.schema.get_field_index("bag")).to_pylist()]
                text = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
                element, text, count = counted(np.concatenate(bags).astype(np.uint64), text)
                values = bag_minhash(mix64(element + np.uint64(99)), text, count, len(bags), bands.sketch).view(np.uint64)
                bits = np.packbits((mix64(values) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(bits), pa.list_(pa.int64()))], [*batch.schema.names, "sketch"])

    return run


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two sorted multisets of 32-bit hashes."""
    def as_set(raw: bytes) -> np.ndarray:
        x = np.frombuffer(raw, np.uint32)
        first = np.ones(len(x), bool)
        first[1:] = x[1:] != x[:-1]
        at = np.arange(len(x))
        return (x.astype(np.uint64) << np.uint64(32)) | (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)

    p, q = as_set(a), as_set(b)
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both / max(1, len(p) + len(q) - both)


def _verified(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            good = [overlap(x.as_py(), y.as_py()) >= threshold for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(good, pa.bool_())), b.filter(pa.array(good, pa.bool_()))], ["a", "b"])

    return run


def _alike(bands: Bands, first: str, second: str) -> Column:
    """Whether two nodes may reach the threshold, by size and by their sketches."""
    apart = sum((F.bit_count(F.col(f"{first}_sketch")[k].bitwiseXOR(F.col(f"{second}_sketch")[k])) for k in range(bands.sketch // 64)), F.lit(0))
    expected = (1 - bands.threshold) / 2
    most = bands.sketch * expected + 4 * (bands.sketch * expected * (1 - expected)) ** 0.5
    small, large = F.least(f"{first}_n", f"{second}_n"), F.greatest(f"{first}_n", f"{second}_n")
    return (small >= large * bands.threshold) & (apart <= most)


def links(members: DataFrame, nodes: DataFrame, bands: Bands) -> DataFrame:
    """(node, component) after all candidates whose groups are apart have been compared.

    ``members`` are (bucket, band, node); ``nodes`` have node, n, sketch, bag, and marks (their bands in short), one row each.
    Members stay narrow: sketches are fetched for distinct pairs, or for the members of buckets whose groups are still
    apart after the hubs. What a step links are groups, so each step's components are found over its own links alone.
    """
    traits = nodes.select("node", "n", "sketch")

    def named(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*(F.col(c).alias(c if c in ("bucket", "band") else name if c == "node" else f"{name}_{c}") for c in rows.columns))

    def both_sides(pairs: DataFrame, more: DataFrame) -> DataFrame:
        return pairs.join(named(more, "a"), "a").join(named(more, "b"), "b")

    def verified(pairs: DataFrame) -> DataFrame:
        with_bags = both_sides(pairs, nodes.select("node", "bag")).select("a_component", "b_component", "a_bag", "b_bag")
        return with_bags.mapInArrow(_verified(bands.threshold), "a long, b long")

    def still_apart(rows: DataFrame, grouped: DataFrame) -> DataFrame:
        placed = saved(rows.drop("component").join(grouped, "node").select("bucket", "band", "node", "component"))
        apart = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("bucket")
        return saved(placed.join(apart, "bucket"))

    grouped = nodes.select("node", F.col("node").alias("component"))
    rows, ids = members.withColumn("component", F.col("node")), ("a", "b", "a_component", "b_component")
    for step, hubs in enumerate((*bands.hubs, None)):
        if hubs is None:
            # A pair that shares several bands is taken in the first of them.
            marked = rows.join(traits.join(nodes.select("node", "marks"), "node"), "node")
            shared = F.array_position(F.zip_with("a_marks", "b_marks", lambda x, y: x == y), F.lit(True))
            pairs = (named(marked, "a").join(named(marked, "b"), ["bucket", "band"])
                     .filter((F.col("a_component") < F.col("b_component")) & _alike(bands, "a", "b") & (shared == F.col("band") + 1)).select(*ids))
        else:
            # The least member by a hash that is the same in all buckets: groups mostly meet the same hub everywhere.
            rank = F.xxhash64("node", F.lit(step))
            # One hub a bucket meets all members, so pairs stay narrow; several are met by members with sketches, so few pairs are kept.
            near = rows.join(traits, "node") if step else rows
            own = [c for c in near.columns if c not in ("bucket", "band")]
            hub = (near.groupBy("bucket", F.pmod(rank, F.lit(hubs)).alias("slot"))
                   .agg(F.min(F.struct(rank.alias("rank"), *own)).alias("hub")).select("bucket", *(f"hub.{c}" for c in own)))
            met = named(near.drop("band"), "a").join(named(hub, "b"), "bucket").filter("a_component != b_component")
            if step:
                pairs = met.filter(_alike(bands, "a", "b")).select(*ids).distinct()
            else:
                pairs = both_sides(met.select(*ids).distinct(), traits).filter(_alike(bands, "a", "b")).select(*ids)
        joined = components(verified(pairs))
        if joined is None:
            continue
        merged = joined.select(F.col("node").alias("component"), F.col("component").alias("merged"))
        # Groups are single nodes at first; later, one of many nodes is spread over copies of its one matching row.
        regrouped = lookup_join(grouped, merged, ["component"], "node") if step else grouped.join(merged, "component", "left")
        grouped = saved(regrouped.select("node", F.coalesce("merged", "component").alias("component")))
        if hubs is not None:
            rows = still_apart(rows, grouped)
    return grouped


def classify(docs: DataFrame, bands: Bands = Bands(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc, key, class_id, and kept (true for one row of each class)."""
    signed = signatures(docs, bands, id, text)
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "row")
    texts = saved(signed.filter("n > 0").groupBy("key").agg(F.min("row").alias("node"), F.min(place).alias("first")))
    bucketed = (signed.select("row", "bands").join(texts.select(F.col("node").alias("row")), "row")
                .select(F.col("row").alias("node"), F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "band", "node"))
    shared = bucketed.groupBy("bucket").agg(F.count("*").alias("nodes")).filter("nodes > 1").select("bucket")
    members = saved(bucketed.join(shared, "bucket"))
    in_short = F.transform("bands", lambda x: F.shiftright(x, 32).cast("int"))
    shared_nodes = signed.select(F.col("row").alias("node"), "n", "bag", in_short.alias("marks")).join(members.select("node").distinct(), "node")
    nodes = saved(shared_nodes.mapInArrow(_sketched(bands), "node long, n long, bag binary, marks array<int>, sketch array<long>"))
    grouped = links(members, nodes, bands)
    of_text = saved(texts.join(grouped, "node", "left").select("key", "first", F.coalesce("component", "node").alias("class")))
    firsts = of_text.groupBy("class").agg(F.min("first").alias("first"))
    # A class of many texts, or a text of many copies, is spread over copies of its one matching row.
    known = saved(lookup_join(of_text.select("key", "class"), firsts, ["class"], "key").select("key", "first"))
    placed = lookup_join(signed.select("row", "doc", "key"), known, ["key"], "row").withColumn("first", F.coalesce("first", place))
    return placed.select("doc", "key", F.col("first.doc").alias("class_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def near_dedup(docs: DataFrame, bands: Bands = Bands(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of ``docs`` that stay, one of each class, in their own columns."""
    id_name, key_name = fresh(docs, "doc_key", "text_key")
    doc_key = F.xxhash64(quoted(id).cast("string"), quoted(id).isNull())
    verdicts = saved(classify(docs, bands, id, text).groupBy(F.xxhash64(F.col("doc").cast("string"), F.col("doc").isNull()).alias(id_name), F.col("key").alias(key_name))
                     .agg(F.max("kept").alias("kept"), F.count_if("kept").alias("stays"), F.count("*").alias("rows")))
    keyed = docs.withColumn(id_name, doc_key).withColumn(key_name, text_key(quoted(text)))
    gone = verdicts.filter("NOT kept").select(id_name, key_name)
    left = keyed.join(gone, [id_name, key_name], "left_anti")
    repeated = verdicts.filter("kept AND rows > stays").select(id_name, key_name)
    if not repeated.isEmpty():
        once = left.join(repeated, [id_name, key_name], "left_semi").dropDuplicates([id_name, key_name])
        left = left.join(repeated, [id_name, key_name], "left_anti").unionByName(once)
    return left.select(*map(quoted, docs.columns))
