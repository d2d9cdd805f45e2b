"""Benchmark decontamination by pigeonhole edit matching.

Items and texts are compared in lower case with white space collapsed. An item of n characters may occur with up to
e = floor(rate * n) edits. It is cut into e + 1 pieces, of which at least one must occur unchanged, so exact hits of
pieces (found for all items at once by an automaton) lead to every match. A hit is verified from small to large: pieces
form a binary tree, and a block of k pieces may hold k - 1 edits, because some child of a block within its budget is
within its own. Each block is matched by Myers' bit-parallel distance; hits that are chance fail on the first, short
block. The root is the whole item.

Items are a stated set of queries: they are searched in blocks of bounded size, every block against all documents.

Defined results: null, empty and blank items are not searched; null and empty texts match nothing; equal items match alike, each under its own id; repeated rows give
repeated results; empty tables give empty ones; further columns of documents stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import fresh, quoted


@dataclass(frozen=True)
class Budget:
    """Edits allowed per character of an item, from which length on, and how many characters of items one block may hold."""

    rate: float = 0.1
    min_chars: int = 40
    block_chars: int = 1_000_000


def normalised(text: str | None) -> str:
    return " ".join((text or "").split()).lower()


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def nearest(masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to the pattern, the first such end (Myers 1999)."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    best, end = length, 0
    for k, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = (down | ~(horizontal | up)) & full
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = (minus | ~(vertical | plus)) & full
        down = plus & vertical
        if score < best:
            best, end = score, k
    return best, end


class Item:
    """An item with its pieces and the blocks above each piece."""

    def __init__(self, text: str, rate: float, min_chars: int):
        self.text, self.short = text, len(text) < min_chars
        self.budget = 0 if self.short else int(rate * len(text))
        n = self.budget + 1
        self.cuts = [k * len(text) // n for k in range(n + 1)]
        self.above: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]  # (start, end, budget), small to large
        self._masks: dict[tuple[int, int], dict[str, int]] = {}
        blocks = [(0, n)]
        while blocks:
            a, b = blocks.pop()
            for k in range(a, b):
                self.above[k].insert(0, (self.cuts[a], self.cuts[b], b - a - 1))
            if b - a > 2:
                blocks += [(a, (a + b) // 2), ((a + b) // 2, b)]

    def masks(self, start: int, end: int) -> dict[str, int]:
        if (start, end) not in self._masks:
            self._masks[start, end] = _masks(self.text[start:end])
        return self._masks[start, end]

    def verify(self, piece: int, at: int, text: str) -> tuple[int, int, int] | None:
        """(distance, start, end) of the nearest match around a hit of ``piece`` at ``at``, if within the budget."""
        if self.short:
            end = at + len(self.text)
            cut_left = at > 0 and text[at - 1].isalnum() and self.text[0].isalnum()
            cut_right = end < len(text) and text[end].isalnum() and self.text[-1].isalnum()
            return None if cut_left or cut_right else (0, at, end)
        found = None
        for start, end, budget in self.above[piece]:
            low = max(0, at - (self.cuts[piece] - start) - budget)
            window = text[low:at + (end - self.cuts[piece]) + budget]
            distance, stop = nearest(self.masks(start, end), end - start, window)
            if distance > budget:
                return None
            found = distance, low, low + stop
        distance, low, stop = found
        _, back = nearest(_masks(self.text[::-1]), len(self.text), text[max(0, stop - len(self.text) - distance):stop][::-1])
        return distance, stop - back, stop


@lru_cache(maxsize=4)
def _searcher(texts: tuple[str, ...], rate: float, min_chars: int) -> tuple[list[Item], ahocorasick.Automaton]:
    items = [Item(t, rate, min_chars) for t in texts]
    pieces: dict[str, list[tuple[int, int]]] = {}
    for i, item in enumerate(items):
        for k in range(item.budget + 1):
            pieces.setdefault(item.text[item.cuts[k]:item.cuts[k + 1]], []).append((i, k))
    automaton = ahocorasick.Automaton()
    for piece, uses in pieces.items():
        automaton.add_word(piece, (len(piece), tuple(uses)))
    automaton.make_automaton()
    return items, automaton


def search(text: str, texts: tuple[str, ...], rate: float, min_chars: int = Budget.min_chars) -> dict[int, tuple[int, int, int]]:
    """The best match (distance, start, end) of each item found in a normalised text."""
    items, automaton = _searcher(texts, rate, min_chars)
    best: dict[int, tuple[int, int, int]] = {}
    for last, (length, uses) in automaton.iter(text):
        at = last + 1 - length
        for i, piece in uses:
            if i in best and best[i][0] == 0:
                continue
            if (match := items[i].verify(piece, at, text)) is not None and (i not in best or match < best[i]):
                best[i] = match
    return best


def _matches(texts: tuple[str, ...], ids: tuple[str, ...], budget: Budget):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            found: list[tuple] = []
            for k, raw in enumerate(batch.column(1).to_pylist()):
                for i, (distance, start, end) in sorted(search(normalised((raw or b"").decode("utf-8", "replace")), texts, budget.rate, budget.min_chars).items()):
                    rows.append(k)
                    found.append((ids[i], distance, len(texts[i]), start, end))
            columns = [pa.array([x[k] for x in found], pa.string() if k == 0 else pa.int32()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], ["doc", "item", "distance", "item_chars", "start", "end"])

    return run


def blocks(items: DataFrame, budget: Budget, id: str, text: str) -> Iterator[tuple[tuple[str, ...], tuple[str, ...]]]:
    """(texts, ids) of the items in blocks of at most ``block_chars`` characters, one item at least."""
    texts: list[str] = []
    ids: list[str] = []
    size = 0
    for row in items.select(quoted(id).cast("string").alias("i"), quoted(text).alias("t")).orderBy("i", "t").toLocalIterator():
        plain = normalised(row.t)
        if plain:
            if texts and size + len(plain) > budget.block_chars:
                yield tuple(texts), tuple(ids)
                texts, ids, size = [], [], 0
            texts.append(plain)
            ids.append(row.i)
            size += len(plain)
    if texts:
        yield tuple(texts), tuple(ids)


def find_leaks(docs: DataFrame, items: DataFrame, budget: Budget = Budget(), id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, item, distance, item_chars, start, end): the best match of every item in every document that holds it.

    Places count characters of the normalised text. An item's id comes back with the type it has in ``items``.
    """
    rows = docs.select(quoted(id).alias("doc"), quoted(text).cast("binary").alias("raw"))
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, item string, distance int, item_chars int, start int, end int"
    found = [rows.mapInArrow(_matches(texts, ids, budget), schema) for texts, ids in blocks(items, budget, item_id, item_text)]
    if not found:
        found = [rows.filter(F.lit(False)).mapInArrow(_matches((), (), budget), schema)]
    return reduce(DataFrame.unionAll, found).withColumn("item", F.col("item").cast(items.schema[item_id].dataType))


def remove_leaks(docs: DataFrame, items: DataFrame, budget: Budget = Budget(), text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no item is found, in their own columns. No row moves: a text decides on its own."""
    (name,) = fresh(docs, "leaks")
    clean = docs
    for texts, _ in blocks(items, budget, item_id, item_text):
        held = F.pandas_udf(_holds(texts, budget), "boolean")
        clean = clean.withColumn(name, held(quoted(text).cast("binary"))).filter(~quoted(name)).drop(name)
    return clean.select(*map(quoted, docs.columns))


def _holds(texts: tuple[str, ...], budget: Budget):
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: bool(search(normalised((x or b"").decode("utf-8", "replace")), texts, budget.rate, budget.min_chars))).astype(bool)

    return run
