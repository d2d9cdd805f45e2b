"""Phrase collocations from count streams in prefix and suffix order.

Only windows of the longest length (shorter ones where a piece ends) are counted. In prefix order all windows that begin
with a phrase stand together, so one pass over the sorted stream counts the phrases of every length by where they begin
and end: no table of phrases is held. The parts of a phrase come from the same counts by merge joins: its head (without the last word) in prefix
order, its tail (without the first) in suffix order; the counts of all first and last words are handed on from length to
length, and a phrase hands its own count back to its head and tail, which is the count of their extension.

* A task sorts the windows of a stretch of text, counts equal ones, and packs them for the stretch of the order that
  *splitters* assign them to, only with the words that differ from the window before. Splitters come from a bounded
  sample; they decide where windows go and never what is counted.
* A stretch of the order merges its packs and counts in one pass. Phrases that reach over its ends are counted in part on
  both sides and summed afterwards, so a word at the head of a third of all windows is no hot key.
* Only phrases that reach ``min_count`` are joined.

Counts are of bytes of UTF-8. Defined results: a null or empty text has no words; a null language is ``und``; repeated rows
count each; ties are ordered by the phrase; an empty table gives an empty one; further columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import quoted, saved

SPLIT, BLANK, INSIDE = 0, 1, 2
KIND = np.full(256, INSIDE, np.uint8)
KIND[[*b".,;:!?\n\x0b\x0c\r"]] = SPLIT
KIND[[*b" \t"]] = BLANK
_BETWEEN, _WORD = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]"), re.compile(rb"[^ \t.,;:!?\n\x0b\x0c\r]+")


@dataclass(frozen=True)
class Mining:
    """Longest phrase, least count, phrases returned for each language; bytes of text sorted at once and merged in one
    stretch; the sample for splitters: texts and windows for each stretch."""

    longest: int = 5
    min_count: int = 100
    top: int = 2000
    chunk_bytes: int = 8 << 20
    stretch_bytes: int = 8 << 20
    sample_texts: int = 8
    sample_windows: int = 64


# -- windows of a stretch of text --


def words_of(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of lower-cased text, each with one space at its end, the number of the piece each is in, and where it starts."""
    raw = np.frombuffer(data.lower() + b"\n", np.uint8)  # of bytes: A-Z only
    kind = KIND[raw]
    inside = kind == INSIDE
    ends = np.zeros(len(raw), bool)
    ends[1:] = ~inside[1:] & inside[:-1]
    keep = inside | ends
    text = np.where(inside, raw, np.uint8(32))[keep]
    offsets = np.concatenate([[0], np.flatnonzero(ends[keep]) + 1]).astype(np.int32)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    pieces = np.cumsum(kind == SPLIT)[starts]
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(text)]), pieces, np.flatnonzero(starts)


def ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in order, and each word's rank from 1."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def sorted_windows(ids: np.ndarray, counts: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a matrix of ranks (0: no word) in order, and their summed counts."""
    bits, keys, width = max(n_ids, 1).bit_length(), [], ids.shape[1]
    per = max(1, 63 // bits)
    for a in range(0, width, per):
        key = np.zeros(len(ids), np.int64)
        for c in range(a, min(a + per, width)):
            key = (key << bits) | ids[:, c]
        keys.append(key)
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(ids), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return ids[order[first]], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def windows(data: bytes, longest: int, end: int | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct windows at all words that start before ``end``: vocabulary in order, ranks of the words (0 past the piece), counts."""
    words, pieces, starts = words_of(data)
    vocabulary, rank = ranked(words)
    ids = np.zeros((len(rank), longest), np.int64)
    for c in range(longest):
        n = max(0, len(rank) - c)
        ids[:n, c] = np.where(pieces[c:] == pieces[:n], rank[c:], 0)
    ids = ids[:np.searchsorted(starts, len(data) if end is None else end)]
    return (vocabulary, *sorted_windows(ids, np.ones(len(ids), np.int64), len(vocabulary)))


def shared_words(ids: np.ndarray) -> np.ndarray:
    """How many leading words each row shares with the row before."""
    same = np.zeros(ids.shape, bool)
    same[1:] = ids[1:] == ids[:-1]
    return np.cumprod(same, axis=1).sum(axis=1)


# -- packs: what a stretch of text sends to a stretch of the order --


def pack(vocabulary: pa.Array, ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted windows as: number, shared words, lengths, counts, and the words that are not shared."""
    shared, length = shared_words(ids), (ids > 0).sum(axis=1)
    shared = np.minimum(shared, length)
    column = np.arange(ids.shape[1])
    written = ids[(column >= shared[:, None]) & (column < length[:, None])]
    words = vocabulary.take(pa.array(written - 1))
    start, end = np.frombuffer(words.buffers()[1], np.int32)[[words.offset, words.offset + len(words)]] if len(words) else (0, 0)
    text = words.buffers()[2].to_pybytes()[start:end] if end > start else b""
    small = counts < 255
    body = b"".join([np.int32(len(ids)).tobytes(), (shared << 4 | length).astype(np.uint8).tobytes(), np.where(small, counts, 255).astype(np.uint8).tobytes(),
                     counts[~small].astype(np.int64).tobytes(), text])
    return b"z" + zstandard.compress(body, 1) if len(body) > 256 else b"r" + body


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Shared words, lengths, counts and text of a pack."""
    body = zstandard.decompress(blob[1:]) if blob[:1] == b"z" else blob[1:]
    n = int(np.frombuffer(body[:4], np.int32)[0])
    both, counts = np.frombuffer(body[4:4 + n], np.uint8), np.frombuffer(body[4 + n:4 + 2 * n], np.uint8).astype(np.int64)
    large = int((counts == 255).sum())
    counts[counts == 255] = np.frombuffer(body[4 + 2 * n:4 + 2 * n + 8 * large], np.int64)
    return both >> 4, both & 15, counts, body[4 + 2 * n + 8 * large:]


def merged(blobs: Iterable[bytes], longest: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The windows of all packs in one order: vocabulary, ranks, counts."""
    parts = [unpack(x) for x in blobs]
    shared, length, counts = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(3))
    text = b"".join(p[3] for p in parts)
    offsets = np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(text)])
    vocabulary, rank = ranked(words)
    column, rows = np.arange(longest), np.arange(len(length))
    ids = np.zeros((len(length), longest), np.int64)
    ids[(column >= shared[:, None]) & (column < length[:, None])] = rank
    for c in range(longest):  # a shared word is the last one written in its column (packs begin with nothing shared)
        source = np.maximum.accumulate(np.where(shared <= c, rows, 0))
        ids[:, c] = np.where(length > c, ids[source, c], 0)
    return (vocabulary, *sorted_windows(ids, counts, len(vocabulary)))


def phrases(vocabulary: pa.Array, ids: np.ndarray, counts: np.ndarray, least: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Phrases of all lengths in a sorted stream: text, length and count. Those at either end may go on elsewhere and come with any count."""
    if not len(ids):
        return pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    shared, sums = shared_words(ids), np.concatenate([[0], np.cumsum(counts)])
    texts, lengths, totals = [], [], []
    for m in range(1, ids.shape[1] + 1):
        begins = np.flatnonzero((shared < m) | (np.arange(len(ids)) == 0))
        total = sums[np.append(begins[1:], len(ids))] - sums[begins]
        open_ = np.zeros(len(begins), bool)
        open_[[0, -1]] = True
        take = (ids[begins, m - 1] > 0) & ((total >= least) | open_)
        rows = ids[begins[take], :m]
        words = [vocabulary.take(pa.array(rows[:, c] - 1)) for c in range(m)]
        texts.append(pc.binary_join_element_wise(*words, pa.scalar(b"", pa.binary())) if m > 1 else words[0])
        lengths.append(np.full(len(rows), m))
        totals.append(total[take])
    return pa.concat_arrays(texts), np.concatenate(lengths), np.concatenate(totals)


# -- tasks --


def parts(text: bytes, limit: int, longest: int) -> Iterator[tuple[bytes, int]]:
    """A long text in parts of about ``limit`` bytes: (bytes, end). Windows begin before ``end``; what follows is only read on into."""
    start = 0
    while len(text) - start > limit:
        cut = _BETWEEN.search(text, start + limit)
        if cut is None:
            break
        end = cut.end()
        for k, word in enumerate(_WORD.finditer(text, end), 2):
            end = word.end()
            if k >= longest:
                break
        yield text[start:end], cut.end() - start
        start = cut.end()
    yield text[start:], len(text) - start


def stretches(batches: Iterable[pa.RecordBatch], limit: int, longest: int) -> Iterator[tuple[str, bytes, int]]:
    """Texts by language, put end to end up to about ``limit`` bytes, longer ones in parts: (language, bytes, end)."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["raw"].to_pylist()):
            if text and len(text) > limit:
                yield from ((lang, *part) for part in parts(text, limit, longest))
            elif text:
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= limit or sum(sizes.values()) >= 2 * limit:
                    largest = max(sizes, key=sizes.get)
                    data = b"\n".join(held.pop(largest))
                    del sizes[largest]
                    yield largest, data, len(data)
    for lang, texts in held.items():
        data = b"\n".join(texts)
        yield lang, data, len(data)


def _packed(splitters: dict[str, list[bytes]], mining: Mining):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data, end in stretches(batches, mining.chunk_bytes, mining.longest):
            vocabulary, ids, counts = windows(data, mining.longest, end)
            if not len(ids):
                continue
            cuts = [0, *(place(vocabulary, ids, x) for x in splitters.get(lang, [])), len(ids)]
            found = [(k, pack(vocabulary, ids[a:b], counts[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())],
                                             ["lang", "stretch", "pack"])

    return run


def place(vocabulary: pa.Array, ids: np.ndarray, splitter: bytes) -> int:
    """The first row of sorted windows that is not below the splitter (words, each with a space at its end)."""
    low, high = 0, len(ids)
    for c, word in enumerate(splitter.split(b" ")[:-1][:ids.shape[1]]):
        at = _rank(vocabulary, word + b" ")
        column = ids[low:high, c]
        start = low + int(np.searchsorted(column, at, "left"))
        if at != int(at):
            return start
        low, high = start, low + int(np.searchsorted(column, at, "right"))
    return low


def _rank(vocabulary: pa.Array, word: bytes) -> float:
    """Rank of a word from 1; half way between two ranks if it is not there."""
    low, high = 0, len(vocabulary)
    while low < high:
        mid = (low + high) // 2
        here = vocabulary[mid].as_py()
        if here == word:
            return mid + 1
        low, high = (mid + 1, high) if here < word else (low, mid)
    return low + 0.5


def _counted(mining: Mining):
    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        vocabulary, ids, counts = merged(part["pack"].to_pylist(), mining.longest)
        text, length, total = phrases(vocabulary, ids, counts, mining.min_count)
        text = pa.concat_arrays([pc.binary_slice(text, 0, -1), pa.array([b""], pa.binary())]).cast(pa.string())
        length, total = np.append(length, 0), np.append(total, counts.sum())  # the empty phrase: all words of the language
        return pa.table({"lang": pa.array([key[0].as_py()] * len(text), pa.string()), "phrase": text, "length": pa.array(length, pa.int32()), "f": pa.array(total, pa.int64())})

    return run


def _sampled(mining: Mining):
    """Windows at even distances in each text, more in a text that is long beside a stretch."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, keys = [], []
            for lang, text in zip(batch["lang"].to_pylist(), batch["raw"].to_pylist()):
                n = mining.sample_windows // mining.sample_texts + len(text) * mining.sample_windows // mining.stretch_bytes
                for k in range(n):
                    part = text[len(text) * k // n:][:1024]
                    words, pieces, _ = words_of(part)
                    window = [w for w, p in zip(words.to_pylist()[1:1 + mining.longest], pieces[1:]) if p == pieces[1]]
                    if window:
                        langs.append(lang)
                        keys.append(b"".join(window))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.binary())], ["lang", "key"])

    return run


# -- jobs --


def splitters_of(rows: DataFrame, mining: Mining) -> dict[str, list[bytes]]:
    """Where the order of each language is cut. A text is in the sample with a probability in proportion to its bytes.

    The driver gets some windows for each stretch, as it does when Spark sorts by range.
    """
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("raw")).cast("long").alias("bytes"))
    size = {r["lang"]: r["bytes"] for r in sizes.filter(F.col("bytes") > mining.stretch_bytes).collect()}
    if not size:
        return {}
    drawn = F.col("lang").isin(*size) & (F.rand(11) < F.octet_length("raw") * (mining.sample_texts / mining.stretch_bytes))
    sample = rows.filter(drawn).mapInArrow(_sampled(mining), "lang string, key binary")
    picked = sample.groupBy("lang", "key").agg(F.count("*").alias("n")).orderBy("lang", "key").toArrow()
    found = {}
    for lang, n_bytes in size.items():
        mine = picked.filter(pc.equal(picked["lang"], lang))
        keys, sums, n = mine["key"].to_pylist(), np.cumsum(mine["n"].to_numpy()), -(-n_bytes // mining.stretch_bytes)
        if keys:
            places = np.searchsorted(sums, np.arange(1, n) * (sums[-1] / n))
            found[lang] = [keys[k] for k in sorted(set(np.minimum(places, len(keys) - 1).tolist()))]
    return found


def count_phrases(docs: DataFrame, mining: Mining = Mining(), lang: str = "lang", text: str = "text") -> DataFrame:
    """Phrases of 1 to ``longest`` words with at least ``min_count`` occurrences: lang, phrase, length, f; and for each
    language the empty phrase of length 0 with the number of its words."""
    rows = docs.select(F.coalesce(quoted(lang).cast("string"), F.lit("und")).alias("lang"), quoted(text).cast("binary").alias("raw"))
    packs = rows.mapInArrow(_packed(splitters_of(rows, mining), mining), "lang string, stretch long, pack binary")
    parts = packs.groupBy("lang", "stretch").applyInArrow(_counted(mining), "lang string, phrase string, length int, f long")
    return saved(parts.groupBy("lang", "phrase", "length").agg(F.sum("f").alias("f")).filter((F.col("f") >= mining.min_count) | (F.col("length") == 0)))


def joined_counts(counts: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """Phrases of two words and more with ``lefts`` and ``rights`` (counts of the first and of the last 1, 2, ... words) and
    ``extended``, the largest count of a phrase that is longer by one word."""
    longer, found = None, []
    level = counts.filter("length = 1").select("lang", "phrase", "f", F.array("f").alias("firsts"), F.array("f").alias("lasts"))
    for m in range(2, mining.longest + 1):
        own = counts.filter(F.col("length") == m).select("lang", "phrase", "f", F.regexp_replace("phrase", " [^ ]*$", "").alias("head"),
                                                         F.regexp_replace("phrase", "^[^ ]* ", "").alias("tail"))
        heads = level.select("lang", F.col("phrase").alias("head"), F.col("firsts").alias("lefts"))
        tails = level.select("lang", F.col("phrase").alias("tail"), F.col("lasts").alias("rights"))
        level = saved(own.join(heads.hint("merge"), ["lang", "head"]).join(tails.hint("merge"), ["lang", "tail"]))
        found.append(level)
        level = level.withColumn("firsts", F.concat("lefts", F.array("f"))).withColumn("lasts", F.concat("rights", F.array("f")))
    rows = None
    for k, level in enumerate(found):
        if k + 1 < len(found):
            longer = found[k + 1].select("lang", "f", F.explode(F.array("head", "tail")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("extended"))
            level = level.join(longer.hint("merge"), ["lang", "phrase"], "left")
        else:
            level = level.withColumn("extended", F.lit(None).cast("long"))
        level = level.select("lang", "phrase", "f", "lefts", "rights", "extended")
        rows = level if rows is None else rows.unionByName(level)
    return rows


def scored(rows: DataFrame) -> DataFrame:
    """Phrases with a, l and r of the cut that scores lowest (the first of these), n and score."""
    # Exact: products of counts have up to 38 digits as decimals.
    score = "CAST(CAST(f AS DECIMAL(18,0)) * CAST(n AS DECIMAL(18,0)) * 1000BD div (CAST(c.l AS DECIMAL(18,0)) * CAST(c.r AS DECIMAL(18,0))) AS LONG)"
    # The cut after k words: the first k, and what is left, the last length - k.
    cuts = f"transform(zip_with(lefts, reverse(rights), (l, r) -> struct(l, r)), (c, k) -> struct({score} AS score, k, c.l AS l, c.r AS r))"
    return rows.withColumn("cut", F.array_min(F.expr(cuts))).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def mine(docs: DataFrame, mining: Mining = Mining(), lang: str = "lang", text: str = "text") -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = count_phrases(docs, mining, lang, text)
    totals = counts.filter("length = 0").select("lang", F.col("f").alias("n"))
    best = scored(joined_counts(counts, mining).filter("extended IS NULL OR extended < f").join(totals, "lang"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= mining.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
