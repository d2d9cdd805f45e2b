"""Language identification of mixed-language text.

Every word gets a score for each language: the sum of log-likelihoods of its byte trigrams (with the word's ends) in
that language, relative to the mean over languages. The script of a word (by the range of its first letter; marks and symbols before it
don't count) leaves only the languages that use it. The best labelling of a text's words, with a penalty for every switch of language, is found by the Viterbi
algorithm and gives its spans. Where no run of words could pay for a switch away from the best single language (a bound
taken from running sums, exact), the text is one span and the step-by-step pass is left out.

A model is fitted on at most about ``fit_rows`` different labelled texts per language, chosen by a hash of the text; copies
count once.

Defined results: a null text or one without a letter is ``und`` with score 0; words without a letter take no side; equal
texts get equal results; a tie goes to the first language by name; without labelled texts everything is ``und``; empty
tables give empty ones; further columns stay out of the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import byte_column, quoted, text_key

BUCKETS = 1 << 16
_SPACES = [9, 10, 11, 12, 13, 32]

#: Scripts by ranges of code points; letters outside them are 'other'.
SCRIPTS = [("latin", 0x41, 0x2AF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("indic", 0x780, 0xDFF),
           ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("east_asian", 0x2E80, 0x312F), ("hangul", 0x3130, 0x318F), ("east_asian", 0x3190, 0x9FFF),
           ("hangul", 0xA960, 0xA97F), ("hangul", 0xAC00, 0xD7FF), ("east_asian", 0xF900, 0xFAFF), ("latin", 0xFF21, 0xFF5A), ("east_asian", 0xFF66, 0xFF9F), ("east_asian", 0x20000, 0x3FFFF)]
NAMES = ["none", *dict.fromkeys(name for name, _, _ in SCRIPTS), "other"]


def _script_table() -> np.ndarray:
    """The script of every code point, 0 for what is no letter."""
    table = np.fromiter((NAMES.index("other") if chr(k).isalpha() else 0 for k in range(0x110000)), np.int8, 0x110000)
    for name, low, high in SCRIPTS:
        part = table[low:high + 1]
        part[part > 0] = NAMES.index(name)
    return table


_SCRIPT = _script_table()
_SPACE = np.zeros(256, bool)
_SPACE[_SPACES] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER[_SPACES] = 32
_LETTERS = (_SCRIPT[:256] > 0) | (np.arange(256) >= 0x80)


@dataclass(frozen=True)
class Settings:
    fit_rows: int = 1000  # different labelled texts of each language, about
    switch: float = 15.0
    smoothing: float = 0.5
    script_share: float = 0.001  # a language uses a script that has this share of its words


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    tables: np.ndarray  # (BUCKETS, languages): trigram log-likelihoods less their mean
    allowed: np.ndarray  # (scripts, languages)
    settings: Settings


def trigrams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each byte (-1 where it isn't a letter's), where words start, and each byte's class."""
    plain = _LOWER[data]
    before, after = np.full(len(plain), 32, np.uint8), np.full(len(plain), 32, np.uint8)
    before[1:], after[:-1] = plain[:-1], plain[1:]
    inner = starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(plain))]
    before[inner], after[inner - 1] = 32, 32
    code = (before.astype(np.uint64) << np.uint64(16)) | (plain.astype(np.uint64) << np.uint64(8)) | after
    bucket = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    inside = ~_SPACE[data]
    return np.where(_LETTERS[data], bucket, -1), np.flatnonzero(inside & _SPACE[before]), inside


def byte_scripts(data: np.ndarray) -> np.ndarray:
    """The script of the letter that starts at each byte of UTF-8 text, else 0."""
    scripts = np.where(data < 0x80, _SCRIPT[data], np.int8(0))
    lead = np.flatnonzero(data >= 0xC0)
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    code = data[lead].astype(np.int64) & (0xFF >> (size + 1))
    for k in (1, 2, 3):
        code = np.where(size > k, (code << 6) | (data[np.minimum(lead + k, len(data) - 1)] & 0x3F), code)
    scripts[lead] = _SCRIPT[np.minimum(code, 0x10FFFF)]
    return scripts


def word_scripts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The script of each word's first letter; none for words without a letter."""
    scripts = byte_scripts(data)
    letter = np.flatnonzero(scripts > 0)
    if not len(at) or not len(letter):
        return np.zeros(len(at), np.int64)
    first = letter[np.minimum(np.searchsorted(letter, at), len(letter) - 1)]
    end = np.append(at[1:], len(data))
    return np.where((first >= at) & (first < end), scripts[first], 0)


def _counts(languages: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS + len(NAMES)), np.int64)
        for batch in batches:
            data, starts = byte_column(batch, "raw")
            lang = np.array([languages.index(x) for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()], np.int64)
            if not len(data):
                continue
            bucket, at, _ = trigrams(data, starts)
            owner = np.repeat(lang, np.diff(starts))
            scripts = word_scripts(data, at)
            for k in range(len(languages)):
                mine = bucket[(owner == k) & (bucket >= 0)]
                total[k, :BUCKETS] += np.bincount(mine, minlength=BUCKETS)
                total[k, BUCKETS:] += np.bincount(scripts[owner[at] == k], minlength=len(NAMES))
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(total[k, b])], ["lang", "bucket", "n"])

    return run


def train(labelled: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> Model:
    """A model from texts and languages. The driver gets one count per language and bucket, at most."""
    rows = labelled.filter(quoted(lang).isNotNull() & quoted(text).isNotNull()).select(quoted(lang).cast("string").alias("lang"), quoted(text).cast("binary").alias("raw"))
    sizes = {r.lang: r.n for r in rows.select("lang", text_key(F.col("raw")).alias("key")).distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros((len(NAMES), 0), bool), settings)
    share = F.coalesce(*(F.when(F.col("lang") == x, F.lit(min(1.0, settings.fit_rows / sizes[x]))) for x in languages))
    picked = rows.filter(F.pmod(F.xxhash64("raw"), F.lit(1_000_000)) < share * 1_000_000)
    picked = picked.groupBy("lang", text_key(F.col("raw")).alias("key")).agg(F.first("raw").alias("raw")).drop("key")
    counted = picked.mapInArrow(_counts(languages), "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), BUCKETS + len(NAMES)))
    counts[counted["lang"].to_numpy(np.int64), counted["bucket"].to_numpy(np.int64)] = counted["n"].to_numpy(float)
    grams, scripts = counts[:, :BUCKETS].T, counts[:, BUCKETS:].T
    tables = np.log((grams + settings.smoothing) / (grams.sum(axis=0) + settings.smoothing * BUCKETS))
    allowed = scripts > settings.script_share * np.maximum(1, scripts.sum(axis=0))
    allowed[0] = True
    allowed[~allowed.any(axis=1)] = True
    return Model(tuple(languages), (tables - tables.mean(axis=1, keepdims=True)).astype(np.float32), allowed, settings)


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word (rows of ``scores``), with a penalty for every switch."""
    n, k = scores.shape
    totals = scores.sum(axis=0)
    best = int(np.argmax(totals))
    if n == 0 or k == 1:
        return np.full(n, best)
    # Leaving the best language for a stretch gains no more than the largest running sum of what the others offer over it,
    # and costs at least one switch.
    gain = np.concatenate([[0.0], np.cumsum(np.delete(scores, best, axis=1).max(axis=1) - scores[:, best])])
    if (gain - np.minimum.accumulate(gain)).max() <= switch:
        return np.full(n, best)
    value = scores[0].tolist()
    came: list[list[int]] = []
    for row in scores[1:].tolist():
        top = max(range(k), key=value.__getitem__)
        cost = value[top] - switch
        back = [j if value[j] >= cost else top for j in range(k)]
        value = [row[j] + (value[j] if value[j] >= cost else cost) for j in range(k)]
        came.append(back)
    path = [max(range(k), key=value.__getitem__)]
    for back in reversed(came):
        path.append(back[path[-1]])
    return np.array(path[::-1])


def _label(model: Model, with_spans: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = byte_column(batch, "raw")
            n, k = batch.num_rows, len(model.languages)
            names, scores, spans = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
            if len(data) and k:
                bucket, at, _ = trigrams(data, starts)
                table = np.vstack([model.tables, np.zeros((1, k), np.float32)])  # the last row, -1, is for bytes that say nothing
                words = np.add.reduceat(table[bucket], at, axis=0).astype(np.float64) if len(at) else np.zeros((0, k))
                scripts = word_scripts(data, at)
                words = np.where(model.allowed[scripts], words, np.minimum(words, 0) - 2 * model.settings.switch)
                words[scripts == 0] = 0
                bounds = np.searchsorted(at, starts)
                for d in range(n):
                    own = slice(bounds[d], bounds[d + 1])
                    lettered = scripts[own] > 0
                    if not lettered.any():
                        continue
                    path = viterbi(words[own], model.settings.switch)
                    share = np.bincount(path[lettered], minlength=k)
                    best = int(np.argmax(share))
                    totals = words[own][path == best].sum(axis=0)
                    lead = totals[best] - np.delete(totals, best).max() if k > 1 else 30.0
                    names[d] = model.languages[best]
                    scores[d] = share[best] / max(1, share.sum()) / (1 + np.exp(-np.clip(lead, -30, 30)))
                    if with_spans:
                        cuts = np.flatnonzero(np.diff(path)) + 1
                        spans[d] = [{"start": int(a), "end": int(b), "lang": model.languages[path[a]]} for a, b in zip([0, *cuts], [*cuts, len(path)])]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores), pa.array(spans, kind)], ["doc", "lang_pred", "score", "spans"])

    return run


def identify(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """(doc, lang_pred, score, spans): spans are runs of words, start to end (exclusive), with their language; no row moves.

    ``lang_pred`` has the most words with a letter; ``score`` is their share times the odds over the next language there.
    """
    rows = docs.select(quoted(id).alias("doc"), quoted(text).cast("binary").alias("raw"))
    return rows.mapInArrow(_label(model, spans), f"doc {rows.schema['doc'].dataType.simpleString()}, lang_pred string, score double, "
                                                 "spans array<struct<start:int,end:int,lang:string>>")
