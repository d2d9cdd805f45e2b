"""Toxicity by compression distance: a text is toxic where a toxic dictionary compresses it better.

Two Zstandard dictionaries are trained, one on ordinary and one on toxic text. Their training samples are the words that
are typical of a kind: those whose beginning is found beside many different neighbours in it, compared with the other kind. (Words of a
passage that is only copied always have the same neighbours, so copies don't count.) A window is compressed once with
the ordinary dictionary alone and once with the toxic one in front of it, so ordinary words cost the same on both sides
and the difference in length is what toxic words save. The differences of a text's windows (largest, mean, mean of the
three largest, shares above two thresholds) are calibrated to a probability by logistic regression.

The classifier is fitted on at most ``fit_rows`` different labelled texts of each kind, chosen by a hash of the
text; copies count once. For the calibration each half of them is scored with dictionaries of the other half; the final ones are trained on
all. Every text is scored as a whole.

Defined results: a null or empty text is one empty window and scores as such; equal texts score alike; labels other
than 0 and 1 are left out; without two different labelled texts of both kinds every score is the share of toxic labels (0
without labels, copies counted); empty tables give empty ones; further columns stay out of the result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import quoted, saved, text_key

THRESHOLDS = (1, 2, 4, 6)
_WORD = re.compile(rb"[^\x00-\x26\x28-\x40\x5b-\x60\x7b-\x7f]+")


@dataclass(frozen=True)
class Fit:
    fit_rows: int = 1500  # labelled texts of each kind, at most
    window: int = 60  # bytes, at least
    level: int = 6
    toxic_bytes: int = 2048
    ordinary_bytes: int = 8192
    least_neighbours: int = 8
    ratio: float = 10.0
    ordinary_words: int = 800


@dataclass(frozen=True)
class Classifier:
    """What the tasks get: two dictionaries, and weights for the standardised differences."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    prior: float
    fit: Fit = field(default_factory=Fit)


def _stems(word: bytes) -> list[bytes]:
    """Beginnings of a word, in several lengths: endings vary."""
    return [word[:k] for k in range(4, min(len(word), 8) + 1)] or [word]


def _neighbours(texts: list[bytes]) -> dict[bytes, int]:
    """How many different (word, word before it) a stem is found in."""
    seen: dict[bytes, set[tuple[bytes, bytes]]] = defaultdict(set)
    for text in texts:
        before = b""
        for word in _WORD.findall(text):
            for stem in _stems(word):
                seen[stem].add((before, word))
            before = word
    return {stem: len(x) for stem, x in seen.items()}


def _samples(texts: list[bytes], stems: set[bytes]) -> list[bytes]:
    picked = ([w for w in _WORD.findall(t) if not stems.isdisjoint(_stems(w))] for t in texts)
    return [b" " + b" ".join(x) + b" " for x in picked if x]


def _trained(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:  # too little to train on
        return b"".join(samples)[-size:]


def dictionaries(ordinary: list[bytes], toxic: list[bytes], fit: Fit) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary from lower-case texts of each kind."""
    t, o = _neighbours(toxic), _neighbours(ordinary)
    t_all, o_all = max(1, sum(map(len, toxic))), max(1, sum(map(len, ordinary)))
    typical = {w for w, n in t.items() if n >= fit.least_neighbours and n / t_all >= fit.ratio * (o.get(w, 0) + 1) / o_all}
    common = sorted((w for w, n in o.items() if n >= fit.least_neighbours and n / o_all >= (t.get(w, 0) + 1) / t_all), key=lambda w: (-o[w], w))
    return _trained(fit.ordinary_bytes, _samples(ordinary, set(common[:fit.ordinary_words]))), _trained(fit.toxic_bytes, _samples(toxic, typical))


@lru_cache(maxsize=2)
def _coders(ordinary: bytes, toxic: bytes, level: int):
    def coder(content: bytes) -> zstandard.ZstdCompressor:
        kind = {"dict_data": zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if len(content) >= 8 else {}
        return zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False, write_dict_id=False, **kind)

    return coder(ordinary), coder(toxic + ordinary)


def cut(text: bytes, size: int) -> Iterator[bytes]:
    """Windows of at least ``size`` bytes that end at a space, so that no word is cut; a text without spaces is cut at twice that."""
    at = 0
    while at < len(text) or at == 0:
        end = text.find(b" ", at + size, at + 2 * size)
        end = min(len(text), at + 2 * size) if end < 0 else end
        yield text[at:end]
        at = max(end, at + 1)


def differences(raw: bytes | None, ordinary: bytes, toxic: bytes, fit: Fit) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window of a text."""
    text = (raw or b"").lower()
    plain, both = _coders(ordinary, toxic, fit.level)
    windows = list(cut(text, fit.window))
    return np.fromiter((len(plain.compress(w)) - len(both.compress(w)) for w in windows), np.float64, len(windows))


def features(saved_bytes: np.ndarray) -> tuple[float, ...]:
    top = np.sort(saved_bytes)[-3:]
    above = [(saved_bytes >= k) for k in THRESHOLDS]
    return (saved_bytes.max(), saved_bytes.mean(), top.mean(), *(x.mean() for x in above), *(np.log1p(x.sum()) for x in above))


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the intercept), centre and scale of a ridge logistic regression, by Newton steps."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def train(labelled: DataFrame, fit: Fit = Fit(), text: str = "text", label: str = "toxic", labels: DataFrame | None = None, id: str = "doc_id") -> Classifier:
    """A classifier from texts and labels 0 and 1. At most ``2 * fit_rows`` different texts come to the driver.

    With ``labels`` the label is in that table and joined by ``id``; only hashes of the texts move to it.
    """
    rows = (labelled.withColumn("raw", quoted(text).cast("binary")).filter(F.col("raw").isNotNull())
            .select(quoted(id if labels is not None else label).alias("own"), "raw", F.xxhash64("raw", F.lit(5)).alias("rank"), text_key(F.col("raw")).alias("key")))
    hashes = rows.select("own", "rank", "key")
    kinds = hashes.withColumnRenamed("own", "y") if labels is None else hashes.join(labels.select(quoted(id).alias("own"), quoted(label).alias("y")), "own")
    # One narrow row for each different text and label; texts follow only for those that are chosen.
    different = saved(kinds.withColumn("y", F.col("y").cast("int")).filter(F.col("y").isin(0, 1)).groupBy("y", "rank", "key").agg(F.count("*").alias("n")))
    chosen = [different.filter(F.col("y") == kind).orderBy("rank", "key").limit(fit.fit_rows).collect() for kind in (0, 1)]
    wanted = different.sparkSession.createDataFrame(sorted({(r["rank"], r["key"]) for x in chosen for r in x}), "rank long, key string")
    texts = {(r["rank"], r["key"]): bytes(r.raw) for r in rows.join(F.broadcast(wanted), ["rank", "key"]).groupBy("rank", "key").agg(F.first("raw").alias("raw")).collect()}
    picked = [[texts[r["rank"], r["key"]] for r in x] for x in chosen]
    n, toxic = len(picked[0]) + len(picked[1]), len(picked[1])
    if min(map(len, picked)) < 2:
        labels = different.agg(F.sum(F.col("n") * F.col("y")).alias("toxic"), F.sum("n").alias("n")).first()
        return Classifier(b"", b"", (), (), (), labels.toxic / labels.n if labels.n else 0.0, fit)
    x, y = [], []
    for half in (0, 1):  # each half is scored by dictionaries of the other
        learnt = dictionaries(*(list(dict.fromkeys(t.lower() for t in p[half::2])) for p in picked), fit)
        for kind, p in enumerate(picked):
            x += [features(differences(t, *learnt, fit)) for t in p[1 - half::2]]
            y += [float(kind)] * len(p[1 - half::2])
    weights, centre, scale = calibrated(np.array(x), np.array(y))
    whole = dictionaries(*(list(dict.fromkeys(t.lower() for t in p)) for p in picked), fit)
    return Classifier(*whole, tuple(weights), tuple(centre), tuple(scale), toxic / n, fit)


def score_text(raw: bytes | None, c: Classifier) -> float:
    if not c.weights:
        return float(c.prior)
    z = (np.array(features(differences(raw, c.ordinary, c.toxic, c.fit))) - c.centre) / np.array(c.scale)
    return float(1 / (1 + np.exp(-np.clip(z @ np.array(c.weights[:-1]) + c.weights[-1], -30, 30))))


def score(docs: DataFrame, classifier: Classifier, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, score) for every document; no row moves."""
    rows = docs.select(quoted(id).alias("doc"), quoted(text).cast("binary").alias("raw"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score_text(x, classifier) for x in batch.column(1).to_pylist()], pa.float64())], ["doc", "score"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, score double")


def remainder(id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as empty text."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % divisor
