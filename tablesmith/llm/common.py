"""Small helpers shared by the text operators."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.session import saved, tune

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each application."""
    if spark.sparkContext.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp(prefix="ship-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tablesmith", "zip", root, "tablesmith"))
        _shipped.add(spark.sparkContext.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of the library, with batches short enough for very long texts."""
    tune(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "1024")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of ``df`` (in any case) has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def text_key(text: Column) -> Column:
    """128 bits that stand for a whole text; null has a key of its own."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def by_row(batches: Iterable[pa.RecordBatch], schema: pa.Schema, work) -> Iterator[pa.RecordBatch]:
    """``work(columns as a dict of lists) -> dict of lists`` for every batch that has rows."""
    for batch in batches:
        if batch.num_rows:
            out = work({name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def byte_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and where each row starts (nulls are empty)."""
    column = batch.column(batch.schema.get_field_index(name)).fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in the open interval (0, 1) from 64 mixed bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts laid end to end, and the text each word is in.

    A word's hash is a polynomial over its bytes, taken from running sums, so no word is touched on its own.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < n)]
    begins[edges] = inside[edges]  # a text's first word starts anew even where the text before ends in a word
    at = np.flatnonzero(begins)
    if len(at) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Within a word, position k weighs BASE^(k+1) mod 2^64.
    position = np.zeros(n, np.int64)
    position[at[0]:] = np.arange(at[0], n) - np.repeat(at, np.diff(np.append(at, n)))
    longest = int(position[inside].max()) + 1
    powers = np.cumprod(np.full(min(longest, n), _BASE, np.uint64))
    terms = np.where(inside, (data.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(position, longest - 1)], np.uint64(0))
    return mix64(np.add.reduceat(terms, at)), np.searchsorted(starts, at, side="right") - 1


__all__ = ["SHINGLE_WORDS", "WORD", "by_row", "byte_column", "fresh", "mix64", "n_words", "prepare", "quoted", "saved", "table", "text_key", "unit",
           "word_hashes"]
