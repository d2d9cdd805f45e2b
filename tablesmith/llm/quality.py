"""Quality rules: measures of each text, and lines that too many documents of a host repeat.

Lines are normalised (lower case, digits to 0, white space collapsed) and hashed; for each host the distinct documents
that hold a line are counted. Texts that are equal as wholes count once, so that copies of a document are left to
deduplication and don't make its lines look like boilerplate. Lines above the host's limit are removed, and a document
of which too little is left is rejected.

Defined results: a null or empty text has no words and fails the base rules; documents without a host form a host of
their own; lines without a word are never removed; repeated rows are measured alike and count once; an empty table gives
an empty one; further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import fresh, n_words, quoted, saved, text_key

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "


@dataclass(frozen=True)
class Rules:
    """Limits. A line is boilerplate in more than both ``line_docs`` documents and ``line_share`` of a host's documents."""

    min_words: int = 50
    repeat_percent: int = 50
    line_docs: int = 20
    line_share: float = 0.05
    left_share: float = 0.3


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) > len(words) - 2 and len(number) == len(words):
        return 0
    _, pairs = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)
    _, windows, counts = np.unique(pairs * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[windows] >= 2
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(words) - 2 + k] |= twice
    return int(covered.sum())


def measure(raw: bytes | None) -> tuple[int, int, int, int, int]:
    """The five measures of one text, given as UTF-8 bytes."""
    text = (raw or b"").decode("utf-8", "replace")
    words = (raw or b"").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(x) for x in batch.column(batch.schema.get_field_index("raw")).to_pylist()]
        columns = [batch.column(k) for k, name in enumerate(batch.schema.names) if name != "raw"]
        names = [name for name in batch.schema.names if name != "raw"]
        for k, name in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")):
            columns.append(pa.array([x[k] for x in found], pa.int64()))
            names.append(name)
        yield pa.RecordBatch.from_arrays(columns, names)


def host_key(host: Column) -> Column:
    return F.xxhash64(host.cast("string"), host.isNull())


def line_key(line: Column) -> Column:
    """Hash of a normalised line; null for a line without a word."""
    plain = F.trim(F.regexp_replace(F.translate(F.lower(line), "123456789", "000000000"), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain != "", F.xxhash64(plain))


def measured(docs: DataFrame, id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """One saved row per document: its id, keys of host and text, the measures, and its lines as (key, words), once each.

    Texts are read once here; everything after works on these narrow rows.
    """
    lines = F.transform(F.split(quoted(text), "\n"), lambda x: F.struct(line_key(x).alias("line"), n_words(x).alias("words")))
    rows = docs.select(quoted(id).alias("doc"), host_key(quoted(host)).alias("host"), text_key(quoted(text)).alias("text"),
                       F.coalesce(F.filter(lines, lambda x: x["line"].isNotNull()), F.array().cast("array<struct<line:long,words:long>>")).alias("lines"),
                       quoted(text).cast("binary").alias("raw"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "raw")
    return saved(rows.mapInArrow(_measured, f"{kept}, {MEASURES}").withColumn("row", F.monotonically_increasing_id()))


def boilerplate(rows: DataFrame, rules: Rules) -> DataFrame:
    """(host, line) of the lines that more distinct documents of the host hold than its limit allows."""
    texts = rows.groupBy("host", "text").agg(F.first("lines").alias("lines"))
    hosts = rows.select("host", "text").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    found = (texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
             .groupBy("host", "line").agg(F.count("*").alias("holders")).filter(F.col("holders") > rules.line_docs))
    limit = F.col("docs") * F.lit(rules.line_share)
    return found.join(hosts, "host").filter(F.col("holders") > limit).select("host", "line")


def judged(rows: DataFrame, rules: Rules) -> DataFrame:
    """``measured`` rows with base_failed, the words and lines that removal takes, and kept."""
    bad = saved(boilerplate(rows, rules))
    hit = (rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.words")
           .join(bad, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("words_removed"), F.collect_set("line").alias("bad_lines")))
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.repeat_percent)
    removed = F.coalesce("words_removed", F.lit(0).cast("long"))
    return (rows.join(hit, "row", "left").withColumn("words_removed", removed).withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (F.col("n_words") - removed >= F.col("n_words") * F.lit(rules.left_share))))


def score_documents(docs: DataFrame, rules: Rules = Rules(), id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Measures and verdict, one row per document: doc, the measures, words_removed, base_failed, kept."""
    rows = judged(measured(docs, id, host, text), rules)
    return rows.select("doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_removed", "base_failed", "kept")


def filter_documents(docs: DataFrame, rules: Rules = Rules(), id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """The documents kept, in their own columns, without the lines above the limits.

    Rejected texts and lines are looked up by (host, text), so repeated rows share them. Only texts that lose something
    are in that list; ``docs`` moves just once, and only if the list is too long to be sent to it.
    """
    host_name, key_name, lines_name, kept_name = fresh(docs, "host_key", "text_key", "bad_lines", "kept_here")
    verdicts = (judged(measured(docs, id, host, text), rules).filter(~F.col("kept") | (F.col("words_removed") > 0))
                .groupBy("host", "text").agg(F.first("bad_lines").alias(lines_name), F.first("kept").alias(kept_name))
                .withColumnRenamed("host", host_name).withColumnRenamed("text", key_name))
    joined = (docs.withColumn(host_name, host_key(quoted(host))).withColumn(key_name, text_key(quoted(text)))
              .join(verdicts, [host_name, key_name], "left").filter(F.coalesce(quoted(kept_name), F.lit(True))))
    left = F.array_join(F.filter(F.split(quoted(text), "\n"), lambda x: ~F.coalesce(F.array_contains(quoted(lines_name), line_key(x)), F.lit(False))), "\n")
    return joined.withColumn(text, F.when(quoted(lines_name).isNull(), quoted(text)).otherwise(left)).select(*map(quoted, docs.columns))
