"""Token counts of flat token files, found by their separators.

A token file is nothing but token ids, little-endian and of fixed width, with a separator after each document: no header
and no index. ``count_tokens`` reads files in blocks of fixed size, each block in a task of its own. A block is one
vectorised search for the separator; it reports its separators, which need not respect its edges. A prefix scan over
the blocks of a file (how many separators came before, and where the last one was) stitches documents across edges.

``write_tokens`` makes such files from documents with a public vocabulary. It also returns which document went where,
as a table beside the files; the counting doesn't look at it.

Defined results: a null or empty text is a document without tokens; the separator's id can't come from a text, since
vocabularies keep it for the purpose; a file that doesn't end in a separator ends in an unfinished document, which is
counted; an empty file has none; a length that isn't a multiple of the width is an error; repeated rows are documents
of their own; empty tables give no files; further columns stay out of the files.
"""

from __future__ import annotations

import base64
import importlib.util
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import quoted, saved
from tablesmith.session import shared_folder

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SEPARATOR = 50256
WIDTH = 2
BLOCK_TOKENS = 1 << 21


@lru_cache(maxsize=2)
def encoding(folder: str, vocabulary: str) -> tiktoken.Encoding:
    """A public vocabulary of ranks; its split pattern comes with the files."""
    spec = importlib.util.spec_from_file_location("vocabulary_files", f"{folder}/__init__.py")
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    with open(f"{folder}/{vocabulary}", "rb") as source:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source)}
    return tiktoken.Encoding(vocabulary, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, folder: str, id: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY,
                 separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """Write token files, one for each partition, and return (file, ordinal, doc): the document at each place."""
    rows = docs.select(quoted(id).alias("doc"), quoted(text).alias("text"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sink, n = encoding(tokenizers, vocabulary), None, 0
        files, path = pafs.FileSystem.from_uri(folder)
        name, attempt = f"part-{TaskContext.get().partitionId():06d}.tok", f"{path}/_{uuid.uuid4().hex}"
        for batch in batches:
            if sink is None:
                sink = files.open_output_stream(attempt)
            for text in batch.column(1).to_pylist():
                ids = coder.encode_ordinary(text) if text else []
                sink.write(np.array([*ids, separator], f"<u{width}").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows, pa.string()), pa.array(range(n, n + batch.num_rows), pa.int64()), batch.column(0)],
                                             ["file", "ordinal", "doc"])
            n += batch.num_rows
        if sink is not None:
            sink.close()
            files.move(attempt, f"{path}/{name}")

    files, path = pafs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    return saved(rows.mapInArrow(write, f"file string, ordinal long, doc {rows.schema['doc'].dataType.simpleString()}"))


def _separators(folder: str, separator: int, width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                with files.open_input_file(f"{path}/{name}") as source:
                    source.seek(start * width)
                    found = np.flatnonzero(np.frombuffer(source.read(size * width), f"<u{width}") == separator) + start
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([found], pa.list_(pa.int64()))],
                                                 ["file", "start", "size", "found"])

    return run


def count_tokens(spark: SparkSession, folder: str, separator: int = SEPARATOR, width: int = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in every token file of a folder; ``start`` counts tokens."""
    files, path = pafs.FileSystem.from_uri(folder)
    listed = [(x.base_name, x.size) for x in files.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith(".tok")]
    if odd := [name for name, size in listed if size % width]:
        raise ValueError(f"length isn't a multiple of {width}: {odd[:3]}")
    whole = spark.createDataFrame([(name, size // width) for name, size in listed], "file string, tokens long")
    blocks = (whole.filter("tokens > 0").select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(block_tokens).cast("long"))).alias("start"))
              .select("file", "start", F.least(F.lit(block_tokens), F.col("tokens") - F.col("start")).alias("size")))
    # Tasks of up to 64 blocks each, and enough of them to keep a small cluster busy.
    n_blocks = sum(-(-size // width // block_tokens) for _, size in listed)
    tasks = max(-(-n_blocks // 64), min(n_blocks, 2 * spark.sparkContext.defaultParallelism), 1)
    blocks = blocks.repartition(tasks, "file", "start")
    scanned = saved(blocks.mapInArrow(_separators(folder, separator, width), "file string, start long, size long, found array<long>"))
    # The scan sees one short row per block: separators so far, the place after the last of them, and whether it is the file's end.
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    short = scanned.select("file", "start", "size", F.size("found").alias("n"), F.array_max("found").alias("last"))
    short = (short.withColumn("ordinal", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("open", F.coalesce(F.max("last").over(before) + 1, F.lit(0)))
             .withColumn("is_end", F.lead("start").over(order).isNull()))
    stitched = scanned.join(short.select("file", "start", "ordinal", "open", "is_end"), ["file", "start"])
    end = F.col("start") + F.col("size")
    ends = F.when(F.col("is_end") & (F.coalesce(F.array_max("found") + 1, F.col("open")) < end), F.concat("found", F.array(end))).otherwise(F.col("found"))
    begins = F.concat(F.array("open"), F.transform("found", lambda x: x + 1))
    documents = stitched.select("file", "ordinal", begins.alias("begins"), F.posexplode(ends).alias("k", "end"))
    start = F.get("begins", F.col("k"))
    return documents.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
