"""WARC archives compressed with Zstandard: writer and reader.

An archive is a folder of files. Each file starts with a skippable frame that holds a dictionary; after it every record
is one Zstandard frame compressed with that dictionary, so records can be read one at a time. A reader loads the
dictionary from the leading frame (plain or compressed, as the format allows), decodes frame by frame, and checks each
record: version line, required fields, block length, payload length, digests, and the blank lines at the end.

Records of equal payloads are stored once: the one with the smallest page id is a ``response``, the others are
``revisit`` records that name it. A revisit keeps the HTTP header of the full payload, and so its length.

Files are written by the tasks that hold their pages, under a temporary name first, so a repeated task replaces its own
file. The folder lies in the shared folder of the session; Spark lists it and hands files out by name, and a task reads
its file frame by frame, holding one record at a time.

Defined results: a null payload is an empty one; rows that repeat the smallest page id of a payload are all responses;
rows without a page id revisit the smallest id there is, and are responses where there is none; a null URL is written as
``about:blank``; empty tables give an empty archive; further columns are not written. A damaged record is an error.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm.common import quoted
from tablesmith.session import shared_folder

DICTIONARY_MAGIC = 0x184D2A5D  # of the skippable frame with the dictionary
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 1 << 16
DATE = "2024-06-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Target-URI", "WARC-Payload-Digest")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + ('' if page is None else page))}>"


def record(page: str | None, url: str | None, payload: bytes, kind: str, refers_to: str | None) -> bytes:
    """The bytes of one record; ``payload`` is the full payload for revisits too, and not stored for them."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page)), ("WARC-Date", DATE), ("WARC-Target-URI", (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")),
              ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if page is not None:
        fields.append(("X-Page-ID", page))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", refers_to)]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class DamagedRecord(ValueError):
    """A record that breaks the format."""


def parse(raw: bytes) -> dict:
    """The fields of one record, all checked: page, url, kind, refers_to, payload_bytes, payload_digest, payload."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first not in ("WARC/1.0", "WARC/1.1") or not gap:
        raise DamagedRecord(f"not a record: {first[:40]!r}")
    fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
    if missing := [x for x in REQUIRED if x.lower() not in fields]:
        raise DamagedRecord(f"fields missing: {missing}")
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise DamagedRecord(f"block of {len(rest) - 4} bytes, {length} declared")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise DamagedRecord("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not gap or len(sizes) != 1:
        raise DamagedRecord("no HTTP header with a length")
    kind, payload_digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != sizes[0] or digest(payload) != payload_digest):
        raise DamagedRecord("payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise DamagedRecord("revisit with a payload or without the record it refers to")
    return {"page": fields.get("x-page-id"), "url": fields["warc-target-uri"], "kind": kind, "refers_to": fields.get("x-refers-to-page-id"),
            "payload_bytes": sizes[0], "payload_digest": payload_digest, "payload": payload if kind == "response" else None}


def trained(samples: list[bytes]) -> bytes:
    """A dictionary for a file, from the records at its start; few or tiny samples are used as they are."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def write_file(sink, records: Iterable[bytes]) -> int:
    """Write records to an open file; returns their number. Only the records that train the dictionary are held."""
    source, first, size = iter(records), [], 0
    for raw in source:
        first.append(raw)
        size += len(raw)
        if size >= SAMPLE_BYTES:
            break
    dictionary = trained([x[:8192] for x in first])
    sink.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)
    coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)
    n = 0
    for part in (first, source):
        for raw in part:
            sink.write(coder.compress(raw))
            n += 1
    return n


def read_file(source: io.RawIOBase, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The records of an open file, one frame at a time."""
    head = source.read(8)
    if len(head) < 8 or int.from_bytes(head[:4], "little") != DICTIONARY_MAGIC:
        raise DamagedRecord("no dictionary frame at the start")
    size = int.from_bytes(head[4:], "little")
    dictionary = source.read(size)
    if len(dictionary) != size:
        raise DamagedRecord("dictionary frame cut short")
    if dictionary[:4] == FRAME_MAGIC:
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    left = source.read(chunk)
    while left:
        frame, out = decoder.decompressobj(), []
        while not frame.eof:
            if not left and not (left := source.read(chunk)):
                raise DamagedRecord("last frame cut short")
            out.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else b""
        yield b"".join(out)
        left = left or source.read(chunk)


def with_roles(pages: DataFrame, id: str, payload: str, min_bytes: int) -> DataFrame:
    """(page, url, raw, kind, refers_to): who of equal payloads is the response. Counted by digest before anything is joined."""
    rows = pages.withColumn("raw", F.coalesce(F.col(payload).cast("binary"), F.lit(b""))).withColumn("sha", F.sha1("raw"))
    first = (rows.filter(F.length("raw") >= min_bytes).groupBy(F.col("sha").alias("first_sha")).agg(F.min(id).alias("first"), F.count("*").alias("n"))
             .filter(F.col("n") > 1).drop("n"))
    joined = rows.join(first, F.col("sha") == F.col("first_sha"), "left")
    revisit = F.col("first").isNotNull() & ~F.col(id).eqNullSafe(F.col("first"))
    return joined.withColumn("kind", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first")))


def write_archive(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> int:
    """Write a record per row to files in ``folder`` (a URI that all executors reach); returns the number of records."""
    rows = pages.select(quoted(id).alias("page"), quoted(url).cast("string").alias("url"), quoted(payload).alias("payload"))
    roles = with_roles(rows, "page", "payload", min_bytes).select(F.col("page").cast("string"), "url", "raw", "kind", F.col("refers_to").cast("string"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (record(p, u, r, k, f) for batch in batches for p, u, r, k, f in zip(*(c.to_pylist() for c in batch.columns)))
        first = next(records, None)
        if first is not None:
            files, path = pafs.FileSystem.from_uri(folder)
            from pyspark import TaskContext

            name, attempt = f"{path}/part-{TaskContext.get().partitionId():06d}.warc.zst", f"{path}/_{uuid.uuid4().hex}"
            with files.open_output_stream(attempt, compression=None) as sink:
                n = write_file(sink, (x for part in ([first], records) for x in part))
            files.move(attempt, name)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    files, path = pafs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    return roles.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long"))).first()[0]


READ = "page string, url string, kind string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def read_archive(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all files of an archive, as ``READ``; payloads only if wanted (they are checked either way)."""
    files, path = pafs.FileSystem.from_uri(folder)
    names = sorted(x.path for x in files.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith(".warc.zst"))
    listed = spark.createDataFrame([(x,) for x in names], "path string").repartition(max(1, len(names)), "path")
    fields = [x.split(" ")[0] for x in READ.split(", ")]
    kinds = dict(zip(fields, [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with where.open_input_stream(name, compression=None) as source:
                    held, size = [], 0
                    for raw in read_file(source):
                        held.append(parse(raw) | ({} if payloads else {"payload": None}))
                        size += len(raw)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array([x[f] for x in held], kinds[f]) for f in fields], fields)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([x[f] for x in held], kinds[f]) for f in fields], fields)

    return listed.mapInArrow(read, READ)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
