"""Merkle manifest of a table by time-forward processing.

Nodes are labelled (level, index), so that children come before parents. A node's digest is a message to its parent's
label; a priority queue ordered by label hands each node the digests of its children. The queue is external: a *band* of
``band`` levels is cut into blocks of 2^band neighbouring nodes, a task runs the queue of its block, and the tops of the
blocks are shuffled to the blocks of the next band. Then the sweep is reversed: each block gets the proof from its top to
the root, and hands every node below the steps from that node on. A leaf ends with the whole proof.

Trees are separate for each value of a column; their tops, in the order of that value, are the leaves of a last tree.
Leaves are numbered without a window over a whole tree: rows are sorted by range, counted in their partition, and moved
by the rows of the partitions before. So no task holds more than a block or a partition, whatever the size of a tree.

A proof is an array of steps from the leaf to the root: ``L`` or ``R`` and the digest of the sibling on that side, ``N``
where a run has one node. ``fold`` applies steps to a digest in Spark's own expressions.

Defined results: a null value is ``-`` in a digest; a null tree value is a tree of its own and the first; null ids come
first in their tree; equal ids are ordered by digest, and rows equal in all fields have proofs of their own at
neighbouring places, in no set order; an empty table gives an empty one; columns other than those named stay out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import quoted, saved

BAND = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(fields: Sequence[Column]) -> Column:
    """sha256 of fields, each ``-`` if null, else its length in bytes, ``:`` and its text."""
    texts = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]), 256)


def siblings(steps: Column) -> Column:
    """The digests of a proof, from leaf to root, end to end."""
    return F.array_join(F.transform(steps, lambda x: F.substring(x, 2, 64)), "")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    def up(node: Column, step: Column) -> Column:
        left = F.when(F.startswith(step, F.lit("L")), F.substring(step, 2, 64)).otherwise("")
        right = F.when(F.startswith(step, F.lit("R")), F.substring(step, 2, 64)).otherwise("")
        return F.sha2(F.concat(left, node, right), 256)

    return F.aggregate(steps, leaf, up)


def levels_of(nodes: int, band: int) -> int:
    """Levels that a block climbs in a tree with so many nodes at its foot: a band, or what is left to the root."""
    return min(band, (nodes - 1).bit_length())


def forward(leaves: Sequence[str], levels: int) -> dict[tuple[int, int], str]:
    """Digests by label, delivered upwards through the queue. The top is at (levels, 0)."""
    nodes = {(0, k): x for k, x in enumerate(leaves)}
    queue = [(1, k >> 1, k, x) for k, x in enumerate(leaves)]  # in order, so a heap
    while queue[0][0] <= levels:
        level, index = queue[0][:2]
        received = []
        while queue and queue[0][:2] == (level, index):
            received.append(heapq.heappop(queue)[3])
        nodes[level, index] = sha256("".join(received).encode()).hexdigest()
        heapq.heappush(queue, (level + 1, index >> 1, index, nodes[level, index]))
    return nodes


def backward(nodes: dict[tuple[int, int], str], levels: int, above: list[str]) -> list[list[str]]:
    """The proofs of a block's leaves, in their order, given the proof above its top; labels are visited in reverse."""
    proof = {(levels, 0): tuple(above)}
    for level, index in sorted(nodes, reverse=True):
        if level < levels:
            other = nodes.get((level, index ^ 1))
            step = "N" if other is None else ("L" if index & 1 else "R") + other
            proof[level, index] = (step, *proof[level + 1, index >> 1])
    return [list(proof[0, k]) for k in range(sum(level == 0 for level, _ in nodes))]


def _ordered(part: pa.Table) -> pa.Table:
    return part.sort_by("index")


def _climb(band: int):
    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = _ordered(part)
        n = part["n"][0].as_py()
        levels = levels_of(n, band)
        top = forward(part["digest"].to_pylist(), levels)[levels, 0]
        return pa.table({"tree": [key[0].as_py()], "index": [key[1].as_py()], "digest": [top], "n": pa.array([-(-n >> band)], pa.int64())})

    return run


def _descend(band: int):
    def run(key: tuple[pa.Scalar, ...], part: pa.Table, above: pa.Table) -> pa.Table:
        part = _ordered(part)
        levels = levels_of(part["n"][0].as_py(), band)
        nodes = forward(part["digest"].to_pylist(), levels)
        proofs = backward(nodes, levels, above["steps"][0].as_py())
        found = part.append_column("steps", pa.array(proofs, pa.list_(pa.string())))
        for name in ("subroot", "root"):
            found = found.append_column(name, pa.array([above[name][0].as_py()] * len(proofs), pa.string()))
        return found

    return run


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tree, each with its partition and its place among the rows of its tree there."""
    part = TaskContext.get().partitionId()
    tree, seen = None, 0
    for batch in batches:
        places = []
        for x in batch.column(batch.schema.get_field_index("tree")).to_pylist():
            tree, seen = (x, seen + 1) if x == tree else (x, 1)
            places.append(seen - 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int64()), pa.array(places, pa.int64())],
                                         [*batch.schema.names, "part", "place"])


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (saved ones) with ``index`` in their ``tree`` by ``order``, from 0, and the tree's number of rows ``n``."""
    keys = ["tree", *order]
    spread = rows.withColumn("spread", F.monotonically_increasing_id())  # rows alike in everything may part
    placed = spread.repartitionByRange(*keys, "spread").sortWithinPartitions(*keys, "spread").drop("spread")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    placed = saved(placed.mapInArrow(_counted, f"{fields}, part long, place long"))
    runs = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    tree, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(tree).alias("n"))
    return saved(placed.join(runs, ["tree", "part"]).withColumn("index", F.col("start") + F.col("place")).drop("part", "place", "start"))


def climb(leaves: DataFrame, band: int = BAND) -> list[DataFrame]:
    """The nodes at the foot of each band, leaves (tree, index, digest, n) first, tops of trees last."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    bands = [leaves]
    while most > 1 or len(bands) == 1:
        nodes = bands[-1].select("tree", "index", "digest", "n").withColumn("block", F.shiftright("index", band))
        bands.append(saved(nodes.groupBy("tree", "block").applyInArrow(_climb(band), "tree string, index long, digest string, n long")))
        most = -(-most >> band)
    return bands


def descend(bands: list[DataFrame], above: DataFrame, band: int = BAND) -> DataFrame:
    """The leaves with their proofs, given the proofs above the tops of the trees; ``above`` has tree, index, steps, subroot, root."""
    for nodes in reversed(bands[:-1]):
        nodes = nodes.withColumn("block", F.shiftright("index", band))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
        above = saved(nodes.groupBy("tree", "block").cogroup(above.select("tree", "index", "steps", "subroot", "root").groupBy("tree", "index"))
                      .applyInArrow(_descend(band), f"{fields}, steps array<string>, subroot string, root string"))
    return above


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id: str = "doc_id", tree: str = "lang", keep: Sequence[str] = (), band: int = BAND) -> DataFrame:
    """One row per document: doc, leaf, subroot, root, steps (the proof from leaf to root), and the columns in ``keep``."""
    rows = saved(docs.select(F.coalesce(F.concat(F.lit("="), quoted(tree).cast("string")), F.lit("-")).alias("tree"), quoted(id).alias("doc"),
                             digest([quoted(x) for x in fields]).alias("digest"),
                             F.struct(F.lit(0).alias("none"), *[quoted(x) for x in keep]).alias("kept")))
    bands = climb(numbered(rows, ["doc", "digest"]), band)
    tops = bands[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    last = climb(numbered(tops, ["name"]), band)
    start = last[-1].select("tree", "index", F.array().cast("array<string>").alias("steps"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    subroots = descend(last, start, band)
    above = subroots.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("index"), "steps", F.col("digest").alias("subroot"), "root")
    return descend(bands, above, band).select("doc", F.col("digest").alias("leaf"), "subroot", "root", "steps", *[F.col("kept")[x].alias(x) for x in keep])
