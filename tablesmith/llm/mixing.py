"""Mixing sources to target weights, with expressions only.

Each source gets a share of the words wanted by its weight; a share stops at ``max_epochs`` times the source, and what
is left over is shared again by weight. A source gives complete epochs first. The rest of its target is a weighted
sample without replacement (Efraimidis and Spirakis): every document draws an exponential key divided by its quality
weight, documents are ordered by key within their source, and running sizes are taken up to the target. The document at
the end is taken in part, so a source meets its target to the word.

No source is ordered in one task. Keys fall into fine buckets by their logarithm; sizes are summed by bucket, then by
groups of buckets, and those sums say in which bucket the target ends. Only that bucket's documents are ordered.

Defined results: a null text or one without words has size 0 and gives nothing; a null source is a source, last in
order; documents without an id draw by their text; equal keys are ordered by id, then by size and text, so repeated rows
share a draw and the first of them fill the target; an empty table gives an empty one; further columns stay, and one that
has the name of an added column is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import fresh, n_words, quoted, saved, text_key

#: Characters that lower a document's quality weight.
JUNK = r"[#*$%&|<>{}\[\]~^_=+!0-9]"


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code-point order; the mix holds ``share`` times all words."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    max_epochs: int = 2
    seed: int = 17
    fine: int = 4096  # buckets for each doubling of the key
    coarse: int = 64  # fine buckets in a group


def quality_weight(text: Column) -> Column:
    """Squared share of a text's characters that aren't junk, 0.01 at least; an empty text weighs 1."""
    length = F.length(text)
    plain = (length - F.regexp_count(text, F.lit(JUNK))) / length
    return F.when(length > 0, F.greatest(plain * plain, F.lit(0.01))).otherwise(F.lit(1.0))


def draw(id: Column, text: Column, seed: int) -> Column:
    """Uniform in (0, 1) by seed and id (by the text where there is no id), as any engine with md5 can draw it."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), text_key(text)))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source_key, source, source_size) with ``target``.

    One row per source: a mix states a weight for each, so this table is as small as a configuration.
    A share is level * weight until the cap; the level follows from the caps below it, in order of cap / weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(mix.weights))) + 1).cast("int")).cast("double")
    cap = F.col("source_size") * mix.max_epochs
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = (sizes.withColumn("weight", weight).withColumn("cap", cap.cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
              .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(mix.share))
              .withColumn("caps_below", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
              .withColumn("weights_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))))
    level = (F.col("wanted") - F.col("caps_below")) / F.col("weights_left")
    ranked = ranked.withColumn("place", F.row_number().over(by_ratio)).withColumn("level", level)
    first_open = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything)["level"]
    return (ranked.withColumn("level", first_open)
            .withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))))
            .select("source_key", "source", "source_size", "target"))


def _source_key(source: Column) -> Column:
    return F.xxhash64(source.cast("string"), source.isNull())


def cuts(keyed: DataFrame, mix: Mix) -> DataFrame:
    """For each source: target, complete epochs, the bucket in which the rest of the target ends, and the words before it.

    ``keyed`` has source_key, source, size and bucket. Sums by bucket are combined before they move; the two levels of
    running sums keep every window short, however many documents a source has.
    """
    fine = saved(keyed.groupBy("source_key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("size"))
                 .withColumn("group", F.floor(F.col("bucket") / mix.coarse)))
    groups = fine.groupBy("source_key", "group").agg(F.first("source").alias("source"), F.sum("size").alias("size"))
    goals = targets(groups.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), mix)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = saved(goals.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))

    def where_it_ends(sums: DataFrame, keys: list[str], at: str, before: Column) -> DataFrame:
        """The first ``at`` of each source whose running size reaches the rest."""
        running = Window.partitionBy(*keys).orderBy(at)
        sums = sums.withColumn("upto", before + F.sum("size").over(running.rowsBetween(Window.unboundedPreceding, 0)))
        return (sums.filter((F.col("upto") >= F.col("rest")) & (F.col("rest") > 0))
                .groupBy("source_key").agg(F.min(F.struct(at, (F.col("upto") - F.col("size")).alias("before"))).alias("cut"))
                .select("source_key", F.col(f"cut.{at}").alias(f"cut_{at}"), F.col("cut.before").alias(f"before_{at}")))

    rests = goals.select("source_key", "rest")
    by_group = where_it_ends(groups.join(rests, "source_key"), ["source_key"], "group", F.lit(0))
    inside = fine.join(by_group, "source_key").filter(F.col("group") == F.col("cut_group")).join(rests, "source_key")
    by_bucket = where_it_ends(inside, ["source_key"], "bucket", F.col("before_group"))
    return goals.join(by_bucket, "source_key", "left").select(
        "source_key", "source_size", "target", "epochs", "rest", "cut_bucket", F.col("before_bucket").alias("before"))


def mix_documents(docs: DataFrame, mix: Mix = Mix(), id: str = "doc_id", source: str = "source", text: str = "text", weight: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, and taken: the words the mix takes of each document, repeats counted.

    A document is used ``taken div size`` times whole, and once more up to word ``taken mod size``.
    """
    names = fresh(docs, "mix_source", "mix_size", "mix_key", "mix_tie", "mix_bucket", "mix_before", "mix_upto", "mix_cut", "mix_rest", "mix_epochs")
    s, size, key, tie, bucket, before, upto, cut, rest, epochs = names
    if clash := {c.lower() for c in docs.columns} & {"size", "source_size", "target", "taken"}:
        raise ValueError(f"rename the columns that the mix adds: {sorted(clash)}")
    exponential = -F.log(draw(quoted(id), quoted(text), mix.seed)) / (quality_weight(quoted(text)) if weight is None else weight)
    keyed = (docs.withColumn(s, _source_key(quoted(source))).withColumn(size, n_words(quoted(text))).withColumn(key, exponential).withColumn(tie, text_key(quoted(text)))
             .withColumn(bucket, F.floor(F.log2(quoted(key)) * mix.fine)))
    # Saved, so that Spark knows how small it is and leaves the documents where they are.
    found = saved(cuts(keyed.select(quoted(s).alias("source_key"), quoted(source).cast("string").alias("source"), quoted(size).alias("size"), quoted(bucket).alias("bucket")), mix))
    goal_names = fresh(keyed, "goal_source_size", "goal_target")
    goals = found.select(F.col("source_key").alias(s), F.col("source_size").alias(goal_names[0]), F.col("target").alias(goal_names[1]), F.col("epochs").alias(epochs),
                         F.col("rest").alias(rest), F.col("cut_bucket").alias(cut), F.col("before").alias(before))
    joined = keyed.join(goals, s)
    at_cut = quoted(bucket) == quoted(cut)
    # One bucket of each source is ordered; ties of the key by id, size and text.
    order = Window.partitionBy(s).orderBy(quoted(key), quoted(id), quoted(size), quoted(tie)).rowsBetween(Window.unboundedPreceding, 0)
    ordered = joined.filter(at_cut).withColumn(upto, quoted(before) + F.sum(quoted(size)).over(order))
    others = joined.filter(~F.coalesce(at_cut, F.lit(False))).withColumn(upto, F.lit(None).cast("long"))
    zero = F.lit(0).cast("long")
    part = (F.when(quoted(upto).isNotNull(), F.greatest(zero, F.least(quoted(size), quoted(rest) - quoted(upto) + quoted(size))))
            .when(quoted(bucket) < quoted(cut), quoted(size)).otherwise(zero))
    return ordered.unionByName(others).select(
        *map(quoted, docs.columns), quoted(size).alias("size"), quoted(goal_names[0]).alias("source_size"), quoted(goal_names[1]).alias("target"),
        (quoted(epochs) * quoted(size) + part).alias("taken"))
