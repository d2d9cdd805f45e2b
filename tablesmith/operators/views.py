"""Projections, latest-k views and nested entity documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.operators.journeys import METADATA
from tablesmith.operators.ordered import CHUNK_ROWS, HOT_ROWS, Running, hot_keys, running
from tablesmith.session import saved
from tablesmith.spec import EventSpec, Spec

LATEST = 10
TASK_ROWS = 50_000  # about how many whole records a task gets when documents are made
# Attributes shown next to the entity key.
IDENTITY = ["subscriber_msisdn", "phone_number", "account_id", "customer_id"]


def ordered_projection(df: DataFrame, spec: Spec) -> DataFrame:
    """Record metadata first, then catalog order, then the label."""
    lead = [c for c in METADATA if c in df.columns]
    body = [n for n in spec.names if n in df.columns and n not in lead]
    return df.select(*lead, *body, *[c for c in ("is_edge_case",) if c in df.columns])


def keyed_rows(df: DataFrame, entity: str) -> DataFrame:
    """Rows that have an entity key."""
    return df.filter(F.col(entity).isNotNull() & (F.col(entity).cast("string") != ""))


def occurrence_counts(df: DataFrame, entity: str, event: str = "event_type") -> DataFrame:
    return df.groupBy(entity, event).agg(F.count(F.lit(1)).alias("total_count"))


def latest_k(df: DataFrame, keys: list[str], order: str, k: int = LATEST) -> DataFrame:
    """The k newest rows of each group. Spark keeps k rows per group on the map side before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__rank", F.row_number().over(newest)).filter(F.col("__rank") <= k).drop("__rank")


def latest_entities(df: DataFrame, entity: str, order: str, k: int = LATEST) -> DataFrame:
    """Rows of the k entities that appeared last (by first row)."""
    df = keyed_rows(df, entity)
    newest = df.groupBy(entity).agg(F.min(order).alias("__first")).orderBy(F.col("__first").desc()).limit(k)
    return df.join(newest.select(entity), entity, "left_semi")


def identity_attributes(df: DataFrame, entity: str, order: str, attributes: list[str] | None = None) -> DataFrame:
    """Identity columns from each entity's newest row."""
    names = [c for c in (IDENTITY if attributes is None else attributes) if c in df.columns and c != entity]
    newest = F.max_by(F.struct(*names), F.col(order)) if names else F.lit(None)
    return df.groupBy(entity).agg(newest.alias("__id")).select(entity, *[F.col(f"__id.{n}").alias(n) for n in names])


def event_rank(events: tuple[EventSpec, ...], event: Column) -> Column:
    """Position in definition order; unknown events come after."""
    place = {e.event_type: i for i, e in enumerate(sorted(events, key=lambda e: e.sequence))}
    if not place:
        return F.lit(0)
    names = F.array(*[F.lit(n) for n in place])
    at = F.array_position(names, event).cast("int")
    return F.when(at == 0, len(place) + 1).otherwise(at)


def _blocks_in_place(df: DataFrame, entity: str, order: str, k: int, record: Column, known: Column, tasks: int) -> DataFrame:
    """Event blocks from one partitioning by entity into ``tasks`` parts: rows are ranked there, and counts, newest records
    and identity are taken from the ranked rows without moving them again. At most k records of an event are ever collected."""
    newest = Window.partitionBy(entity, "__kind").orderBy(F.col(order).desc())
    ranked = df.repartition(tasks, entity).withColumn("__rank", F.row_number().over(newest))
    return ranked.groupBy(entity, "__kind").agg(
        F.max("__rank").cast("bigint").alias("totalCount"), F.min(order).alias("__first"), F.max(order).alias("__last"),
        F.max_by(known, F.col(order)).alias("__id"), F.array_sort(F.collect_list(F.when(F.col("__rank") <= k, record))).alias("__records"))


def _blocks_cut_first(df: DataFrame, entity: str, order: str, k: int, record: Column, known: Column) -> DataFrame:
    """The same blocks for entities with many rows: aggregates are combined and records cut to k before any shuffle."""
    group = [entity, "__kind"]
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("totalCount"), F.min(order).alias("__first"), F.max(order).alias("__last"),
                                    F.max_by(known, F.col(order)).alias("__id"))
    recent = latest_k(df, group, order, k).groupBy(*group).agg(F.array_sort(F.collect_list(record)).alias("__records"))
    return counts.join(recent, group)


def nest(df: DataFrame, entity: str, events: tuple[EventSpec, ...], order: str, k: int = LATEST,
         identity: list[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One document per entity: identity, then per event its total count and the latest k records, oldest first.

    Entities are counted first (a small job over one column). Those with up to ``hot_rows`` rows are partitioned by
    entity once, into one part for every TASK_ROWS rows, and everything is taken from that one exchange; the others are
    cut on the map side, so documents stay small however many rows an entity has. Unknown events follow in order of first appearance.
    """
    records = df.columns
    names = [c for c in (IDENTITY if identity is None else identity) if c in df.columns and c != entity]
    df = keyed_rows(df, entity).withColumn("__kind", F.coalesce(F.nullif(F.col("event_type"), F.lit("")), F.lit("BUSINESS_EVENT")))
    record = F.struct(F.col(order).alias("__order"), F.struct(*records).alias("record"))
    known = F.struct(*names) if names else F.lit(None).cast("string")

    def documents(blocks: DataFrame) -> DataFrame:
        event = F.struct(F.col("__kind").alias("event_type"), "totalCount", F.transform("__records", lambda r: r["record"]).alias("records"))
        block = F.struct(event_rank(events, F.col("__kind")).alias("__place"), F.col("__first"), event.alias("event"))
        made = blocks.groupBy(entity).agg(F.max_by("__id", "__last").alias("__id"),
                                          F.transform(F.array_sort(F.collect_list(block)), lambda b: b["event"]).alias("events"))
        return made.select(entity, *[F.col(f"__id.{n}").alias(n) for n in names], "events")

    counted = df.groupBy(entity).agg(F.count(F.lit(1)).alias("__rows"))
    sizes = counted.agg(F.max("__rows").alias("most"), F.sum(F.when(F.col("__rows") <= hot_rows, F.col("__rows"))).alias("cold")).first()
    tasks = max(2, -(-(sizes.cold or 0) // TASK_ROWS))
    if (sizes.most or 0) <= hot_rows:
        return documents(_blocks_in_place(df, entity, order, k, record, known, tasks))
    listed = F.broadcast(saved(hot_keys(df.select(entity), [entity], hot_rows)).select(entity))
    cold = documents(_blocks_in_place(df.join(listed, entity, "left_anti"), entity, order, k, record, known, tasks))
    return cold.unionByName(documents(_blocks_cut_first(df.join(listed, entity, "left_semi"), entity, order, k, record, known)))


def renumber(df: DataFrame, group: list[str], order: str, name: str = "sequence", hot_rows: int = HOT_ROWS,
             chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number rows 1..N inside each group by a unique whole-number order."""
    return running(df.drop(name), group, order, {name: Running("count")}, hot_rows, chunk_rows)


def totals(df: DataFrame, entity: str) -> DataFrame:
    """Distinct entities and rows."""
    per_entity = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    return per_entity.agg(F.count(entity).alias("total_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"))


def label_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_records"), F.count_if("is_edge_case").alias("edge_cases"))
