"""End-to-end jobs: generate, plant, validate, view."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions import expressions as X
from tablesmith.functions import values as V
from tablesmith.functions.profiles import Profile
from tablesmith.operators.clearing import clear_cases
from tablesmith.operators import edgecases as E
from tablesmith.operators import journeys as J
from tablesmith.operators import quality as Q
from tablesmith.operators.ordered import CHUNK_ROWS, HOT_ROWS
from tablesmith.operators.synthesize import Settings
from tablesmith.session import saved
from tablesmith.sources.sink import write_records
from tablesmith.spec import EventSpec, Spec
from tablesmith.streaming.histories import repair_journeys as repair_journeys_on_arrival

KEYS_PER_TASK = 5_000  # a task makes all rows of its keys, which are far larger than the keys
# A scenario without events has one, carrying every column.
DEFAULT_EVENT = EventSpec("BUSINESS_EVENT", 1, (), 1, 10)


def generate_records(df: DataFrame, key: str, spec: Spec, settings: Settings, total: int | None = None, index: str | None = None) -> DataFrame:
    """Flat records on a keyed table: normal rows clear of every edge case, an exact share planted and labelled.

    Cases are placed on the keyed table first and columns are generated after, so wide rows are never shuffled.
    """
    placed = E.place_cases(df, key, spec, total, index)
    return E.apply_cases(E.synthesize_normal(placed, key, spec, settings), spec, settings, key)


def structural_rows(stable: DataFrame, key: str, spec: Spec, settings: Settings) -> DataFrame:
    """One narrow row per event of every entity: entity columns, metadata, and a unique whole row_id in
    (entity, event, occurrence) order, used as arrival order."""
    base_time = F.col("event_timestamp") if "event_timestamp" in stable.columns else None
    rows = J.fan_out(stable, key, spec.events, settings)
    events = sorted((e.clamped() for e in spec.events), key=lambda e: (e.sequence, e.event_type))
    before = [sum(e.max_occurrences for e in events[:i]) for i in range(len(events) + 1)]
    slot = V.first_match([(F.col("event_type") == e.event_type, F.lit(n)) for e, n in zip(events, before)])
    rows = rows.withColumn("row_id", F.col(key) * before[-1] + slot + F.col("event_occurrence") - 1)
    return J.with_metadata(rows.drop("transaction_id"), key, settings, base_time).withColumn("__record", J.record_key(key))


def with_event_columns(rows: DataFrame, stable: list[str], spec: Spec, settings: Settings) -> DataFrame:
    """Generate the events' own columns, on the first attempt that meets no edge case."""
    if not spec.edge_cases or spec.edge_fraction <= 0:
        return J.own_columns(rows, stable, spec, settings)
    numbered = rows.withColumn("__attempt", E.normal_attempt(rows, "__record", spec, settings))
    made = J.own_columns(numbered, stable, spec, settings, F.col("__attempt"))
    return clear_cases(made, spec, None, F.col("__attempt") == E.ATTEMPTS - 1).drop("__attempt")


def spread_keys(df: DataFrame, key: str, total: int) -> DataFrame:
    """The keys dealt over tasks by their number: a file of keys is small, and a few tasks would make all rows of it."""
    tasks = -(-total // KEYS_PER_TASK)
    return df.select(key).repartition(tasks, key) if tasks > 1 else df.select(key)


def generate_journeys(df: DataFrame, key: str, spec: Spec, settings: Settings, entities: int | None = None) -> DataFrame:
    """Event histories for a table with a whole-number key.

    The share of edge cases is a share of entities; that many event rows are picked among the rows able to carry one.
    Columns are pure functions of the keys, so the picks are joined to the narrow structural rows and the wide
    columns are generated after that join: wide rows are never shuffled. Able rows and picks are kept in the shared folder.
    """
    spec = spec if spec.events else replace(spec, events=(DEFAULT_EVENT,))
    for case in spec.edge_cases:
        X.check_condition(case.condition, E.effective_spec(spec, case))
    total = df.count() if entities is None else entities
    stable = J.entity_table(spread_keys(df, key, total), key, spec, settings)
    rows = structural_rows(stable, key, spec, settings)
    target = E.edge_count(total, spec.edge_fraction) if spec.edge_cases else 0
    if target == 0:
        made = with_event_columns(rows, stable.columns, spec, settings).drop("__record")
        return made.withColumns({"edge_case_name": F.lit(None).cast("string"), "is_edge_case": F.lit(False)})
    able = with_event_columns(rows, stable.columns, spec, settings)
    picked = saved(E.pick_eligible(able, "__record", spec, settings, target, "row_id"))
    made = with_event_columns(rows.join(picked, "row_id", "left"), stable.columns, spec, settings)
    return E.apply_cases(made, spec, settings, "__record").drop("__record")


@dataclass(frozen=True)
class Validation:
    """Options of a validation run. ``key`` identifies a record in redrawn values (default: order, else the first column).

    With ``set_aside`` a labelled row that cannot meet its case is flagged in the column ``set_aside`` instead of
    failing the job; it keeps its label and says why in ``issues``. On a stream, journey state unseen for ``expire_after``
    milliseconds is forgotten; without it, it is kept.
    """

    profile: Profile = Profile()
    rules: dict | None = None
    key: str | None = None
    order: str | None = None
    journeys: bool = False
    set_aside: bool = False
    expire_after: int | None = None
    hot_rows: int = HOT_ROWS
    chunk_rows: int = CHUNK_ROWS


def validate(df: DataFrame, spec: Spec, settings: Settings, options: Validation = Validation()) -> DataFrame:
    """All repairs in their fixed order; the result carries an ``issues`` array per record.

    Everything is narrow except the journey repairs: ids, times and keys are scanned by journey on narrow rows, and the
    wide table meets the list of changed arrivals once.
    """
    key = options.key or options.order or df.columns[0]
    aside = Q.SET_ASIDE if options.set_aside else None
    if aside and aside in spec:
        raise ValueError(f"column {aside!r} is declared; rows cannot be set aside under that name")

    def labelled(records: DataFrame) -> DataFrame:
        if "edge_case_name" in records.columns:
            return E.apply_cases(records, spec, settings, key, aside=aside)
        # Without names a label only has to be true; the names found are not kept.
        return E.name_labelled(records, spec, aside=aside).drop("edge_case_name") if "is_edge_case" in records.columns and spec.edge_cases else records

    def clear(records: DataFrame) -> DataFrame:
        return records if not spec.edge_cases or "is_edge_case" not in records.columns else clear_cases(records, spec)

    df = J.with_issues(df)
    df = labelled(df.withColumn(aside, F.lit(False)) if aside else df)
    df = Q.repair_country_values(df, options.profile)
    df = Q.coerce_types(df, spec, settings)
    df = Q.repair_choices(df, spec)
    df = Q.clamp_ranges(df, spec)
    df = Q.clamp_percentages(df, spec)
    df = Q.repair_formulas(df, spec, options.rules)
    df = Q.ordered_timestamps(df, ["event_timestamp", "notification_dispatch_ts", "customer_response_ts"])
    df = Q.repair_phones(df, options.profile)
    df = Q.drop_undeclared(df, spec, ("issues", "edge_case_name", key, *([aside] if aside else [])))
    df = clear(labelled(df))
    if options.journeys:
        if df.isStreaming:
            df = repair_journeys_on_arrival(df, options.order, spec.events, settings, spec.entity_key, options.expire_after)
        else:
            df = J.repair_journeys(df, options.order, spec.events, settings, spec.entity_key, options.hot_rows, options.chunk_rows)
    df = Q.fill_missing(df, spec, options.rules)
    return clear(labelled(df))


def validate_to(df: DataFrame, spec: Spec, settings: Settings, path: str, options: Validation = Validation()) -> DataFrame:
    """Validate, write all rows under ``path`` and return the report, in one job over the input.

    Rows set aside go to the folder ``set_aside=true``, all others to ``set_aside=false``; ``kept_records`` and
    ``set_aside_records`` read one folder each. The report's numbers are taken by the tasks that write, one result per
    finished task, so the data is neither scanned twice nor counted twice when a lost task runs again. An existing
    ``path`` is refused.
    """
    checked = validate(df, spec, settings, replace(options, set_aside=True))
    taken = Observation()
    write_records(checked.observe(taken, *Q.report_counts(checked)), path, partition_by=[Q.SET_ASIDE])
    counts = taken.get
    report = df.sparkSession.range(1).select(*[F.lit(counts[n]).cast("bigint").alias(n) for n in Q.COUNTED])
    return report.withColumn("deterministic_checks", F.array(*[F.lit(c) for c in Q.CHECKS]))


def kept_records(spark: SparkSession, path: str) -> DataFrame:
    """The valid rows of a validation run."""
    return _side(spark, path, False)


def set_aside_records(spark: SparkSession, path: str) -> DataFrame:
    """The rows a validation run set aside, with the reason in ``issues``."""
    return _side(spark, path, True)


def _side(spark: SparkSession, path: str, aside: bool) -> DataFrame:
    return spark.read.parquet(path).filter(F.col(Q.SET_ASIDE) == aside).drop(Q.SET_ASIDE)
