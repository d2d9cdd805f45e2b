"""Entity tables fanned out into ordered event histories, and the repairs that keep histories consistent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions import expressions as X
from tablesmith.functions import values as V
from tablesmith.functions.draws import Draws
from tablesmith.functions.generators import add_seconds
from tablesmith.operators.ordered import CHUNK_ROWS, HOT_ROWS, Running, lookup_join, running
from tablesmith.operators.synthesize import Settings, column_value, synthesize
from tablesmith.session import saved
from tablesmith.spec import EventSpec, Spec

METADATA = ["journey_id", "transaction_id", "event_type", "event_sequence", "event_occurrence", "event_timestamp"]
CLOCK_IN_ROW = 256


def _draws(settings: Settings, field: str, key: Column, attempt: Column | int = 0) -> Draws:
    return Draws(settings.seed, field, key, attempt, settings.mode)


def _tag(prefix: str, digits: Column) -> Column:
    """All 128 bits of a draw: ids stay unique at any number of rows."""
    return F.concat(F.lit(prefix), F.upper(digits))


def occurrences(event: EventSpec, settings: Settings, key: Column) -> Column:
    """How often the event happens to an entity."""
    event = event.clamped()
    return _draws(settings, f"occurrences:{event.event_type}", key).between(event.min_occurrences, event.max_occurrences)


def gap(event: EventSpec, settings: Settings, key: Column, occurrence: Column) -> Column:
    """Seconds since the entity's previous event."""
    return _draws(settings, f"gap:{event.event_type}", key, occurrence).between(5, 300)


def fan_out(entities: DataFrame, key: str, events: tuple[EventSpec, ...], settings: Settings, clock: bool = True) -> DataFrame:
    """One row per entity, event and occurrence, with the seconds elapsed since the entity's start.

    An entity's rows are made together, so up to CLOCK_IN_ROW possible rows the clock is summed inside the row and
    nothing is shuffled. Above that the sum is a window over one entity and its declared number of rows.
    """
    ordered = sorted((e.clamped() for e in events), key=lambda e: (e.sequence, e.event_type))
    at, size = F.col(key), sum(e.max_occurrences for e in events)
    if not clock or size > CLOCK_IN_ROW:
        kinds = F.array(*[F.struct(
            F.lit(e.event_type).alias("event_type"), F.lit(e.sequence).alias("event_sequence"),
            occurrences(e, settings, at).cast("int").alias("n")) for e in ordered])
        rows = entities.withColumn("__kind", F.explode(kinds)).withColumn(
            "event_occurrence", F.explode(F.sequence(F.lit(1), F.col("__kind.n"))))
        rows = rows.select(*entities.columns, "__kind.event_type", "__kind.event_sequence", "event_occurrence")
        return rows if not clock else _clock_by_window(rows, key, ordered, settings)

    counts = [occurrences(e, settings, at).cast("int") for e in ordered]
    counted = entities.withColumns({f"__n{i}": n for i, n in enumerate(counts)})
    gaps = F.concat(*[_gaps(e, settings, at, F.col(f"__n{i}")) for i, e in enumerate(ordered)])
    sums = F.aggregate(gaps, F.array().cast("array<bigint>"), lambda done, g: F.concat(
        done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + g)))
    rows = counted.select("*", F.posexplode(sums).alias("__at", "elapsed_seconds"))
    arms, start = [], F.lit(0)
    for i, e in enumerate(ordered):
        end = start + F.col(f"__n{i}")
        arms.append((F.col("__at") < end, F.struct(
            F.lit(e.event_type).alias("event_type"), F.lit(e.sequence).alias("event_sequence"),
            (F.col("__at") - start + 1).alias("event_occurrence"))))
        start = end
    return rows.withColumn("__slot", V.first_match(arms)).select(*entities.columns, "__slot.*", "elapsed_seconds")


def _gaps(event: EventSpec, settings: Settings, key: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), n), lambda i: gap(event, settings, key, i))


def _clock_by_window(rows: DataFrame, key: str, events: list[EventSpec], settings: Settings) -> DataFrame:
    step = V.first_match([(F.col("event_type") == e.event_type, gap(e, settings, F.col(key), F.col("event_occurrence"))) for e in events])
    path = Window.partitionBy(key).orderBy("event_sequence", "event_type", "event_occurrence")
    return rows.withColumn("elapsed_seconds", F.sum(step).over(path.rowsBetween(Window.unboundedPreceding, 0)))


def record_key(key: str) -> Column:
    """Identity of one event row, for its own draws."""
    return F.concat_ws("|", F.col(key).cast("string"), "event_type", F.col("event_occurrence").cast("string"))


def with_metadata(rows: DataFrame, key: str, settings: Settings, base_time: Column | None = None) -> DataFrame:
    """Add journey_id per entity, event_timestamp from the clock, and transaction_id per row."""
    start = F.lit(settings.as_of).cast("timestamp_ntz") if base_time is None else base_time
    timed = rows.withColumn("event_timestamp", add_seconds(start, F.col("elapsed_seconds"))).drop("elapsed_seconds")
    day = F.date_format("event_timestamp", "yyyyMMdd")
    own = F.upper(_draws(settings, "transaction_id", record_key(key)).hex())
    return timed.withColumns({
        "journey_id": _tag("JRN-", _draws(settings, "journey_id", F.col(key)).hex()),
        "transaction_id": F.concat(F.lit("TXN-"), day, F.lit("-"), own),
    })


def entity_table(df: DataFrame, key: str, spec: Spec, settings: Settings) -> DataFrame:
    """Columns that stay the same over an entity's whole history."""
    return synthesize(df, key, spec, settings, fields=spec.entity_fields())


def event_rows(entities: DataFrame, key: str, spec: Spec, settings: Settings, attempt: Column | int = 0) -> DataFrame:
    """Event histories for an entity table: metadata, entity columns, and each event's own columns.

    One wide schema: a column an event does not declare is null on its rows.
    """
    stable = entities.columns
    base_time = F.col("event_timestamp") if "event_timestamp" in stable else None
    rows = fan_out(entities, key, spec.events, settings)
    rows = with_metadata(rows.drop("transaction_id"), key, settings, base_time).withColumn("__record", record_key(key))
    return own_columns(rows, stable, spec, settings, attempt).drop("__record")


def own_columns(rows: DataFrame, stable: list[str], spec: Spec, settings: Settings, attempt: Column | int = 0) -> DataFrame:
    """Generate event-owned columns on the rows of the events that declare them, one select per dependency level."""
    owners = event_owners(spec, set(stable) | set(METADATA))
    for level in spec.levels([n for n in spec.names if n in owners], given=rows.columns):
        lookup = X.fields_of(rows)
        made = []
        for n in level:
            value = column_value(spec.column(n), settings, F.col("__record"), False, lookup, attempt)
            made.append(F.when(F.col("event_type").isin(owners[n]), value).alias(n))
        rows = rows.select("*", *made)
    return rows


def event_owners(spec: Spec, taken: set[str]) -> dict[str, list[str]]:
    """Event types on which each column appears, dependencies included."""
    owners: dict[str, list[str]] = {}
    for e in spec.events:
        for n in spec.closure(e.fields):
            if n not in taken:
                owners.setdefault(n, []).append(e.event_type)
    return owners


# Repairs over histories. ``order`` is the unique whole-number arrival column.


def with_issues(df: DataFrame) -> DataFrame:
    return df if "issues" in df.columns else df.withColumn("issues", F.array().cast("array<string>"))


def noted(*found: tuple[Column, str]) -> Column:
    """The issues so far plus the messages whose test holds."""
    new = F.array_remove(F.array(*[F.when(test, message).otherwise("") for test, message in found]), "")
    return F.concat(F.col("issues"), new)


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def fill_ids(df: DataFrame, order: str, settings: Settings) -> DataFrame:
    """Give rows without a journey or transaction id a new one."""
    df = with_issues(df)
    new = {n: _tag(prefix, _draws(settings, f"new:{n}", F.col(order)).hex()) for n, prefix in
           (("journey_id", "JRN-"), ("transaction_id", "TXN-")) if n in df.columns}
    tests = {n: _missing(F.col(n)) for n in new}
    messages = {"journey_id": "journey_id: missing", "transaction_id": "transaction_id: missing or repeated"}
    return df.withColumns({
        **{n: F.when(tests[n], c).otherwise(F.col(n)) for n, c in new.items()},
        "issues": noted(*[(tests[n], messages[n]) for n in new]),
    })


def repeated_rows(df: DataFrame, order: str, id_column: str) -> DataFrame:
    """Arrivals of the rows whose id stands on an earlier row, and nothing else.

    Ids on several rows come from a map-side combined count and minimum, so an id shared by a large part of the table
    never gathers in one task; only narrow rows are matched with those ids, which are kept in the shared folder.
    """
    present = df.select(order, id_column).filter(~_missing(F.col(id_column)))
    several = saved(present.groupBy(id_column).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__rows")).filter("__rows > 1"))
    repeats = lookup_join(present, several.select(id_column, "__first"), [id_column], order, "inner", counts=several)
    return repeats.filter(F.col(order) != F.col("__first")).select(order)


def _renewed(marked: DataFrame, order: str, settings: Settings, id_column: str) -> DataFrame:
    """New ids for the rows marked as ``__repeated``."""
    repeated = F.coalesce("__repeated", F.lit(False))
    fresh = _tag("TXN-", _draws(settings, f"new:{id_column}", F.col(order)).hex())
    return marked.withColumns({
        id_column: F.when(repeated, fresh).otherwise(F.col(id_column)),
        "issues": noted((repeated, f"{id_column}: missing or repeated")),
    })


def renew_repeated_ids(df: DataFrame, order: str, settings: Settings, id_column: str = "transaction_id") -> DataFrame:
    """Keep an id on its first row and give later rows with the same id a new one.

    The table is joined with the short list of repeats only.
    """
    df = with_issues(df)
    repeats = repeated_rows(df, order, id_column).select(order, F.lit(True).alias("__repeated"))
    return _renewed(df.join(repeats, order, "left"), order, settings, id_column).select(*df.columns)


def _event_kind() -> Column:
    return F.coalesce(F.nullif(F.col("event_type"), F.lit("")), F.lit("BUSINESS_EVENT"))


def _sequences(events: tuple[EventSpec, ...]) -> tuple[Column, Column, Column]:
    """The row's own sequence, the defined one (null for unknown events), and the one to use."""
    own = F.coalesce(F.nullif(F.col("event_sequence"), F.lit(0)), F.lit(1))
    defined = V.first_match([(_event_kind() == e.event_type, F.lit(e.sequence)) for e in events], F.lit(None).cast("int"))
    return own, defined, F.greatest(F.lit(1), F.coalesce(defined, own)).cast("int")


def set_sequences(df: DataFrame, events: tuple[EventSpec, ...]) -> DataFrame:
    """Event sequence from the definitions (unknown events keep theirs), at least 1; missing event types are named."""
    df = with_issues(df)
    own, defined, used = _sequences(events)
    return df.withColumns({
        "event_type": _event_kind(),
        "event_sequence": used,
        "issues": noted((defined.isNotNull() & (defined != own), "event_sequence: not the defined one")),
    })


def _time_or(settings: Settings) -> Column:
    return F.coalesce(F.col("event_timestamp"), F.lit(settings.as_of).cast("timestamp_ntz"))


def _history(entity_key: str | None, sequence: Column, when: Column) -> dict[str, Running]:
    """What earlier rows of a journey hold against a row."""
    values = {"__seq": Running("max", sequence), "__ts": Running("max", when)}
    return {**values, "__entity": Running("first", F.col(entity_key))} if entity_key else values


def _follow_history(scanned: DataFrame, settings: Settings, entity_key: str | None) -> DataFrame:
    """Take over ``__seq``, ``__ts`` and ``__entity``; rows without them keep what they have."""
    when = _time_or(settings)
    sequence, moment = F.coalesce("__seq", "event_sequence"), F.coalesce(F.col("__ts"), when)
    fixed = {"event_sequence": sequence, "event_timestamp": moment}
    found = [
        (F.col("event_timestamp").isNull(), "event_timestamp: missing"),
        (F.coalesce(sequence > F.col("event_sequence"), F.lit(False)), "event_sequence: below an earlier one of its journey"),
        (moment > when, "event_timestamp: before an earlier one of its journey"),
    ]
    if entity_key:
        entity = F.coalesce(F.col("__entity"), F.col(entity_key))
        fixed[entity_key] = entity
        found.append((~entity.eqNullSafe(F.col(entity_key)), "entity key: not that of its journey"))
    return scanned.withColumns({**fixed, "issues": noted(*found)})


def order_journeys(df: DataFrame, order: str, settings: Settings, entity_key: str | None = None, journey: str = "journey_id",
                   hot_rows: int = HOT_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """In arrival order within a journey, sequence and time never go back and the entity key never changes."""
    df = with_issues(df)
    values = _history(entity_key, F.col("event_sequence"), _time_or(settings))
    return _follow_history(running(df, [journey], order, values, hot_rows, chunk_rows), settings, entity_key).select(*df.columns)


def repair_orders(df: DataFrame, order: str, events: tuple[EventSpec, ...], settings: Settings, entity_key: str | None = None,
                  hot_rows: int = HOT_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """What other rows of a history change on a row, one narrow row per arrival that is changed at all:
    ``__repeated`` (its transaction id is taken), ``__seq``, ``__ts`` and ``__entity`` (those of its journey so far).

    Only ids, sequence, time and entity key are read and moved. They are made once and kept in the shared folder, and so
    are the repairs. Rows without a journey get one of their own and have no history, so they are not scanned.
    """
    names = [n for n in dict.fromkeys([order, "journey_id", "transaction_id", *([entity_key] if entity_key else [])]) if n in df.columns]
    narrow = saved(df.select(*names, _sequences(events)[2].alias("__own_seq"), _time_or(settings).alias("__own_ts")))
    values = _history(entity_key, F.col("__own_seq"), F.col("__own_ts"))
    scanned = running(narrow.filter(~_missing(F.col("journey_id"))), ["journey_id"], order, values, hot_rows, chunk_rows)
    ruled = (F.col("__seq") > F.col("__own_seq")) | (F.col("__ts") > F.col("__own_ts"))
    if entity_key:
        ruled = ruled | ~F.col("__entity").eqNullSafe(F.col(entity_key))
    orders = scanned.filter(ruled).select(order, F.lit(False).alias("__repeated"), *values)
    if "transaction_id" in df.columns:
        repeats = repeated_rows(narrow, order, "transaction_id").select(order, F.lit(True).alias("__repeated"))
        orders = orders.unionByName(repeats, allowMissingColumns=True)
    return saved(orders.groupBy(order).agg(F.max("__repeated").alias("__repeated"), *[F.max(n).alias(n) for n in values]))


def repair_journeys(df: DataFrame, order: str, events: tuple[EventSpec, ...], settings: Settings, entity_key: str | None = None,
                    hot_rows: int = HOT_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``fill_ids``, ``renew_repeated_ids``, ``set_sequences`` and ``order_journeys`` with the wide table joined once.

    Everything that depends on other rows is found on narrow rows (``repair_orders``); the wide table then meets the
    list of changed arrivals and is shuffled by arrival at most once, or stays in place if the list is small.
    """
    df = with_issues(df)
    orders = repair_orders(df, order, events, settings, entity_key, hot_rows, chunk_rows)
    marked = fill_ids(df, order, settings).join(orders, order, "left")
    if "transaction_id" in df.columns:
        marked = _renewed(marked, order, settings, "transaction_id")
    return _follow_history(set_sequences(marked, events), settings, entity_key).select(*df.columns)
