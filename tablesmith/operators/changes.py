"""Table maintenance: key checks, references, change sets and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.operators.ordered import HOT_ROWS, lookup_join
from tablesmith.session import saved

# Text that stands for "no value".
PLACEHOLDERS = ["", "string"]


# Keys and references


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on more than one row, with how many rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphan_references(df: DataFrame, reference: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Referenced keys with no target, and how many rows refer to each. An array column refers to all its items.

    References are counted before they are matched, so a popular one costs a single row in the join.
    """
    refs = df.select(reference)
    if isinstance(df.schema[reference].dataType, T.ArrayType):
        refs = refs.select(F.explode(reference).alias(reference))
    counted = refs.filter(F.col(reference).isNotNull()).groupBy(reference).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(targets, counted[reference] == targets[target_key], "left_anti")


def late_references(df: DataFrame, name: str, position: str, reference: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows whose reference is not defined on an earlier row. Where a name is defined first is known per name."""
    defined = df.groupBy(F.col(name).alias(reference)).agg(F.min(position).alias("defined_at"))
    found = lookup_join(df.filter(F.col(reference).isNotNull()), defined, [reference], position, "left", hot_rows)
    return found.filter(F.coalesce(F.col("defined_at") >= F.col(position), F.lit(True)))


# Cleaning


def is_placeholder(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(PLACEHOLDERS)


def clean_placeholders(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn placeholder text into null, inside structs too."""

    def clean(c: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StringType):
            return F.when(~is_placeholder(c), c)
        if isinstance(dtype, T.StructType):
            inner = F.struct(*[clean(c[f.name], f.dataType).alias(f.name) for f in dtype.fields])
            return F.when(c.isNotNull() & (F.size(F.array_compact(F.array(*[clean(c[f.name], f.dataType).cast("string") for f in dtype.fields]))) > 0), inner)
        return c

    wanted = set(df.columns if columns is None else columns)
    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) if f.name in wanted else F.col(f.name) for f in df.schema.fields])


# Change sets


def _given(c: Column, dtype: T.DataType) -> Column:
    return ~is_placeholder(c) if isinstance(dtype, T.StringType) else c.isNotNull()


def _value(f: T.StructField, have: set[str]) -> Column:
    """A change's value for a column of the base table; blank or absent is null."""
    if f.name not in have:
        return F.lit(None).cast(f.dataType)
    c = F.col(f.name).cast(f.dataType)
    return F.when(_given(c, f.dataType), c)


def _once(rows: Column, what: str, key: Column) -> Column:
    """True; several changes of one kind to one key without a sequence fail the job, because none of them is the last."""
    text = F.concat(F.lit(f"several {what} without a sequence for key "), F.coalesce(key.cast("string"), F.lit("null")))
    return F.when(rows > 1, F.raise_error(text).cast("boolean")).otherwise(F.lit(True))


def _last_edit(fields: list[T.StructField], at: Column) -> Column:
    """For every field its last given value, as a struct (an aggregate)."""
    return F.struct(*[F.max_by(F.col(f"__new.{f.name}"), F.when(F.col(f"__new.{f.name}").isNotNull(), at)).alias(f.name) for f in fields])


def apply_changes(base: DataFrame, key: str, deletes: DataFrame | None = None, edits: DataFrame | None = None,
                  adds: DataFrame | None = None, seq: str | None = None) -> DataFrame:
    """Delete, then edit, then add rows by a unique key.

    Placeholder keys and values count as not given. Edits of unknown or deleted keys do nothing and missing values leave
    the old one; an added row replaces a deleted or existing one. With ``seq`` the last edit of a field and the last add
    of a key win; without it a repeated key among the edits or adds fails the job. All changes are merged by key first.
    The base table is left-joined to the merged changes, so it stays in place where Spark finds those small enough to
    send; added rows come from the changes alone.
    """
    fields = [f for f in base.schema.fields if f.name != key]

    def part(df: DataFrame, kind: str) -> DataFrame:
        df = df.filter(_given(F.col(key), base.schema[key].dataType))
        have = {f.name for f in df.schema.fields}
        values = F.struct(*[_value(f, have).alias(f.name) for f in fields])
        at = F.col(seq) if seq and seq in have else F.lit(0)
        return df.select(F.col(key), F.lit(kind).alias("__kind"), at.cast("bigint").alias("__at"), values.alias("__new"))

    parts = [part(df, kind) for df, kind in ((deletes, "delete"), (edits, "edit"), (adds, "add")) if df is not None]
    if not parts:
        return base
    changes = parts[0]
    for p in parts[1:]:
        changes = changes.unionByName(p)
    is_edit, is_add = F.col("__kind") == "edit", F.col("__kind") == "add"
    merged = changes.groupBy(key).agg(
        F.bool_or(F.col("__kind") == "delete").alias("__deleted"), F.bool_or(is_add).alias("__added"),
        F.max_by(F.col("__new"), F.when(is_add, F.col("__at"))).alias("__add"), _last_edit(fields, F.when(is_edit, F.col("__at"))).alias("__edit"),
        F.count_if(is_edit).alias("__edits"), F.count_if(is_add).alias("__adds"))
    if seq is None:
        merged = merged.filter(_once(F.col("__edits"), "edits", F.col(key)) & _once(F.col("__adds"), "adds", F.col(key)))
    gone = F.coalesce(F.col("__deleted") | F.col("__added"), F.lit(False))
    kept = base.join(merged.select(key, "__deleted", "__added", "__edit"), key, "left").filter(~gone)
    changed = lambda f: F.coalesce(F.col(f"__edit.{f.name}"), F.col(f.name)).alias(f.name)
    kept = kept.select(*[F.col(key) if c == key else changed(base.schema[c]) for c in base.columns])
    if adds is None:
        return kept
    return kept.unionByName(merged.filter("__added").select(*[F.col(key).cast(base.schema[key].dataType).alias(key) if c == key else F.col(f"__add.{c}").alias(c) for c in base.columns]))


def change_violations(base: DataFrame, key: str, edits: DataFrame | None = None, adds: DataFrame | None = None,
                      renamed: str | None = None) -> DataFrame:
    """What the strict rules forbid: edits of unknown keys, adds of existing keys, renames onto a taken key.

    Every key that a change mentions is put in one list, counted, and looked up in the base table once.
    """
    mentions = base.select(F.col(key), F.lit("").alias("__as")).limit(0)
    if edits is not None:
        mentions = mentions.unionByName(edits.select(F.col(key), F.lit("edit").alias("__as")))
        if renamed is not None:
            mentions = mentions.unionByName(edits.filter(F.col(renamed).isNotNull() & (F.col(renamed) != F.col(key))).select(F.col(renamed).alias(key), F.lit("rename").alias("__as")))
    if adds is not None:
        mentions = mentions.unionByName(adds.select(F.col(key), F.lit("add").alias("__as")))
    counted = mentions.groupBy(key).agg(*[F.count_if(F.col("__as") == k).alias(f"__{k}s") for k in ("edit", "rename", "add")])
    known = base.select(F.col(key), F.lit(True).alias("__known")).join(counted, key, "left_semi").groupBy(key).agg(F.first("__known").alias("__known"))
    looked_up = counted.join(known, key, "left")
    exists = F.col("__known").isNotNull()
    problems = F.array_compact(F.array(
        F.when((F.col("__edits") > 0) & ~exists, "edit of unknown key"),
        F.when((F.col("__renames") > 0) & (exists | (F.col("__renames") > 1)), "rename onto existing key"),
        F.when((F.col("__adds") > 0) & (exists | (F.col("__adds") > 1)), "add of existing key")))
    return looked_up.select(key, F.explode(problems).alias("problem"))


def apply_changes_strict(base: DataFrame, key: str, deletes: DataFrame | None = None, edits: DataFrame | None = None,
                         adds: DataFrame | None = None, renamed: str | None = None) -> DataFrame:
    """As apply_changes, but any violation fails, and an edit may give its row a new key in column ``renamed``."""

    def sound(problems: DataFrame) -> None:
        if (found := problems.first()) is not None:
            raise ValueError(f"change set breaks the strict rules, for example {found.asDict()}")

    left = base if deletes is None else base.join(deletes.select(key), key, "left_anti")
    if edits is not None:
        sound(change_violations(left, key, edits, None, renamed))
    changed = apply_changes(left, key, edits=None if edits is None else edits.drop(*[c for c in [renamed] if c]))
    if renamed is not None and edits is not None:
        names = edits.filter(F.col(renamed).isNotNull()).select(key, F.col(renamed).alias("__renamed"))
        changed = changed.join(names, key, "left").withColumn(key, F.coalesce("__renamed", key)).select(*base.columns)
    if adds is None:
        return changed
    sound(change_violations(changed, key, None, adds))
    return changed.unionByName(adds.select(*base.columns))


def apply_grouped_changes(base: DataFrame, group: str, name: str, order: str, deletes: DataFrame | None = None,
                          edits: DataFrame | None = None, adds: DataFrame | None = None, hot_rows: int = HOT_ROWS, seq: str | None = None) -> DataFrame:
    """Change set on a composite key: deletes and edits name only ``name`` and hit all its rows; adds upsert (group, name).

    Placeholder names and values count as not given. With ``seq`` the last edit of a field and the last add of a
    (group, name) win; without it repeats fail the job. A name on a large part of the table is spread over several tasks;
    ``order`` is any column that varies within a name. Merged adds are kept in the shared folder, and only rows of names
    with adds are matched with them; the other rows are neither moved nor sorted for that.
    """
    fields = [f for f in base.schema.fields if f.name not in (group, name)]

    def given(df: DataFrame) -> DataFrame:
        return df.filter(_given(F.col(name), base.schema[name].dataType))

    def part(df: DataFrame, *keys: str) -> DataFrame:
        have = set(df.columns)
        at = F.col(seq) if seq and seq in have else F.lit(0)
        return given(df).select(*keys, at.cast("bigint").alias("__at"), F.struct(*[_value(f, have).alias(f.name) for f in fields]).alias("__new"))

    changes = None
    if deletes is not None:
        changes = given(deletes).select(name).distinct().withColumn("__deleted", F.lit(True))
    if edits is not None:
        patch = part(edits, name).groupBy(name).agg(_last_edit(fields, F.col("__at")).alias("__edit"), F.count(F.lit(1)).alias("__rows"))
        if seq is None:
            patch = patch.filter(_once(F.col("__rows"), "edits", F.col(name)))
        patch = patch.drop("__rows")
        changes = patch.withColumn("__deleted", F.lit(False)) if changes is None else changes.join(patch, name, "full_outer")
    if adds is not None:
        added = part(adds, group, name).groupBy(group, name).agg(F.max_by("__new", "__at").alias("__new"), F.count(F.lit(1)).alias("__rows"))
        if seq is None:
            added = added.filter(_once(F.col("__rows"), "adds", F.col(name)))
        added = saved(added.select(*[F.col(c) if c in (group, name) else F.col(f"__new.{c}").alias(c) for c in base.columns]))
        named = added.select(name).distinct().withColumn("__adds", F.lit(True))
        changes = named.withColumn("__deleted", F.lit(False)) if changes is None else changes.join(named, name, "full_outer")
    out = base
    if changes is not None:
        if "__edit" not in changes.columns:
            changes = changes.withColumn("__edit", F.lit(None).cast(T.StructType(fields)))
        joined = lookup_join(base, changes, [name], order, "left", hot_rows).filter(~F.coalesce("__deleted", F.lit(False)))
        patched = lambda f: F.coalesce(F.col(f"__edit.{f.name}"), F.col(f.name))
        patch = [F.col(c) if c in (group, name) else patched(base.schema[c]).alias(c) for c in base.columns]
        if adds is None:
            return joined.select(*patch)
        met = F.coalesce("__adds", F.lit(False))
        kept = joined.filter(met).select(*patch).join(added.select(group, name), [group, name], "left_anti").select(*base.columns)
        out = joined.filter(~met).select(*patch).unionByName(kept).unionByName(added)
    return out


# Event definitions as a table


def normalise_events(df: DataFrame, declared: list[str], aliases: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Clean event definitions (event_type, position, fields, min_occurrences, max_occurrences).

    Types become upper snake case, blank ones go, fields are mapped to their canonical names, kept when declared and
    only once, and occurrences are 1 at least. More definitions than a given ``limit`` fail the job.
    """
    names = F.transform("fields", lambda f: F.trim(f))
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        names = F.transform(names, lambda f: F.coalesce(F.try_element_at(table, F.lower(f)), f))
    low = F.greatest(F.lit(1), F.coalesce("min_occurrences", F.lit(1)))
    high = F.greatest(low, F.coalesce("max_occurrences", F.lit(10)))
    clean = df.select(
        F.upper(F.translate(F.trim("event_type"), " ", "_")).alias("event_type"), "position",
        F.array_distinct(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda f: f.isin(declared))).alias("fields"),
        low.alias("min_occurrences"), high.alias("max_occurrences"))
    clean = clean.filter(F.col("event_type") != "")
    if limit is not None and (n := clean.count()) > limit:
        raise ValueError(f"{n} event definitions, at most {limit} are allowed")
    return clean
