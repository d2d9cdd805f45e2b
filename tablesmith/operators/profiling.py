"""Learn what a table's columns hold, in space that does not grow with the table.

One aggregate of mergeable sketches (a fixed size per column and task) tells choices from free text. Exact vocabularies
are counted for the choices only, so a column of texts is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions import values as V
from tablesmith.session import saved

MAX_CHOICES = 1000
SKETCH_ERROR = 0.02  # relative standard error of the distinct counts
MARGIN = 1.25  # columns up to this many times MAX_CHOICES are counted exactly: twelve standard errors


def _fields(df: DataFrame, names: Iterable[str] | None) -> tuple[list[str], list[str]]:
    wanted = None if names is None else set(names)
    fields = [f for f in df.schema.fields if wanted is None or f.name in wanted]
    numbers = [f.name for f in fields if isinstance(f.dataType, V.NUMERIC)]
    words = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    if not numbers and not words:
        raise ValueError("no numeric or text column to profile")
    return numbers, words


def column_sketches(df: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """One row per numeric or text column: rows, nulls, lo, hi and quartiles of numbers, about how many different
    values, and the bytes of the longest text. One pass, map-side combined. An empty table gives zero counts and nulls."""
    numbers, words = _fields(df, fields)
    none = F.lit(None)

    def facts(name: str, number: bool) -> Column:
        c = F.col(name)
        return F.struct(
            F.lit(name).alias("field"), F.lit("number" if number else "words").alias("kind"), F.count(F.lit(1)).alias("rows"), F.count_if(c.isNull()).alias("nulls"),
            (F.min(c) if number else none).cast("double").alias("lo"), (F.max(c) if number else none).cast("double").alias("hi"),
            (F.percentile_approx(c.cast("double"), [0.25, 0.5, 0.75]) if number else none).cast("array<double>").alias("quartiles"),
            F.approx_count_distinct(c, SKETCH_ERROR).alias("about_different"),
            (none if number else F.max(F.octet_length(c))).cast("bigint").alias("longest"))

    every = [facts(n, True) for n in numbers] + [facts(w, False) for w in words]
    return df.agg(F.array(*every).alias("facts")).select(F.inline("facts"))


def vocabularies(df: DataFrame, words: list[str]) -> DataFrame:
    """Counts of every value of some text columns: field, value, n. Null is a value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(w).alias("field"), F.col(w).alias("value")) for w in words]))
    return df.select(pairs.alias("r")).groupBy("r.field", "r.value").agg(F.count(F.lit(1)).alias("n"))


def profile_columns(df: DataFrame, fields: Iterable[str] | None = None, max_choices: int = MAX_CHOICES) -> tuple[DataFrame, DataFrame]:
    """The sketches with each column's final kind (number, choice, text), and the vocabularies of the choices.

    A text column is a choice if it has at most ``max_choices`` different values, null not counted. The sketch settles
    columns far above that; the others are counted exactly, so the answer is exact there. Both tables are small and
    kept in the shared folder: at most MARGIN * max_choices values for each column.
    """
    sketches = saved(column_sketches(df, fields))
    near = [r.field for r in sketches.filter((F.col("kind") == "words") & (F.col("about_different") <= MARGIN * max_choices)).select("field").collect()]
    found = saved(vocabularies(df, near)) if near else sketches.sparkSession.createDataFrame([], "field string, value string, n bigint")
    sizes = found.groupBy("field").agg(F.count("value").alias("different")).filter(F.col("different") <= max_choices)
    kinds = sketches.join(sizes, "field", "left").withColumn(
        "kind", F.when(F.col("kind") == "number", "number").when(F.col("different").isNotNull(), "choice").otherwise("text"))
    return kinds, found.join(sizes.select("field"), "field", "left_semi")


def profile_constraints(df: DataFrame, fields: Iterable[str] | None = None, max_choices: int = MAX_CHOICES) -> DataFrame:
    """Bounds and vocabularies as one table: a row per numeric column (lo, hi) and per (choice column, value) with its
    count. Columns of free text have no row; ``profile_columns`` names them."""
    kinds, words = profile_columns(df, fields, max_choices)
    bounds = kinds.filter(F.col("kind") == "number").select("field", "lo", "hi")
    return bounds.unionByName(words, allowMissingColumns=True)


def learned_rules(df: DataFrame, fields: Iterable[str] | None = None, max_choices: int = MAX_CHOICES) -> dict[str, dict]:
    """Rules for ``Settings.constraints``: bounds of numbers, sorted values of choices; at most ``max_choices`` values
    for each column come to the driver. Free text and columns without a value have no rule."""
    rules: dict[str, dict] = {}
    for r in profile_constraints(df, fields, max_choices).collect():
        if r.lo is not None:
            rules[r.field] = {"min": r.lo, "max": r.hi}
        elif r.value is not None:
            rules.setdefault(r.field, {"valid_values": []})["valid_values"].append(r.value)
    for rule in rules.values():
        if "valid_values" in rule:
            rule["valid_values"].sort()
    return rules
