"""Small value helpers shared by generators, predicates and repairs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Words read as true and false.
TRUE_WORDS = ["true", "yes", "y", "1", "enabled", "on"]
FALSE_WORDS = ["false", "no", "n", "0", "disabled", "off"]


def folded(c: Column) -> Column:
    """Case- and edge-space-insensitive form."""
    return F.lower(F.trim(c))


def canonical(c: Column) -> Column:
    """Form in which case, spaces and hyphens do not matter."""
    return F.translate(folded(c), " -", "__")


def canonical_text(value) -> str:
    return str(value).strip().lower().replace(" ", "_").replace("-", "_")


def round_half_up(c: Column, digits: int) -> Column:
    """Round with floor(x*10^d + 0.5), the same on every engine; huge and NaN values pass through."""
    scale = float(10**digits)
    return F.when(F.abs(c) < 1e13, F.floor(c * scale + 0.5) / F.lit(scale)).otherwise(c.cast("double"))


def finite(c: Column) -> Column:
    """The value, or null for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def as_number(c: Column, dtype: T.DataType) -> Column:
    """Value as a finite double, or null when it does not read as a number."""
    if isinstance(dtype, NUMERIC):
        return finite(c.cast("double"))
    if isinstance(dtype, T.StringType):
        return finite(F.trim(c).try_cast("double"))
    return F.lit(None).cast("double")


def truth_value(c: Column, dtype: T.DataType) -> Column:
    """Common boolean encodings as true/false, anything else as null."""
    if isinstance(dtype, T.BooleanType):
        return c
    if isinstance(dtype, NUMERIC):
        return F.when(c == 1, True).when(c == 0, False)
    if isinstance(dtype, T.StringType):
        word = folded(c)
        return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)
    return F.lit(None).cast("boolean")


def all_present(cols: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull()
    return out


def clamp(c: Column, low=None, high=None) -> Column:
    """Clamp that leaves null alone (greatest and least would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def first_match(arms: Iterable[tuple[Column, Column]], default: Column | None = None) -> Column:
    """Value of the first arm whose test holds."""
    chain = None
    for test, value in arms:
        chain = (F if chain is None else chain).when(test, value)
    if chain is None:
        return F.lit(None) if default is None else default
    return chain if default is None else chain.otherwise(default)
