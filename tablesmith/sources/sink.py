"""Write finished records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.spec import Spec


def write_records(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write records as parquet or JSON lines, by default one folder per event type.

    Files are written where the rows are; nothing is shuffled. JSON keeps nulls and writes ISO times.
    """
    if fmt not in ("parquet", "json"):
        raise ValueError(f"unknown record format {fmt!r}")
    parts = (["event_type"] if "event_type" in df.columns else []) if partition_by is None else partition_by
    writer = df.write.mode("errorifexists")
    if parts:
        writer = writer.partitionBy(*parts)
    if fmt == "json":
        writer.option("ignoreNullFields", "false").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    else:
        writer.parquet(path)


def public_names(df: DataFrame, spec: Spec) -> DataFrame:
    """Records as consumers see them: the label is called isEdgeCaseData and working columns are gone."""
    hidden = {"issues", "edge_case_name"}
    return df.select(*[F.col(c).alias("isEdgeCaseData" if c == "is_edge_case" else c) for c in df.columns if c not in hidden])
