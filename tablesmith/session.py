"""Session settings the jobs expect."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# Settings that matter for wide generated rows and for skew; all may be changed on a running session.
TUNING = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles a method above 8000 bytes of bytecode. A wide row can exceed that in one
    # whole-stage method, which then runs interpreted; below the limit Spark splits the work into small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session made elsewhere."""
    for name, value in TUNING.items():
        spark.conf.set(name, value)
    return spark


def build_session(app: str = "tablesmith", **options: str) -> SparkSession:
    """A session in UTC with adaptive execution; sizes stay with the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    for name, value in {**TUNING, "spark.sql.execution.arrow.pyspark.enabled": "true", **options}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where none is set, local mode gets one; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = Path(tempfile.mkdtemp(prefix="run-", dir="/tmp")).as_uri()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """Write a small intermediate table to the shared folder and read it back: computed once, safe against lost executors."""
    path = f"{shared_folder(df.sparkSession)}/tablesmith-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
