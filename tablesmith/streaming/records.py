"""Validation of records as they arrive.

Repairs of one record keep no state and are the batch job's functions; those that compare records of a journey keep a
few values per journey and transaction id (``histories``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tablesmith.operators.synthesize import Settings
from tablesmith.plans.scenario import Validation, validate
from tablesmith.session import shared_folder
from tablesmith.spec import Spec
from tablesmith.streaming.histories import keep_state_in_rocksdb


def repair_stream(stream: DataFrame, spec: Spec, settings: Settings, options: Validation = Validation()) -> DataFrame:
    """A validation run on a stream. Journey repairs need ``options.order`` and keep their state in RocksDB, which is set
    on the session here."""
    if options.journeys:
        keep_state_in_rocksdb(stream.sparkSession)
    return validate(stream, spec, settings, options)


def write_stream(stream: DataFrame, path: str, name: str, continuous: bool = True) -> StreamingQuery:
    """Append repaired records as parquet, one folder per event type; progress is kept in the shared folder.

    With ``continuous`` off, everything available now is written and the query ends.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).queryName(name)
    writer = writer.option("checkpointLocation", f"{shared_folder(stream.sparkSession)}/streams/{name}")
    if "event_type" in stream.columns:
        writer = writer.partitionBy("event_type")
    return writer.start() if continuous else writer.trigger(availableNow=True).start()
