"""Refresh as a stream of collected snapshots: each micro-batch is one batch cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from slateflow import schemas
from slateflow.operators.refresh import Stores, run_refresh
from slateflow.sources.tables import latest_snapshot


def refresh_stream(spark: SparkSession, raw_dir: str, registry: DataFrame, stores: Stores, embed, checkpoint: str, on_report=None, **options) -> StreamingQuery:
    """Work off the snapshots (JSON, schemas.RAW) that arrived in `raw_dir` since the last run, then stop.

    Of several snapshots of a source in one batch the newest counts. A batch that runs again after a failure
    gives the same state: unchanged sources are noops.
    """

    def cycle(batch: DataFrame, batch_id: int) -> None:
        raw = latest_snapshot(batch)
        known = registry.join(raw.select("source_id"), "source_id", "left_semi")
        report = run_refresh(batch.sparkSession, known, raw, stores, embed, **options)
        if on_report:
            on_report(batch_id, report)

    stream = spark.readStream.schema(schemas.RAW).json(raw_dir)
    return stream.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
