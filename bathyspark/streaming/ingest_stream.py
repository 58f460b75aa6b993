"""Continuous level ingest with Structured Streaming (I3 as a stream).

New level files land in a folder; each micro-batch is deduplicated inside
itself (first row per key by input order) and against the stored table
(``left_anti``), then appended.  ``foreachBatch`` plus the idempotent append
gives exactly-once table content across restarts: the stream checkpoint
records which files were processed, and a replayed batch adds no rows
because its keys are already stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bathyspark.operators.ingest import DEFAULT_LEVEL_KEY, append_levels
from bathyspark.schemas import PROFILES


def level_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming DataFrame over Parquet level files in ``landing_dir``."""
    return (spark.readStream.schema(PROFILES).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(landing_dir))


def start_level_ingest(spark: SparkSession, landing_dir: str, table_path: str, checkpoint_location: str,
                       key: list[str] | None = None, order: list[str] | None = None,
                       available_now: bool = False, partition_by: list[str] | None = None):
    """Start the ingest stream; returns the ``StreamingQuery``.

    ``checkpoint_location`` must be on shared storage (for example under
    ``spark.checkpoint.dir``).  ``order`` defaults to the key, i.e. among
    identical keys in one micro-batch the smallest row wins.
    """
    key = key or DEFAULT_LEVEL_KEY

    def write_batch(batch_df: DataFrame, batch_id: int) -> None:
        append_levels(table_path, batch_df, key, order, partition_by, staging_name=f"batch-{batch_id}")

    writer = (level_stream(spark, landing_dir).writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
