"""The change feed as a stream: JSON lines in, an idempotent log out, progress in the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.log import dedupe
from ..sources.jsonl import decode_cdc


def follow(spark: SparkSession, source: str, sink: str, checkpoint: str, *, files_per_trigger: int = 100) -> StreamingQuery:
    """Append all new events to ``sink`` and stop. A batch that runs again overwrites its own folder, so each event
    arrives once although delivery is at least once. Lines that are no events go to ``sink`` + ``-errors``."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        events = decode_cdc(batch)
        events.where("not error").drop("error", "line").write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        events.where("error").select("line").write.mode("overwrite").parquet(f"{sink}-errors/batch={batch_id}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def materialized(spark: SparkSession, sink: str) -> DataFrame:
    """The log that the feed has rebuilt."""
    return dedupe(spark.read.parquet(sink).select("key", "seq", "op", "value"))
