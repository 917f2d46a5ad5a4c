"""JSON-lines sources and sinks of durable text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CDC = "v int, seq long, op string, key string, value string"


def write_cdc(events: DataFrame, path: str) -> None:
    events.select("line").withColumnRenamed("line", "value").write.text(path)


def decode_cdc(lines: DataFrame, binary: bool = False) -> DataFrame:
    """(seq, op, key, value, error, line) of text lines; a line that does not parse, or of another version, is an error
    row and keeps its text. With ``binary`` keys and values are bytes, which need not be text."""
    x = lines.select("value", F.from_json("value", CDC).alias("x"))
    kind = "binary" if binary else "string"
    bad = F.col("x").isNull() | ~F.col("x.v").eqNullSafe(F.lit(1)) | F.col("x.seq").isNull()
    return x.select("x.seq", "x.op", F.unhex("x.key").cast(kind).alias("key"), F.unhex("x.value").cast(kind).alias("value"), bad.alias("error"), F.when(bad, F.col("value")).alias("line"))


def read_cdc(spark: SparkSession, path: str) -> DataFrame:
    return decode_cdc(spark.read.text(path))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Recorded operations, strictly: a line that does not fit the schema fails the job."""
    schema = "client int, start long, end long, op string, key string, prefix string, value string, result string"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: The fields of a simulation's trace; keys, prefixes and values are in hexadecimal.
TRACE = "eid long, kind string, seed long, max_ops long, oid long, cmd string, key string, val string, prefix string, ok boolean, count long, id string, detail string"


def trace_lines(events: DataFrame) -> DataFrame:
    """(eid, line) of trace events: a JSON object each, without the fields that its kind does not have."""
    fields = [f.split()[0] for f in TRACE.split(", ")]
    given = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in fields]
    return events.select("eid", F.to_json(F.struct(*given)).alias("line"))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace events, strictly: a line that does not fit fails the job."""
    return spark.read.schema(TRACE).option("mode", "FAILFAST").json(path)


def probe_trace_gaps(events: DataFrame) -> DataFrame:
    """Probe events whose seq is not the next after the one before, within a source."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("seq")
    return events.withColumn("want", F.lag("seq").over(w) + 1).where("want is not null and seq <> want")
