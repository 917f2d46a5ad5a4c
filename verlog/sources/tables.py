"""Logs and fixtures derived from the driver's tables. Each derivation is narrow and leaves filters to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key user:NNNNNN, seq event_id + 1, errors as deletes."""
    e = table(spark, sf_dir, "events")
    value = F.concat_ws("|", "event_type", F.floor(F.col("value") * 100 + 0.5).cast("long").cast("string"), "props")
    put = F.col("event_type") != "error"
    return e.select(F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), (F.col("event_id") + 1).alias("seq"), F.when(put, "put").otherwise("delete").alias("op"), F.when(put, value).alias("value"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key cust:NNNNNN, seq o_orderkey + 1, finished orders as deletes."""
    o = table(spark, sf_dir, "orders")
    value = F.concat_ws("|", "o_orderpriority", F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").cast("string"))
    put = F.col("o_orderstatus") != "F"
    return o.select(F.concat(F.lit("cust:"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")).alias("key"), (F.col("o_orderkey") + 1).alias("seq"), F.when(put, "put").otherwise("delete").alias("op"), F.when(put, value).alias("value"))


#: Four splits of the user keyspace.
RANGES = [("", "user:000030", 1, 1, 1), ("user:000030", "user:000060", 2, 1, 2), ("user:000060", "user:000100", 3, 2, 3), ("user:000100", "user:000140", 4, 1, 4)]


def ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RANGES, "start string, end string, range_id long, epoch long, group_id long")


def tables_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table metadata made of suppliers: level, size and pins by modular arithmetic."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("table_id"), F.expr("cast(s_suppkey % 4 as int)").alias("level"), F.expr("100 + (s_suppkey * 37) % 400").alias("file_size"), F.expr("s_suppkey % 5 = 0").alias("pinned"))
