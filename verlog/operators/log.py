"""The version log ``(key, seq, op, value)``: building it, reading it under multi-version rules, collecting garbage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import entry_bytes, has_prefix

MAX_KEY_BYTES, MAX_VALUE_BYTES = 4 << 10, 16 << 20


def validate(rows: DataFrame) -> DataFrame:
    """``rows`` with ``error``: null for what may be written; bad rows can be set aside instead of stopping a job."""
    return rows.withColumn(
        "error",
        F.when(F.col("key").isNull() | (F.octet_length("key") == 0), "empty key")
        .when(F.octet_length("key") > MAX_KEY_BYTES, "key too long")
        .when(F.octet_length("value") > MAX_VALUE_BYTES, "value too long")
        .when(F.col("key").startswith("\x00"), "system key"),
    )


def append(log: DataFrame, mutations: DataFrame, order: str) -> DataFrame:
    """``log`` and mutations (key, op, value), each with the next sequence number in the order of a column. The base
    is one aggregate row; numbering needs one order over the batch, which is a transaction's or a file's worth."""
    base = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("base"))
    new = mutations.crossJoin(F.broadcast(base))  # one row
    new = new.withColumn("seq", F.col("base") + F.row_number().over(Window.orderBy(order)))
    return log.unionByName(new.select("key", "seq", "op", F.when(F.col("op") == "put", F.col("value")).alias("value")))


def dedupe(log: DataFrame) -> DataFrame:
    """One row for each (key, seq); a put wins over a delete, then the larger value."""
    best = F.max_by(F.struct("op", "value"), F.struct((F.col("op") == "put").alias("p"), F.coalesce("value", F.lit("")).alias("v")))
    return log.groupBy("key", "seq").agg(best.alias("x")).select("key", "seq", "x.op", "x.value")


def versions_at(log: DataFrame, read_ts: int | None = None, prefix: str = "") -> DataFrame:
    """The newest version of each key at a snapshot, tombstones included. Aggregates partially before its one shuffle;
    the filters reach the scan."""
    rows = log.where(has_prefix("key", prefix))
    rows = rows if read_ts is None else rows.where(F.col("seq") <= read_ts)
    return rows.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("x")).select("key", "x.seq", "x.op", "x.value")


def scan(log: DataFrame, read_ts: int | None = None, prefix: str = "", limit: int | None = None) -> DataFrame:
    """Live (key, value) at a snapshot; with ``limit`` the first keys."""
    rows = versions_at(log, read_ts, prefix).where("op = 'put'").select("key", "value")
    return rows if limit is None else rows.orderBy("key").limit(limit)


def get(log: DataFrame, key: str, read_ts: int | None = None) -> DataFrame:
    rows = log.where(F.col("key") == key)
    return scan(rows, read_ts)


def latest_of_feed(events: DataFrame) -> DataFrame:
    """Live (key, value) of events that may come twice: the newest (seq, then put over delete, then value) of each key,
    in one aggregate, as taking the best drops repeated ones by itself."""
    order = F.struct("seq", (F.col("op") == "put").alias("p"), F.coalesce("value", F.lit("")).alias("v"))
    best = events.groupBy("key").agg(F.max_by(F.struct("op", "value"), order).alias("x"))
    return best.where("x.op = 'put'").select("key", "x.value")


def capped_scan(log: DataFrame, max_rows: int, read_ts: int | None = None, prefix: str = "", limit: int | None = None) -> DataFrame:
    """The ``max_rows`` smallest keys, tombstones counted, of which the live ones are given."""
    rows = versions_at(log, read_ts, prefix).orderBy("key").limit(max_rows).where("op = 'put'").select("key", "value")
    return rows if limit is None else rows.orderBy("key").limit(limit)


def byte_capped_scan(log: DataFrame, max_rows: int, max_bytes: int, read_ts: int | None = None, prefix: str = "") -> DataFrame:
    """Live rows in key order until their bytes pass ``max_bytes``; the first row always. The row cap bounds the window."""
    rows = capped_scan(log, max_rows, read_ts, prefix).withColumn("bytes", F.octet_length("key") + F.octet_length("value"))
    w = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"total": F.sum("bytes").over(w), "rn": F.row_number().over(Window.orderBy("key"))})
    return rows.where((F.col("total") <= max_bytes) | (F.col("rn") == 1)).select("key", "value")


def raw_versions(log: DataFrame, prefix: str) -> DataFrame:
    return log.where(has_prefix("key", prefix)).orderBy("key", F.desc("seq"))


def latest_seq(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.max("seq").alias("seq"))


def commit_timestamps(log: DataFrame) -> DataFrame:
    return log.select("seq").distinct()


def flush_buckets(log: DataFrame, threshold: int, part: Column) -> DataFrame:
    """Which memtable of about ``threshold`` bytes an entry falls into, within each writer (``part``)."""
    w = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("part", part).withColumn("total", F.sum(entry_bytes(F.col("key"), F.col("value"))).over(w))
    return rows.groupBy("part", F.floor((F.col("total") - 1) / threshold).alias("bucket")).agg(F.count("*").alias("entries"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def gc(log: DataFrame, watermark: int, mode: str = "safe") -> DataFrame:
    """Versions that stay. safe: every read at ``watermark`` or later is unchanged. reference: a key whose newest version
    is a tombstone below the watermark goes; else versions from the watermark on and the newest one, if a put, stay."""
    by_key = Window.partitionBy("key").orderBy(F.desc("seq"))
    if mode == "safe":
        rows = log.withColumn("below", F.col("seq") < watermark)
        rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("key", "below").orderBy(F.desc("seq"))))
        return rows.where("not below or (rn = 1 and op = 'put')").select("key", "seq", "op", "value")
    rows = log.withColumns({"rn": F.row_number().over(by_key), "top_op": F.first("op").over(by_key), "top_seq": F.first("seq").over(by_key)})
    rows = rows.where(~((F.col("top_op") == "delete") & (F.col("top_seq") < watermark)))
    return rows.where((F.col("seq") >= watermark) | ((F.col("rn") == 1) & (F.col("op") == "put"))).select("key", "seq", "op", "value")


def compact(logs: list[DataFrame], watermark: int, path: str, mode: str = "safe") -> None:
    """Merge whole logs, collect garbage, write sorted by key with bloom filters on it."""
    rows = logs[0]
    for other in logs[1:]:
        rows = rows.unionByName(other)
    rows = gc(dedupe(rows), watermark, mode).repartitionByRange("key").sortWithinPartitions("key", F.desc("seq"))
    rows.write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def pick_l0(tables: DataFrame) -> DataFrame:
    """All unpinned tables, if there are two at least."""
    rows = tables.where("not pinned")
    n = rows.agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(n)).where("n >= 2").select("table_id")


def pick_leveled(tables: DataFrame, trigger: int = 4) -> DataFrame:
    """Level 0 from ``trigger`` tables on, else the first level of two at least; the output level is the next."""
    levels = tables.where("not pinned").groupBy("level").agg(F.count("*").alias("n")).where(f"n >= if(level = 0, {trigger}, 2)")
    level = levels.agg(F.min("level").alias("level"))
    return tables.where("not pinned").join(F.broadcast(level), "level").select("table_id", (F.col("level") + 1).alias("output_level"))


def pick_tiered(tables: DataFrame, ratio: float = 1.5, least: int = 4) -> DataFrame:
    """Of the least level that has one, the first run by size of ``least`` tables or more in which each is at most
    ``ratio`` times the one before; its tables and the level above as output. A run ends where a table is larger."""
    w = Window.partitionBy("level").orderBy("file_size", "table_id")
    larger = F.coalesce(F.col("file_size") / F.greatest(F.lag("file_size").over(w), F.lit(1)) > ratio, F.lit(False))
    rows = tables.where("not pinned").withColumn("larger", larger.cast("int")).withColumn("run", F.sum("larger").over(w))
    runs = rows.groupBy("level", "run").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    first = runs.agg(F.min(F.struct("level", "run")).alias("x")).select("x.level", "x.run")
    return rows.join(F.broadcast(first), ["level", "run"]).select("table_id", (F.col("level") + 1).alias("output_level"))  # one row


def versions_of(log: DataFrame) -> DataFrame:
    """All commit timestamps of each key, ascending."""
    return log.groupBy("key").agg(F.sort_array(F.collect_list("seq")).alias("versions"))


def watermarks(requests: DataFrame) -> DataFrame:
    """requests (source, pos, watermark) with the watermark in force after each: it never falls."""
    w = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return requests.withColumn("effective", F.max("watermark").over(w))
