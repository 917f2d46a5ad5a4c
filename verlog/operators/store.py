"""Durable state as tables: write-ahead records, manifest edits, snapshots, backups and audit lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a record's header, and the reversed polynomial of CRC32C.
HEADER_BYTES, CRC32C_POLYNOMIAL = 40, 0x82F63B78


def crc32c(value: Column) -> Column:
    """Checksum of binary values; Spark's own ``crc32`` has another polynomial. Vectorised over a batch's rows."""

    def run(values):
        import numpy as np
        import pandas as pd

        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, table >> 1 ^ CRC32C_POLYNOMIAL, table >> 1).astype(np.uint32)
        raw = [b"" if v is None else bytes(v) for v in values]
        size = np.array([len(b) for b in raw], np.int64)
        flat, start = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size
        crc, left = np.full(len(raw), 0xFFFFFFFF, np.uint32), np.arange(len(raw))
        for k in range(int(size.max(initial=0))):
            left = left[size[left] > k]
            crc[left] = table[(crc[left] ^ flat[start[left] + k]) & 0xFF] ^ crc[left] >> 8
        out = pd.Series((crc ^ 0xFFFFFFFF).astype("int64"))
        return out.where([v is not None for v in values])

    return F.pandas_udf(run, "long", F.PandasUDFType.SCALAR)(value)


def _stop(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (segment, pos, lsn, ok) with ``broken``, and one row: where the chain ends (nulls if it does not).

    A record breaks the chain if it is bad or its lsn is not the one before it plus one. Breaks within a segment come
    from a window of that segment; those between segments from one small row a segment."""
    w = Window.partitionBy("segment").orderBy("pos")
    rows = records.withColumn("broken", ~F.col("ok") | F.coalesce(F.col("lsn") != F.lag("lsn").over(w) + 1, F.lit(False)))
    per = rows.groupBy("segment").agg(F.min_by("lsn", "pos").alias("first"), F.max_by("lsn", "pos").alias("last"), F.min("pos").alias("from"), F.min(F.when(F.col("broken"), F.col("pos"))).alias("at"))
    jump = F.col("first") != F.lag("last").over(Window.orderBy("segment")) + 1  # one row for each segment file
    per = per.withColumn("at", F.when(F.coalesce(jump, F.lit(False)), F.col("from")).otherwise(F.col("at")))
    stop = per.where("at is not null").agg(F.min(F.struct("segment", "at")).alias("x")).select(F.col("x.segment").alias("stop_segment"), F.col("x.at").alias("stop_pos"))
    return rows, stop


def valid_prefix(records: DataFrame) -> DataFrame:
    """Records up to the first bad, missing or repeated one; all later segments are ignored."""
    rows, stop = _stop(records)
    rows = rows.crossJoin(F.broadcast(stop))  # one row
    keep = F.col("stop_segment").isNull() | (F.col("segment") < F.col("stop_segment")) | ((F.col("segment") == F.col("stop_segment")) & (F.col("pos") < F.col("stop_pos")))
    return rows.where(keep).select(*records.columns)


def recovery_report(records: DataFrame) -> DataFrame:
    """One row: records kept, last_lsn, truncated (records cut from the segment that breaks), ignored_segments."""
    rows, stop = _stop(records)
    rows = rows.crossJoin(F.broadcast(stop))  # one row
    kept = F.col("stop_segment").isNull() | (F.col("segment") < F.col("stop_segment")) | ((F.col("segment") == F.col("stop_segment")) & (F.col("pos") < F.col("stop_pos")))
    cut = (F.col("segment") == F.col("stop_segment")) & (F.col("pos") >= F.col("stop_pos"))
    return rows.agg(
        F.count_if(kept).alias("records"), F.max(F.when(kept, F.col("lsn"))).alias("last_lsn"),
        F.count_if(F.coalesce(cut, F.lit(False))).alias("truncated"), F.countDistinct(F.when(F.col("segment") > F.col("stop_segment"), F.col("segment"))).alias("ignored_segments"),
    )


def inspect_records(records: DataFrame) -> DataFrame:
    """records (segment, lsn, seq, op, key, value) with their byte offset in the segment and their lengths."""
    size = HEADER_BYTES + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    w = Window.partitionBy("segment").orderBy("lsn").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long")
    return records.select("segment", offset.alias("offset"), "lsn", "seq", "op", F.octet_length("key").alias("key_len"), F.coalesce(F.octet_length("value"), F.lit(0)).alias("value_len"))


def apply_payloads(records: DataFrame) -> DataFrame:
    """The log entries among records: noop ones change nothing."""
    return records.where(F.col("op").isin("put", "delete")).select("key", "seq", "op", F.when(F.col("op") == "put", F.col("value")).alias("value"))


def table_stats(log: DataFrame, by: str) -> DataFrame:
    """What a table's footer tells: entries, tombstones, key and sequence bounds."""
    return log.groupBy(by).agg(F.count("*").alias("entries"), F.count_if(F.col("op") == "delete").alias("tombstones"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def newest_first(tables: DataFrame) -> DataFrame:
    return tables.orderBy(F.desc("table_id"))


def _good_edits(edits: DataFrame) -> DataFrame:
    bad = F.broadcast(edits.agg(F.min(F.when(~F.col("ok"), F.col("edit_seq"))).alias("bad")))  # one row
    return edits.crossJoin(bad).where("bad is null or edit_seq < bad").drop("bad")


def replay_manifest(edits: DataFrame) -> DataFrame:
    """Live tables of edits (edit_seq, kind create | delete | set_last_sequence, table_id, sequence, ok): created and not
    deleted later, from the edits before the first bad one."""
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("edit_seq")))
    per = _good_edits(edits).where("kind <> 'set_last_sequence'").groupBy("table_id").agg(last("create").alias("created"), last("delete").alias("deleted"))
    return per.where("created is not null and (deleted is null or created > deleted)").select("table_id", "created")


def manifest_state(edits: DataFrame) -> DataFrame:
    """One row: edits replayed, last_edit_seq, last_sequence (0 if never set)."""
    set_ = F.when(F.col("kind") == "set_last_sequence", F.col("edit_seq"))
    return _good_edits(edits).agg(F.count("*").alias("edits"), F.max("edit_seq").alias("last_edit_seq"), F.coalesce(F.max_by("sequence", set_), F.lit(0)).cast("long").alias("last_sequence"))


def first_by_index(commands: DataFrame) -> DataFrame:
    """commands (pos, idx, lsn): of an index the command that was appended first."""
    return commands.groupBy("idx").agg(F.min_by("lsn", "pos").alias("lsn"))


def snapshot_rows(log: DataFrame, cutoff: int) -> DataFrame:
    return log.where(F.col("seq") <= cutoff)


def export_snapshot(log: DataFrame, cutoff: int, path: str) -> str:
    """Write all versions up to ``cutoff``, sorted by key, to a folder named by it."""
    target = f"{path}/snapshot-{cutoff:020d}"
    snapshot_rows(log, cutoff).repartitionByRange("key").sortWithinPartitions("key", F.desc("seq")).write.option("parquet.bloom.filter.enabled#key", "true").parquet(target)
    return target


def install_snapshot(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def release_snapshot(spark: SparkSession, target: str) -> bool:
    """Delete a snapshot's folder; False if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))


def files_to_copy(source: DataFrame, target: DataFrame) -> DataFrame:
    """Incremental backup of file listings (name, size): what the target lacks, or has in another size."""
    return source.join(target, ["name", "size"], "left_anti")


def audit_lines(calls: DataFrame) -> DataFrame:
    """calls (ts, node_id, peer, opcode, status, auth, key_len, tenant) as JSON lines, absent fields left out, and as
    syslog records."""
    line = F.to_json(F.struct("ts", "node_id", "peer", "opcode", "status", "auth", "key_len", "tenant"))
    return calls.select("ts", "node_id", line.alias("line")).withColumn("syslog", F.format_string("<134>1 %s - verlog %d audit - %s", "ts", "node_id", "line"))


def validate_trace(events: DataFrame, header_seed: int, expected_seed: int) -> DataFrame:
    """One row of probe events (pos, seq, kind): seed_ok, the first place (from 1) whose seq is not its number, and what
    is there, durability events, valid. A place's number comes from counts of the events before, by seq alone."""
    durable = F.col("kind").isin("fsync_latency", "usdt_marker", "publish_syscall")
    gap = F.min(F.when(F.col("pos") != F.col("seq"), F.struct("pos", "seq")))
    out = events.agg(gap.alias("gap"), F.count_if(durable).alias("durability_events"))
    seed = F.lit(header_seed == expected_seed)
    return out.select(seed.alias("seed_ok"), F.col("gap.pos").alias("expected_seq"), F.col("gap.seq").alias("actual_seq"), "durability_events", (seed & F.col("gap").isNull() & (F.col("durability_events") > 0)).alias("valid"))
