"""A store in a folder: the operators over stored tables, with one writer at a time.

Layout: ``wal`` holds batches that are not flushed yet, ``tables/N`` flushed or compacted ones (sorted by key, with Bloom
filters on it), ``manifest`` the edits that say which tables live and up to which sequence number they reach. A table
exists once its edit does, so a job that is lost midway leaves nothing but files that no edit names. Batches of ``wal`` at
or below the flushed number are ignored. Reads are DataFrames and stay lazy; writes are batches, as a job a row would not do.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidArgument, StoreError, TxnConflict
from .operators import index, log, observe, store
from .operators.observe import cdc_poll

LOG = "key string, seq long, op string, value string"
EDIT = "edit_seq long, kind string, table_id long, sequence long, ok boolean"
DEFINITION = "pos long, name string, prefix string, kind string, argument string, dropped boolean"
CURSOR = "consumer string, last_seq long"


def _extractor(kind: str, argument: str | None):
    if kind == "whole":
        return index.whole
    if kind == "prefix":
        return index.head(int(argument))
    delimiter, place = argument[0], argument[1:]
    return index.field(delimiter, int(place))


class Store:
    """``Store(spark, path)`` opens a folder, or makes it with the first write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, part: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return bool(folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder))

    def _rows(self, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).json(f"{self.path}/{part}") if self._exists(part) else self.spark.createDataFrame([], schema)

    def _add(self, part: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{self.path}/{part}")

    # The manifest is a few rows a table; its state is read anew, so two openers of a folder see the same.
    def _manifest(self) -> tuple[list[int], int, int, int]:
        """Live tables (the newest first), the flushed sequence number, the watermark, the next edit."""
        edits = self._rows("manifest", EDIT).cache()
        live = [r["table_id"] for r in store.newest_first(store.replay_manifest(edits.where("kind in ('create', 'delete')"))).collect()]
        state = store.manifest_state(edits).first()
        mark = edits.agg(F.coalesce(F.max(F.when(F.col("kind") == "watermark", F.col("sequence"))), F.lit(0)).alias("w")).first()["w"]
        edits.unpersist()
        return live, state["last_sequence"], mark, (state["last_edit_seq"] or 0) + 1

    def _edit(self, first: int, *edits: tuple[str, int | None, int | None]) -> None:
        self._add("manifest", [(first + i, kind, table, seq, True) for i, (kind, table, seq) in enumerate(edits)], EDIT)

    def _unflushed(self, flushed: int) -> DataFrame:
        rows = self.spark.read.schema(LOG).parquet(f"{self.path}/wal") if self._exists("wal") else self.spark.createDataFrame([], LOG)
        return rows.where(F.col("seq") > flushed)

    def log(self) -> DataFrame:
        """All versions: (key, seq, op, value)."""
        live, flushed, _, _ = self._manifest()
        rows = self._unflushed(flushed)
        return rows.unionByName(self.spark.read.schema(LOG).parquet(*(f"{self.path}/tables/{t}" for t in live))) if live else rows

    def last_sequence(self) -> int:
        _, flushed, _, _ = self._manifest()
        return self._unflushed(flushed).agg(F.coalesce(F.max("seq"), F.lit(flushed)).alias("s")).first()["s"]

    def write(self, mutations: DataFrame | Iterable[tuple], raw: bool = False) -> int:
        """Append mutations (key, op, value) in their order as one batch; the last sequence number. A DataFrame needs a
        column ``pos`` for the order. One bad row refuses the batch. ``raw`` lets system keys through."""
        if not isinstance(mutations, DataFrame):
            mutations = self.spark.createDataFrame([(i, *m) for i, m in enumerate(mutations)], "pos long, key string, op string, value string")
        base = self.last_sequence()
        allowed = F.lit("system key") if raw else F.lit("")
        bad = log.validate(mutations).where(F.col("error").isNotNull() & (F.col("error") != allowed)).select("error").first()
        if bad:
            raise InvalidArgument(bad["error"])
        before = self.spark.createDataFrame([(None, base, None, None)], LOG)
        rows = log.append(before, mutations, "pos").where(F.col("seq") > base)
        rows.write.mode("append").parquet(f"{self.path}/wal")
        return self.last_sequence()

    def put(self, key: str, value: str) -> int:
        return self.write([(key, "put", value)])

    def delete(self, key: str) -> int:
        return self.write([(key, "delete", None)])

    def get(self, key: str, read_ts: int | None = None) -> str | None:
        row = log.get(self.log(), key, read_ts).first()
        return row["value"] if row else None

    def scan(self, prefix: str = "", read_ts: int | None = None, limit: int | None = None) -> DataFrame:
        return log.scan(self.log(), read_ts, prefix, limit)

    def versions(self, prefix: str) -> DataFrame:
        return log.raw_versions(self.log(), prefix)

    def _write_table(self, rows: DataFrame, table: int) -> None:
        rows = rows.select("key", "seq", "op", "value").repartitionByRange("key").sortWithinPartitions("key", F.desc("seq"))
        rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/tables/{table}")

    def _next_table(self) -> int:
        return self._rows("manifest", EDIT).agg(F.coalesce(F.max("table_id"), F.lit(0)).alias("t")).first()["t"] + 1

    def flush(self) -> int:
        """Make a table of what is not flushed yet; how many entries, 0 without any (and no table)."""
        _, flushed, _, edit = self._manifest()
        rows = self._unflushed(flushed)
        told = rows.agg(F.count("*").alias("n"), F.max("seq").alias("s")).first()
        if told["n"]:
            table = self._next_table()
            self._write_table(rows.where(F.col("seq") <= told["s"]), table)
            self._edit(edit, ("create", table, None), ("set_last_sequence", None, told["s"]))
        return told["n"]

    def set_watermark(self, ts: int) -> int:
        """Reads below may lose versions; the watermark never falls."""
        _, _, mark, edit = self._manifest()
        if ts > mark:
            self._edit(edit, ("watermark", None, ts))
        return max(mark, ts)

    def compact(self, mode: str = "safe") -> int:
        """Merge all tables, collecting garbage below the watermark; how many were merged, 0 if fewer than two."""
        live, _, mark, edit = self._manifest()
        if len(live) < 2:
            return 0
        table = self._next_table()
        rows = log.dedupe(self.spark.read.schema(LOG).parquet(*(f"{self.path}/tables/{t}" for t in live)))
        self._write_table(log.gc(rows, mark, mode), table)
        self._edit(edit, ("create", table, None), *(("delete", t, None) for t in live))
        return len(live)

    def create_index(self, name: str, prefix: str, kind: str = "whole", argument: str | None = None) -> dict:
        """Define an index (whole | prefix N | field, the delimiter followed by the place); entries derive from the log, so
        they are never behind it. Counts of its backfill."""
        if kind not in ("whole", "prefix", "field"):
            raise InvalidArgument(f"unknown extractor {kind}")
        held = self.indexes().select("pos", "name", "prefix")
        pos = (self._rows("indexes", DEFINITION).agg(F.max("pos").alias("p")).first()["p"] or 0) + 1
        asked = self.spark.createDataFrame([(pos, name, prefix)], held.schema)
        bad = index.definition_errors(held.unionByName(asked)).where(F.col("pos") == pos).first()["error"]
        if bad:
            raise InvalidArgument(bad)
        self._add("indexes", [(pos, name, prefix, kind, argument, False)], DEFINITION)
        return index.backfill_counts(self.log(), prefix, _extractor(kind, argument)).first().asDict()

    def indexes(self) -> DataFrame:
        last = F.max_by(F.struct("pos", "prefix", "kind", "argument", "dropped"), "pos")
        return self._rows("indexes", DEFINITION).groupBy("name").agg(last.alias("x")).where("not x.dropped").select("name", "x.pos", "x.prefix", "x.kind", "x.argument")

    def _definition(self, name: str):
        row = self.indexes().where(F.col("name") == name).first()
        if row is None:
            raise InvalidArgument(f"unknown index {name}")
        return row

    def drop_index(self, name: str) -> None:
        row = self._definition(name)
        self._add("indexes", [(row["pos"] + 1, name, row["prefix"], row["kind"], row["argument"], True)], DEFINITION)

    def scan_index(self, name: str, prefix: str = "") -> DataFrame:
        row = self._definition(name)
        return index.index_scan(index.build(self.log(), row["prefix"], _extractor(row["kind"], row["argument"])), prefix)

    def positions(self) -> DataFrame:
        """consumer, last_seq: the furthest that each has checkpointed."""
        return self._rows("cursors", CURSOR).groupBy("consumer").agg(F.max("last_seq").alias("last_seq"))

    def poll(self, consumer: str, limit: int) -> DataFrame:
        row = self.positions().where(F.col("consumer") == consumer).first()
        return cdc_poll(self.log(), row["last_seq"] if row else 0, limit)

    def checkpoint(self, consumer: str, seq: int) -> None:
        self._add("cursors", [(consumer, seq)], CURSOR)

    def lag(self) -> DataFrame:
        return observe.cdc_lag(self.log(), self.positions())

    def backup(self, target: str) -> str:
        """A folder of all versions so far, which ``install`` takes."""
        return store.export_snapshot(self.log(), self.last_sequence(), target)

    def install(self, snapshot: str) -> int:
        """Take a snapshot's versions as the only table; all before is retired."""
        live, _, _, edit = self._manifest()
        rows = store.install_snapshot(self.spark, snapshot)
        last = rows.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).first()["s"]
        if last < self.last_sequence():
            raise StoreError("the snapshot is older than the store")
        table = self._next_table()
        self._write_table(rows, table)
        self._edit(edit, ("create", table, None), *(("delete", t, None) for t in live), ("set_last_sequence", None, last))
        return last

    def stats(self) -> dict:
        live, flushed, mark, _ = self._manifest()
        return {"tables": len(live), "unflushed": self._unflushed(flushed).count(), "flushed_sequence": flushed, "last_sequence": self.last_sequence(), "watermark": mark}

    def begin(self) -> Transaction:
        return Transaction(self)


class Transaction:
    """Reads at the snapshot of its begin, its own writes over it; a commit fails if a key it wrote has a later version."""

    def __init__(self, of: Store):
        self.store, self.snapshot, self.writes, self.open = of, of.last_sequence(), {}, True

    def _check(self) -> None:
        if not self.open:
            raise InvalidArgument("the transaction has ended")

    def put(self, key: str, value: str) -> None:
        self._check()
        self.writes[key] = ("put", value)

    def delete(self, key: str) -> None:
        self._check()
        self.writes[key] = ("delete", None)

    def get(self, key: str) -> str | None:
        self._check()
        return self.writes[key][1] if key in self.writes else self.store.get(key, self.snapshot)

    def commit(self) -> int:
        self._check()
        self.open = False
        if not self.writes:
            return self.snapshot
        later = self.store.log().where((F.col("seq") > self.snapshot) & F.col("key").isin(*self.writes))
        if later.select("key").first():
            raise TxnConflict("a key was written after the snapshot")
        return self.store.write([(key, op, value) for key, (op, value) in self.writes.items()])

    def rollback(self) -> None:
        self._check()
        self.open = False
