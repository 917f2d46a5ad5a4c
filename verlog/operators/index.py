"""Secondary indexes: (secondary, primary) entries derived from the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .log import scan


def build(log: DataFrame, prefix: str, extract) -> DataFrame:
    rows = scan(log, prefix=prefix)
    return rows.select(extract(F.col("value")).alias("secondary"), F.col("key").alias("primary")).where("secondary is not null")


def index_scan(entries: DataFrame, prefix: str) -> DataFrame:
    """Entries under a secondary prefix; their order is that of the joined key."""
    return entries.where(F.col("secondary").startswith(prefix)).orderBy(F.concat("secondary", "primary"))


def delta(log: DataFrame, extract) -> DataFrame:
    """What each write adds to and removes from the index: (seq, change, secondary, primary)."""
    w = Window.partitionBy("key").orderBy("seq")
    rows = log.withColumn("new", F.when(F.col("op") == "put", extract(F.col("value")))).withColumn("old", F.lag("new").over(w))
    rows = rows.where(~F.col("new").eqNullSafe(F.col("old")))
    both = F.array(F.struct(F.lit("remove").alias("change"), F.col("old").alias("secondary")), F.struct(F.lit("add").alias("change"), F.col("new").alias("secondary")))
    return rows.select("seq", F.col("key").alias("primary"), F.explode(both).alias("x")).select("seq", "x.change", "x.secondary", "primary").where("secondary is not null")


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """missing and extra entries."""
    on = ["secondary", "primary"]
    both = expected.distinct().withColumn("e", F.lit(1)).join(actual.distinct().withColumn("a", F.lit(1)), on, "full_outer")
    return both.where("e is null or a is null").select(F.when(F.col("a").isNull(), "missing").otherwise("extra").alias("divergence"), *on)


def backfill_page(log: DataFrame, prefix: str, extract, after: str, batch: int) -> DataFrame:
    """The next ``batch`` live keys after a cursor, with their entries (null where the extractor finds none)."""
    rows = scan(log.where(F.col("key") > after), prefix=prefix).orderBy("key").limit(batch)
    return rows.select("key", extract(F.col("value")).alias("secondary"))


def backfill_steps(log: DataFrame, prefix: str, extract, batch: int) -> DataFrame:
    """The whole of a backfill in steps of ``batch`` live keys: step, scanned, indexed, last_key, complete. Only a step
    that runs out is complete, so an exact multiple takes an empty step more. Keys are numbered by range partitions, so
    no task sorts them all."""
    rows = scan(log, prefix=prefix).select("key", extract(F.col("value")).alias("secondary"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key").select("key", "secondary", F.monotonically_increasing_id().alias("id"))
    rows = rows.select("key", "secondary", F.shiftright("id", 33).alias("part"), (F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rn"))
    before = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))  # one row a partition
    rows = rows.join(F.broadcast(before), "part").withColumn("step", F.expr(f"(before + rn - 1) div {batch}"))
    steps = rows.groupBy("step").agg(F.count("*").alias("scanned"), F.count("secondary").alias("indexed"), F.max("key").alias("last_key"))
    steps = steps.withColumn("complete", F.col("scanned") < batch)
    full = steps.agg(F.count_if("complete").alias("done"), F.count("*").alias("step")).where("done = 0")
    return steps.unionByName(full.select("step", F.lit(0).cast("long").alias("scanned"), F.lit(0).cast("long").alias("indexed"), F.lit(None).cast("string").alias("last_key"), F.lit(True).alias("complete")))


def backfill_counts(log: DataFrame, prefix: str, extract) -> DataFrame:
    """One row: live keys scanned, and those that the extractor finds something in."""
    return scan(log, prefix=prefix).agg(F.count("*").alias("scanned"), F.count(extract(F.col("value"))).alias("indexed"))


def definition_errors(definitions: DataFrame) -> DataFrame:
    """definitions (pos, name, prefix) with ``error``, null for those that may be created: a name of 1 to 64 letters,
    digits, _ or -, a prefix, and no earlier definition of that name."""
    again = F.row_number().over(Window.partitionBy("name").orderBy("pos")) > 1
    bad = F.when(~F.coalesce(F.col("name"), F.lit("")).rlike("^[A-Za-z0-9_-]{1,64}$"), "bad name").when(F.coalesce(F.octet_length("prefix"), F.lit(0)) == 0, "empty prefix").when(again, "duplicate")
    return definitions.withColumn("error", bad)


def field(delimiter: str, i: int):
    from ..functions.keys import extract_field

    return lambda v: extract_field(v, delimiter, i)


def head(n: int):
    return lambda v: F.substring(v, 1, n)


def whole(v: Column) -> Column:
    return v
