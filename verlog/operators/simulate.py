"""Recorded runs checked against the state that their writes make, and seeded generators of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, part: list[str], order: str, sums: list[str], block: int = 4096) -> DataFrame:
    """``rows`` with each column of ``sums`` summed over the rows of its part up to this place. Parts are cut into blocks
    of ``block`` places: a window over block totals gives what came before, one within the block the rest, so a part of
    any size is spread over tasks."""
    rows = rows.withColumn("__block", F.floor(F.col(order) / block))
    totals = rows.groupBy(*part, "__block").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    earlier = Window.partitionBy(*part).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*part, "__block", *(F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in sums))
    within = Window.partitionBy(*part, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumns({c: F.sum(c).over(within) for c in sums})
    return inner.join(totals, [*part, "__block"]).withColumns({c: F.col(c) + F.col(f"__{c}") for c in sums}).drop("__block", *(f"__{c}" for c in sums))


def print_of(key: Column, value: Column) -> Column:
    """A pair's part of a set's fingerprint; the fingerprint is the sum, whatever the order."""
    return F.xxhash64(key, F.lit("\x00"), value).cast("decimal(38,0)")


def scans_as_of(writes: DataFrame, scans: DataFrame) -> DataFrame:
    """scans (pos, prefix) with n and print of the live pairs under the prefix by writes (pos, key, value, null for a
    delete) before them. A write changes the sums of each prefix length that scans use; a scan reads the running sums, so
    the work is writes times lengths plus scans, never writes times scans."""
    w = Window.partitionBy("key").orderBy("pos")
    steps = writes.withColumns({"was": F.lag("value").over(w)})
    pair = lambda v, sign: F.when(v.isNotNull(), sign * print_of(F.col("key"), v)).otherwise(F.lit(0).cast("decimal(38,0)"))
    steps = steps.select("pos", "key", (F.col("value").isNotNull().cast("long") - F.col("was").isNotNull().cast("long")).alias("n"), (pair(F.col("value"), F.lit(1)) + pair(F.col("was"), F.lit(-1))).cast("decimal(38,0)").alias("print"))
    lengths = scans.agg(F.collect_set(F.length("prefix")).alias("lengths"))  # as many as a key has characters, at most
    steps = steps.crossJoin(F.broadcast(lengths)).select("pos", F.explode(F.filter("lengths", lambda x: x <= F.length("key"))).alias("len"), "key", "n", "print")
    steps = steps.select(F.expr("substring(key, 1, len)").alias("prefix"), (F.col("pos") * 2 + 1).alias("at"), "n", "print")
    wanted = scans.select("prefix").distinct()
    steps = steps.join(wanted, "prefix", "left_semi")
    asks = scans.select("prefix", (F.col("pos") * 2).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("print"))
    both = running(steps.unionByName(asks), ["prefix"], "at", ["n", "print"])
    told = both.where("at % 2 = 0").select((F.col("at") / 2).cast("long").alias("pos"), "prefix", F.col("n").cast("long").alias("n"), "print")
    return scans.join(told, ["pos", "prefix"])


def _acked_writes(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("ok") & F.col("op").isin("put", "delete")).select("pos", "key", F.when(F.col("op") == "put", F.col("value")).alias("value"))


def scan_violations(ops: DataFrame) -> DataFrame:
    """ops (pos, op, key, value, prefix, observed array of (key, value), ok): scans whose pairs are not, in order of key,
    those of the acknowledged writes before them; scans in error tell nothing. Sets are compared by count and fingerprint.
    (pos, prefix, expected, observed) as counts."""
    scans = ops.where((F.col("op") == "scan") & F.col("ok")).select("pos", "prefix", "observed")
    zero = F.lit(0).cast("decimal(38,0)")
    seen = F.aggregate("observed", zero, lambda a, x: (a + print_of(x["key"], x["value"])).cast("decimal(38,0)"))
    keys = F.transform("observed", lambda x: x["key"])
    scans = scans.withColumns({"seen": seen, "in_order": keys == F.array_sort(keys)})
    rows = scans_as_of(_acked_writes(ops), scans)
    good = F.col("in_order") & (F.col("n") == F.size("observed")) & (F.col("print") == F.col("seen"))
    return rows.where(~good).select("pos", "prefix", F.col("n").alias("expected"), F.size("observed").cast("long").alias("observed"))


def replay_divergence(trace: DataFrame) -> DataFrame:
    """Trace events (eid, kind op | op_result, oid, cmd, key, val, prefix, count): results that a replay of the operations
    does not give, as (oid, cmd, expected, actual) in text. Only a result that comes before the next operation counts;
    oids are numbered without gaps. Flushes, compactions and restarts keep the state."""
    ops, results = trace.where("kind = 'op'"), trace.where("kind = 'op_result'")
    writes = ops.where(F.col("cmd").isin("put", "delete")).select(F.col("eid").alias("pos"), "key", F.when(F.col("cmd") == "put", F.col("val")).alias("value"))
    due = ops.select((F.col("oid") - 1).alias("oid"), F.col("eid").alias("next_eid"))
    results = results.join(due, "oid", "left").where("next_eid is null or eid < next_eid").select("oid", F.col("val").alias("said"), F.col("count").alias("said_count"))
    gets = ops.where("cmd = 'get'").select("oid", F.col("eid").alias("pos"), "key")
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    wrote = writes.select("pos", "key", F.struct("value").alias("w"), F.lit(None).cast("long").alias("oid"))
    read = wrote.unionByName(gets.select("pos", "key", F.lit(None).cast(wrote.schema["w"].dataType).alias("w"), "oid"))
    read = read.withColumn("state", F.last("w", ignorenulls=True).over(w)).where("oid is not null").select("oid", F.col("state.value").alias("actual"))
    bad = read.join(results, "oid").where(~F.col("actual").eqNullSafe(F.col("said"))).select("oid", F.lit("get").alias("cmd"), F.col("said").alias("expected"), "actual")
    scans = scans_as_of(writes, ops.where("cmd = 'scan'").select("oid", F.col("eid").alias("pos"), "prefix"))
    wrong = scans.join(results, "oid").where("n <> said_count").select("oid", F.lit("scan").alias("cmd"), F.col("said_count").cast("string").alias("expected"), F.col("n").cast("string").alias("actual"))
    return bad.unionByName(wrong)


def invariants(writes: DataFrame, seen: DataFrame, scanned: DataFrame) -> DataFrame:
    """What an engine showed against what writes (pos, key, value, null for a delete) say, by invariant: checked, violated.

    seen (pos, key, value, at): ENG-003 of a read right after a delete of its key, ENG-001 of a read after a restart
    (``at`` is ``restart``), MVCC-001 of one at a snapshot (``snapshot``, whose pos is its timestamp, inclusive), else
    ENG-002. scanned (pos, prefix, n, print), print as by ``print_of``: ENG-004."""
    state = writes.select("key", (F.col("pos") * 2).alias("order"), F.struct("pos", "value").alias("w"))
    asked = seen.select("key", (F.col("pos") * 2 + 1).alias("order"), "at", "value", F.col("pos").alias("asked"))
    w = Window.partitionBy("key").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    rows = state.unionByName(asked, allowMissingColumns=True).withColumn("state", F.last("w", ignorenulls=True).over(w)).where("asked is not null")
    deleted = F.coalesce((F.col("state.pos") == F.col("asked")) & F.col("state.value").isNull(), F.lit(False))
    which = F.when(F.col("at") == "restart", "ENG-001").when(F.col("at") == "snapshot", "MVCC-001").when(deleted, "ENG-003").otherwise("ENG-002")
    reads = rows.select(which.alias("invariant"), (~F.col("value").eqNullSafe(F.col("state.value"))).alias("bad"))
    expected = scans_as_of(writes, scanned.select("pos", "prefix", F.col("n").alias("said"), F.col("print").alias("said_print")))
    scans = expected.select(F.lit("ENG-004").alias("invariant"), ((F.col("n") != F.col("said")) | (F.col("print") != F.col("said_print"))).alias("bad"))
    return reads.unionByName(scans).groupBy("invariant").agg(F.count("*").alias("checked"), F.count_if("bad").alias("violated"))


#: Operations of a run and their weights; the state of a generator whose seed is 0.
COMMANDS = ["put", "get", "delete", "scan", "flush", "compact", "crash_restart"]
WEIGHTS = [45, 30, 10, 8, 3, 2, 2]
ZERO_SEED = 0xCAFEBABEDEADBEEF
WORD = (1 << 64) - 1


def draws(seed: int):
    """The xorshift64 sequence (shifts 13, 7, 17) of a seed."""
    state = seed & WORD or ZERO_SEED
    while True:
        for shift in (13, -7, 17):
            state ^= state << shift & WORD if shift > 0 else state >> -shift
        yield state


def generate(seeds: DataFrame, n: int, keyspace: int = 16, most_bytes: int = 16, weights: list[int] | None = None) -> DataFrame:
    """Runs of ``n`` operations, one for each row of seeds (seed): (seed, oid, cmd, key, val, prefix), values in
    hexadecimal. A run's draws depend on each other, runs do not: each is made in one go, within its own batch."""
    from bisect import bisect_right
    from itertools import accumulate

    bounds = list(accumulate(weights or WEIGHTS))

    def make(batches):
        import pandas as pd

        for batch in batches:
            for seed in batch["seed"]:
                rng, out = draws(int(seed)), []
                for oid in range(1, n + 1):
                    cmd = COMMANDS[bisect_right(bounds, next(rng) % bounds[-1])]
                    key = f"key:{next(rng) % keyspace:04x}" if cmd in ("put", "get", "delete") else None
                    val = bytes(next(rng) & 255 for _ in range(1 + next(rng) % most_bytes)).hex() if cmd == "put" else None
                    out.append((seed, oid, cmd, key, val, "key:" if cmd == "scan" else None))
                yield pd.DataFrame(out, columns=["seed", "oid", "cmd", "key", "val", "prefix"])

    return seeds.select("seed").mapInPandas(make, "seed long, oid long, cmd string, key string, val string, prefix string")


#: The odd number that spreads a seed, and the multiplier of the linear congruential sequence.
SPREAD, MULTIPLIER = 0x9E3779B97F4A7C15, 6364136223846793005


def seeded_fsyncs(seeds: DataFrame, n: int) -> DataFrame:
    """``n`` probe events of synchronous writes for each row of seeds (seed): (seed, seq, syscall, latency_us). Two steps
    of the sequence make an event, the second its time, which is left out."""

    def make(batches):
        import pandas as pd

        for batch in batches:
            for seed in batch["seed"]:
                state, out = int(seed) * SPREAD & WORD, []
                for seq in range(1, n + 1):
                    state = (state * MULTIPLIER + 1) & WORD
                    out.append((seed, seq, "fdatasync" if state & 1 else "fsync", 50 + state % 900))
                    state = (state * MULTIPLIER + 1) & WORD
                yield pd.DataFrame(out, columns=["seed", "seq", "syscall", "latency_us"])

    return seeds.select("seed").mapInPandas(make, "seed long, seq long, syscall string, latency_us long")


WORKLOADS = ["register", "counter", "set", "map", "bank"]


def workload(ticks: DataFrame, kind: str, keys: int = 5) -> DataFrame:
    """Operations of a workload for ticks (pos): (pos, op, key, value). register: writes and reads of one key; counter:
    steps of one key; set: new members and scans; map: writes, reads and deletes of ``keys`` keys; bank: transfers between
    two accounts, the amount as value."""
    pos, turn = F.col("pos"), F.col("pos") % 4
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    op, key, value = {
        "register": (F.when(turn < 2, "put").otherwise("get"), F.lit("register"), F.when(turn < 2, text(pos))),
        "counter": (F.when(turn < 3, "add").otherwise("get"), F.lit("counter"), F.when(turn < 3, "1")),
        "set": (F.when(turn < 3, "put").otherwise("scan"), F.when(turn < 3, F.concat(F.lit("set:"), text(pos))).otherwise("set:"), F.when(turn < 3, "1")),
        "map": (F.when(turn < 2, "put").when(turn == 2, "get").otherwise("delete"), F.concat(F.lit("map:"), text(pos * 7 % keys)), F.when(turn < 2, text(pos))),
        "bank": (F.lit("transfer"), F.concat(F.lit("account:"), text(pos % keys), F.lit(">account:"), text((pos + 1 + pos % (keys - 1)) % keys)), text(1 + pos % 10)),
    }[kind]
    return ticks.select("pos", op.alias("op"), key.alias("key"), F.coalesce(value, none).alias("value"))
