"""Latency histograms, change data capture reads and recorded histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the thirteen latency buckets in microseconds.
BOUNDS = [10, 25, 50, 100, 250, 500, 1_000, 2_500, 5_000, 10_000, 25_000, 50_000, 100_000]


def bucket(value: Column) -> Column:
    """Number of the bucket, from 0; the overflow bucket is the last."""
    out = F.lit(len(BOUNDS))
    for i in reversed(range(len(BOUNDS))):
        out = F.when(value <= BOUNDS[i], i).otherwise(out)
    return out


def histogram(rows: DataFrame, by: str, value: str) -> DataFrame:
    """One row for each group and bucket, empty ones included: n, cumulative. Two partial sums; the window sees 14 rows."""
    at = bucket(F.col(value)).alias("at")
    counts = rows.groupBy(by, at).agg(F.count("*").alias("n")).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("counts"))
    full = counts.select(by, F.explode(F.sequence(F.lit(0), F.lit(len(BOUNDS)))).alias("bucket"), "counts")
    full = full.select(by, "bucket", F.coalesce(F.try_element_at("counts", F.col("bucket")), F.lit(0)).cast("long").alias("n"))
    w = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return full.withColumn("cumulative", F.sum("n").over(w))


def summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """count, sum, max and integer mean."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("top")).withColumn("mean", F.expr("total div n"))


def percentile(rows: DataFrame, by: str, value: str, percent: int) -> DataFrame:
    """The bound of the bucket that holds rank max(1, ceil(n * percent / 100)); the largest value for the overflow."""
    tops = summary(rows, by, value).select(F.col(by).alias("of"), F.col("n").alias("all"), "top")
    full = histogram(rows, by, value)
    full = full.join(tops, F.col(by).eqNullSafe(F.col("of")))
    rank = F.greatest(F.lit(1), F.expr(f"(`all` * {percent} + 99) div 100"))
    hit = full.where(F.col("cumulative") >= rank).groupBy(by).agg(F.min("bucket").alias("bucket"), F.first("top").alias("top"))
    bounds = F.array(*map(F.lit, BOUNDS))
    return hit.select(by, F.when(F.col("bucket") < len(BOUNDS), F.get(bounds, F.col("bucket")).cast("long")).otherwise(F.col("top").cast("long")).alias("p"))


def merge_histograms(parts: DataFrame) -> DataFrame:
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def cdc_events(log: DataFrame) -> DataFrame:
    """The change feed as JSON lines: (seq, line); keys and values in hexadecimal, no value for deletes."""
    line = F.to_json(F.struct(F.lit(1).alias("v"), "seq", "op", F.lower(F.hex("key")).alias("key"), F.lower(F.hex("value")).alias("value")))
    return log.select("seq", line.alias("line"))


def cdc_poll(log: DataFrame, cursor: int, limit: int) -> DataFrame:
    return log.where(F.col("seq") > cursor).orderBy("seq").limit(limit)


def cdc_lag(log: DataFrame, cursors: DataFrame) -> DataFrame:
    last = F.broadcast(log.agg(F.max("seq").alias("last")))
    return cursors.crossJoin(last).select("consumer", (F.col("last") - F.col("last_seq")).alias("lag"))


def min_position(cursors: DataFrame) -> DataFrame:
    """One row: the least durable position of a consumer, 0 without any."""
    return cursors.agg(F.coalesce(F.min("last_seq"), F.lit(0)).cast("long").alias("position"))


def cdc_position(log: DataFrame, cursor: int, limit: int) -> DataFrame:
    """One row: events that a poll gives, and the position after it; a poll of none does not move."""
    return cdc_poll(log, cursor, limit).agg(F.count("*").alias("events"), F.coalesce(F.max("seq"), F.lit(cursor)).cast("long").alias("position"))


def cdc_compacted(log: DataFrame, cutoff: int) -> DataFrame:
    """One row: events that compaction up to ``cutoff`` removes and leaves; cutoff 0 removes none."""
    return log.agg(F.count_if(F.col("seq") <= cutoff).alias("removed"), F.count_if(F.col("seq") > cutoff).alias("left"))


def cdc_compact(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events above every consumer's durable position; without consumers all stay."""
    low = F.broadcast(cursors.agg(F.coalesce(F.min("last_seq"), F.lit(0)).alias("low")))
    return log.crossJoin(low).where("seq > low").drop("low")


def sequential_violations(ops: DataFrame) -> DataFrame:
    """ops (pos, key, op, value, ok): gets whose value is not that of the last acknowledged write before them."""
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    wrote = F.when(F.col("ok") & F.col("op").isin("put", "delete"), F.struct(F.when(F.col("op") == "put", F.col("value")).alias("v")))
    rows = ops.withColumn("state", F.last(wrote, ignorenulls=True).over(w))
    return rows.where((F.col("op") == "get") & F.col("ok") & ~F.col("value").eqNullSafe(F.col("state.v"))).select("pos", "key")


def overlaps(spans: DataFrame, width: int) -> DataFrame:
    """Pairs of operations of different clients whose intervals [s, e) overlap. Each is placed in the time buckets that
    it covers, so the join is on buckets; a pair counts in the bucket of its later start only."""
    rows = spans.withColumn("b", F.explode(F.sequence(F.expr(f"s div {width}"), F.expr(f"(e - 1) div {width}"))))
    a, b = rows.select("b", *(F.col(c).alias(f"a_{c}") for c in ("id", "client", "s", "e"))), rows.select("b", *(F.col(c).alias(f"b_{c}") for c in ("id", "client", "s", "e")))
    pairs = a.join(b, "b").where((F.col("a_id") < F.col("b_id")) & (F.col("a_client") != F.col("b_client")) & (F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e")))
    return pairs.where(F.expr(f"b = greatest(a_s, b_s) div {width}")).select("a_id", "b_id")


def bank(transfers: DataFrame) -> DataFrame:
    """transfers (pos, src, dst, amount, committed): final balance change and lowest running change of each account."""
    legs = F.array(F.struct(F.col("src").alias("account"), (-F.col("amount")).alias("d")), F.struct(F.col("dst").alias("account"), F.col("amount").alias("d")))
    rows = transfers.where("committed").select("pos", F.explode(legs).alias("x")).select("pos", "x.account", "x.d")
    w = Window.partitionBy("account").orderBy("pos", "d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("running", F.sum("d").over(w))
    return rows.groupBy("account").agg(F.sum("d").alias("change"), F.min("running").alias("lowest"))


#: Operations that the search takes at most.
MAX_OPERATIONS = 14


def linearizable(ops, initial=None) -> bool | None:
    """Whether some order of the operations (start, end, op, value, result), which keeps real time, explains all; None
    if there are more than ``MAX_OPERATIONS``. A write whose result is ``error`` may have happened or not."""
    ops = [o for o in ops if not (o[2] == "get" and o[4] == "error")]
    seen: set = set()

    def search(done: int, state) -> bool:
        if done == (1 << len(ops)) - 1:
            return True
        if (done, state) in seen:
            return False
        seen.add((done, state))
        left = [o for i, o in enumerate(ops) if not done >> i & 1]
        horizon = min(o[1] for o in left)
        for i, (s, _, op, value, result) in enumerate(ops):
            if not done >> i & 1 and s <= horizon:
                if op == "get" and result != state:
                    continue
                if search(done | 1 << i, state if op == "get" else value if op == "put" else None):
                    return True
                if op != "get" and result == "error" and search(done | 1 << i, state):
                    return True
        return False

    return None if len(ops) > MAX_OPERATIONS else search(0, initial)


def minimal_counterexample(ops) -> list[int]:
    """Places of operations that no order explains, of which none can be left out; greedy, from the last one on. [] if
    an order explains all, or there are too many to tell."""
    ops, left = list(ops), list(range(len(list(ops))))
    if linearizable(ops) is not False:
        return []
    for i in reversed(range(len(ops))):
        fewer = [k for k in left if k != i]
        if linearizable([ops[k] for k in fewer]) is False:
            left = fewer
    return left


def minimal_unsatisfiable_subsets(ops, cap: int = 16) -> list[list[int]]:
    """All sets of places that no order explains, though one explains each smaller set; by size, then places; ``cap`` at
    most. A set that holds one already found is never minimal."""
    from itertools import combinations

    ops, out = list(ops), []
    for size in range(1, len(ops) + 1 if len(ops) <= MAX_OPERATIONS else 0):
        for places in combinations(range(len(ops)), size):
            if not any(set(x) <= set(places) for x in out) and linearizable([ops[k] for k in places]) is False:
                out.append(list(places))
                if len(out) == cap:
                    return out
    return out


def check_histories(ops: DataFrame) -> DataFrame:
    """ops (key, s, e, op, value, result) with (key, linearizable, counterexample): places, by start, of a least set that
    no order explains. A key of more than ``MAX_OPERATIONS`` operations has no verdict (null)."""

    def one(t):
        import pandas as pd

        rows = t.sort_values(["s", "e"]).astype(object).where(lambda x: x.notna(), None)
        rows = list(rows[["s", "e", "op", "value", "result"]].itertuples(index=False, name=None))
        return pd.DataFrame({"key": [t["key"].iloc[0]], "linearizable": pd.array([linearizable(rows)], "boolean"), "counterexample": [minimal_counterexample(rows)]})

    few = ops.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") <= MAX_OPERATIONS)
    many = ops.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MAX_OPERATIONS)
    told = ops.join(few.select("key"), "key").groupBy("key").applyInPandas(one, "key string, linearizable boolean, counterexample array<int>")
    return told.unionByName(many.select("key", F.lit(None).cast("boolean").alias("linearizable"), F.array().cast("array<int>").alias("counterexample")))


def capped_recording(ops: DataFrame, most: int) -> DataFrame:
    """ops (history, pos, client) that a recorder keeps: ``most`` in all and max(2, ceil(most / 2)) of a client. A
    client's later operations are refused whatever the total, so its own cap comes first."""
    per_client = max(2, -(-most // 2))
    own = F.row_number().over(Window.partitionBy("history", "client").orderBy("pos"))
    rows = ops.withColumn("own", own).where(F.col("own") <= per_client)
    return rows.withColumn("total", F.row_number().over(Window.partitionBy("history").orderBy("pos"))).where(F.col("total") <= most).drop("own", "total")


def realtime_order(ops: DataFrame) -> DataFrame:
    """Pairs of a key's operations (key, id, s, e) of which one ended before the other began."""
    a, b = ops.select("key", F.col("id").alias("a_id"), F.col("e").alias("a_e")), ops.select("key", F.col("id").alias("b_id"), F.col("s").alias("b_s"))
    return a.join(b, "key").where("a_e < b_s").select("key", "a_id", "b_id")


def scan_related(ops: DataFrame, scans: DataFrame) -> DataFrame:
    """Operations (id, key) on keys under the prefix of some scan (scan_id, prefix), with that scan."""
    return ops.join(F.broadcast(scans), F.col("key").startswith(F.col("prefix"))).select("scan_id", "id", "key")


def history_stats(ops: DataFrame) -> DataFrame:
    return ops.groupBy("op").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("acked"), F.countDistinct("key").alias("keys"))


def hlc_fold(messages: DataFrame, max_offset_ms: int | None = None) -> DataFrame:
    """messages (node, pos, now, remote) with the node's clock after each: the larger of wall, own and remote time, its
    logical part one up on a tie. A null remote is a tick of the node's own. With ``max_offset_ms`` a remote time further
    ahead of the wall is rejected and leaves the clock as it was. A node's rows are folded in order."""

    def one(t):
        import pandas as pd

        ms = logical = 0
        out = []
        for node, pos, now, remote in t.sort_values("pos")[["node", "pos", "now", "remote"]].astype(object).itertuples(index=False, name=None):
            remote = 0 if pd.isna(remote) else int(remote)
            remote_ms, remote_logical = remote >> 16, remote & 65535
            rejected = max_offset_ms is not None and remote_ms > now + max_offset_ms
            if not rejected:
                top = max(ms, remote_ms, now)
                same = [x for m, x in ((ms, logical), (remote_ms, remote_logical)) if m == top]
                ms, logical = top, min(max(same) + 1, 65535) if same else 0
            out.append((node, pos, ms << 16 | logical, rejected))
        return pd.DataFrame(out, columns=["node", "pos", "stamp", "rejected"])

    return messages.groupBy("node").applyInPandas(one, "node long, pos long, stamp long, rejected boolean")


def too_far_ahead(messages: DataFrame, max_offset_ms: int = 500) -> DataFrame:
    """Messages (now, remote) whose remote wall time is more than ``max_offset_ms`` ahead."""
    return messages.where(F.shiftright("remote", 16) > F.col("now") + max_offset_ms)


#: Upper bounds of the eight buckets of synchronous writes in microseconds.
FSYNC_BOUNDS = [50, 100, 250, 500, 1_000, 5_000, 10_000, 50_000]


def fsync_histogram(events: DataFrame) -> DataFrame:
    """syscall, bucket (8 is the overflow), n, total_us of probe events (syscall, latency_us)."""
    at = F.lit(len(FSYNC_BOUNDS))
    for i in reversed(range(len(FSYNC_BOUNDS))):
        at = F.when(F.col("latency_us") <= FSYNC_BOUNDS[i], i).otherwise(at)
    return events.where("latency_us is not null").groupBy("syscall", at.alias("bucket")).agg(F.count("*").alias("n"), F.sum("latency_us").alias("total_us"))


def probe_filters(events: DataFrame) -> DataFrame:
    """Probe events (kind, site) with wal, publish and durability flags."""
    kind, site = F.col("kind"), F.coalesce("site", F.lit(""))
    return events.withColumns({
        "wal": (kind == "fsync_latency") | ((kind == "usdt_marker") & (site == "wal_fsync")),
        "publish": (kind == "publish_syscall") | ((kind == "usdt_marker") & (site == "flush")),
        "durability": kind.isin("fsync_latency", "usdt_marker", "publish_syscall"),
    })


def numbered(events: DataFrame, order: str, part: str) -> DataFrame:
    """Events of each source with contiguous numbers from 1 in order of arrival."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(part).orderBy(order)).cast("long"))


def correlate(events: DataFrame, user_count: int, user_total_us: int) -> DataFrame:
    """One row that compares synchronous writes as the engine and as the kernel saw them: averages, the kernel's worst,
    their distance in percent and whether it is within 5, markers by site and phase, kinds published as first seen."""
    e = probe_filters(events)
    mark = lambda site, phase: F.count_if((F.col("kind") == "usdt_marker") & (F.col("site") == site) & (F.col("phase") == phase))
    first = e.where("kind = 'publish_syscall'").groupBy("syscall").agg(F.min("seq").alias("at"))
    kinds = first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "syscall"))), lambda x: x["syscall"]), ",").alias("kinds"))  # one row a kind
    out = e.agg(
        F.count_if("wal").alias("kernel_events"), F.coalesce(F.sum(F.when(F.col("wal"), F.col("latency_us"))), F.lit(0)).alias("total"),
        F.coalesce(F.max(F.when(F.col("wal"), F.col("latency_us"))), F.lit(0)).alias("kernel_max_us"), F.count_if(F.col("kind") == "publish_syscall").alias("published"),
        *(mark(s, p).alias(f"{s}_{p}") for s in ("wal_fsync", "flush") for p in ("enter", "exit")),
    )
    kernel, user = F.expr("total div nullif(kernel_events, 0)"), F.lit(user_total_us // user_count if user_count else None).cast("long")
    out = out.withColumns({"kernel_avg_us": kernel, "user_avg_us": user}).drop("total")
    apart = F.when(F.col("kernel_avg_us") > 0, F.abs(F.col("user_avg_us") - F.col("kernel_avg_us")) * 100 / F.col("kernel_avg_us"))
    return out.withColumn("apart_percent", apart).withColumn("agrees", F.col("apart_percent") <= 5).crossJoin(F.broadcast(kinds))


def engine_counters(calls: DataFrame) -> DataFrame:
    """calls (op, bytes, us) by op: count, bytes, total and largest latency."""
    return calls.groupBy("op").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum("us").alias("total_us"), F.max("us").alias("max_us"))


def stats_json(counters: DataFrame) -> DataFrame:
    """One JSON object of counters (op, n, ...) by op, and the lines of a text exposition."""
    rows = F.sort_array(F.collect_list(F.struct("op", "n", "bytes", "total_us", "max_us")))
    text = F.array_join(F.transform(rows, lambda x: F.format_string("verlog_%s_total %d", x["op"], x["n"])), "\n")
    return counters.agg(F.to_json(rows).alias("json"), text.alias("exposition"))  # one row an op


def span_pairs(events: DataFrame) -> DataFrame:
    """Spans of markers (site, seq, phase, duration_us): an exit ends the enter right before it on its site; a second enter
    replaces the first, an exit without an enter is left out."""
    w = Window.partitionBy("site").orderBy("seq")
    rows = events.withColumns({"from_seq": F.lag("seq").over(w), "from_phase": F.lag("phase").over(w)})
    return rows.where("phase = 'exit' and from_phase = 'enter'").select("site", "from_seq", F.col("seq").alias("to_seq"), "duration_us")


def throughput(runs: DataFrame) -> DataFrame:
    """runs (name, ops, ns) with whole operations per second."""
    return runs.withColumn("per_second", F.expr("ops * 1000000000 div nullif(ns, 0)"))


def counter_deltas(samples: DataFrame) -> DataFrame:
    """samples (source, pos, total): growth since the sample before, never below 0."""
    w = Window.partitionBy("source").orderBy("pos")
    return samples.select("source", "pos", F.greatest(F.col("total") - F.lag("total", 1, 0).over(w), F.lit(0)).alias("delta"))


def tally(ops: DataFrame) -> DataFrame:
    """Operations of each key by kind."""
    return ops.groupBy("key", "op").agg(F.count("*").alias("n"))


def bank_total(transfers: DataFrame, accounts: int, initial: int) -> DataFrame:
    """One row: the money in all accounts after the committed transfers, and whether it is what it was at first."""
    change = bank(transfers).agg(F.coalesce(F.sum("change"), F.lit(0)).alias("d"))
    total = (F.lit(accounts * initial) + F.col("d")).cast("long")
    return change.select(F.lit(accounts).alias("accounts"), total.alias("total"), (F.col("d") == 0).alias("constant"))
