"""Range tables (start, end, range_id, epoch, group_id; '' ends nothing), access rules, transactions and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a configuration table at most.
MAX_RULES = 10_000


def build_ranges(ranges: DataFrame) -> DataFrame:
    """ranges (start, end, range_id, epoch, group_id) by start: ids that are 0 are given out in that order, each one above
    all ids before it, an epoch of 0 becomes 1. A range table is configuration, one row a range."""
    w = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    given = F.when(F.col("range_id") > 0, F.col("range_id")).otherwise(0)
    rows = ranges.withColumns({"rn": F.row_number().over(Window.orderBy("start")), "new": (F.col("range_id") == 0).cast("long")}).withColumn("fresh", F.sum("new").over(w))
    # the next id is the largest of: those given out so far plus one; a given id plus one plus those given out since
    lead = F.max(F.when(F.col("range_id") > 0, given - F.col("fresh"))).over(w)
    rows = rows.withColumn("range_id", F.when(F.col("range_id") > 0, F.col("range_id")).otherwise(F.greatest(F.coalesce(lead, F.lit(0)), F.lit(0)) + F.col("fresh")))
    return rows.select("start", "end", "range_id", F.greatest("epoch", F.lit(1)).alias("epoch"), "group_id")


def ranges_per_leader(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """nodes (leader) with the number and ids of the ranges (range_id, leader) they lead; ranges of no node are left out."""
    held = ranges.where("leader is not null").groupBy("leader").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("range_id")).alias("ids"))
    return nodes.join(held, "leader", "left").select("leader", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("ids"))


def stale(requests: DataFrame, meta_epoch: int) -> DataFrame:
    """requests (client_epoch) that must be answered with the new range table."""
    return requests.where(F.col("client_epoch") < meta_epoch)


def apply_epochs(entries: DataFrame) -> DataFrame:
    """Outcome of range table entries (pos, base_epoch, epoch, snapshot), of a log as short as configuration: one on the
    epoch in force is applied, one that repeats the table in force changes nothing, any other is stale."""

    def fold(t):
        import pandas as pd

        now, held, out = 0, None, []
        for e in t.sort_values("pos").itertuples():
            if e.base_epoch == now:
                now, held, outcome = e.epoch, e.snapshot, "applied"
            else:
                outcome = "repeated" if e.snapshot == held else "stale"
            out.append((e.pos, outcome, now))
        return pd.DataFrame(out, columns=["pos", "outcome", "in_force"])

    return entries.select("pos", "base_epoch", "epoch", "snapshot", F.lit(1).alias("whole")).groupBy("whole").applyInPandas(fold, "pos long, outcome string, in_force long")


def lookup(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """Keys with their range and group (0 if none). A range table is of bounded size (one row a group of nodes)."""
    r = F.broadcast(ranges.select("start", "end", "range_id", "group_id"))
    on = (F.col("key") >= F.col("start")) & ((F.col("end") == "") | (F.col("key") < F.col("end")))
    return keys.join(r, on, "left").select(*keys.columns, "range_id", F.coalesce("group_id", F.lit(0)).alias("group_id"))


def split(ranges: DataFrame, at: str, new_id: int, new_group: int) -> DataFrame:
    """Cut the range that holds ``at`` strictly inside: the left part keeps its id, the right one is new."""
    hit = (F.col("start") < at) & ((F.col("end") == "") | (F.col("end") > at))
    left = F.struct("start", F.lit(at).alias("end"), "range_id", (F.col("epoch") + 1).alias("epoch"), "group_id")
    right = F.struct(F.lit(at).alias("start"), "end", F.lit(new_id).cast("long").alias("range_id"), F.lit(1).cast("long").alias("epoch"), F.lit(new_group).cast("long").alias("group_id"))
    same = F.struct("start", "end", "range_id", "epoch", "group_id")
    return ranges.select(F.explode(F.when(hit, F.array(left, right)).otherwise(F.array(same))).alias("x")).select("x.*")


def merge_next(ranges: DataFrame, start: str) -> DataFrame:
    """Join a range with its right neighbour: the epoch is one above both, the left id stays."""
    w = Window.orderBy("start")  # a range table is small
    rows = ranges.withColumns({"n_end": F.lead("end").over(w), "n_epoch": F.lead("epoch").over(w), "p_start": F.lag("start").over(w)})
    joins = (F.col("start") == start) & F.col("n_end").isNotNull()
    rows = rows.where(~(F.col("p_start").eqNullSafe(F.lit(start)))).withColumns({"end": F.when(joins, F.col("n_end")).otherwise(F.col("end")), "epoch": F.when(joins, F.greatest("epoch", "n_epoch") + 1).otherwise(F.col("epoch"))})
    return rows.select("start", "end", "range_id", "epoch", "group_id")


def move(ranges: DataFrame, start: str, group: int) -> DataFrame:
    hit = (F.col("start") == start) & (F.col("group_id") != group)
    return ranges.withColumns({"epoch": F.when(hit, F.col("epoch") + 1).otherwise(F.col("epoch")), "group_id": F.when(hit, F.lit(group).cast("long")).otherwise(F.col("group_id"))}).select("start", "end", "range_id", "epoch", "group_id")


def overlapping(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """A client's cache after new descriptors: those of an equal id or an overlap go."""
    f = F.broadcast(fresh.select(F.col("start").alias("fs"), F.col("end").alias("fe"), F.col("range_id").alias("fid")))
    clash = (F.col("range_id") == F.col("fid")) | (((F.col("fe") == "") | (F.col("start") < F.col("fe"))) & ((F.col("end") == "") | (F.col("fs") < F.col("end"))))
    return cached.join(f, clash, "left_anti").unionByName(fresh)


def orphan_groups(hosted: DataFrame, ranges: DataFrame, next_id: int) -> DataFrame:
    return hosted.where((F.col("group_id") != 0) & (F.col("group_id") < next_id)).join(ranges.select("group_id").distinct(), "group_id", "left_anti")


def uncovered(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """Keys that do not have exactly one owner, with their number of owners."""
    return lookup(keys.distinct(), ranges).groupBy("key").agg(F.count("range_id").alias("owners")).where("owners <> 1")


def rebalance(nodes: dict[str, list[int]]) -> list[tuple[int, str, str]]:
    """Moves (range, from, to) that even out range counts: always the richest node's highest range to the poorest node;
    of equally rich nodes the last name gives, of equally poor ones the first takes."""
    held, moves = {n: sorted(r) for n, r in nodes.items()}, []
    while held:
        rich = max(held, key=lambda n: (len(held[n]), n))
        poor = min(held, key=lambda n: (len(held[n]), n))
        if len(held[rich]) - len(held[poor]) <= 1:
            break
        r = held[rich].pop()
        held[poor] = sorted([*held[poor], r])
        moves.append((r, rich, poor))
    return moves


def _rules(table: DataFrame, *columns: str) -> DataFrame:
    """A configuration table as one row: an array, longest prefix first. Refused above ``MAX_RULES``, which bounds what
    is broadcast and looked through for each request."""
    if (n := table.count()) > MAX_RULES:
        raise ValueError(f"{n} rules; at most {MAX_RULES}")
    return F.broadcast(table.agg(F.sort_array(F.collect_list(F.struct((-F.octet_length("prefix")).alias("size"), *columns))).alias("rules")))


def authorize(requests: DataFrame, acl: DataFrame) -> DataFrame:
    """requests (key, token) with ``allowed``: the longest matching prefix decides alone; no match denies. Each row is
    judged by itself, without a shuffle, so repeated requests keep their rows."""
    hit = F.filter("rules", lambda r: F.col("key").startswith(r["prefix"]))
    right = F.get(hit, F.lit(0))["token"]
    return requests.crossJoin(_rules(acl, "prefix", "token")).select(*requests.columns, F.coalesce(right == F.col("token"), F.lit(False)).alias("allowed"))


def gate(requests: DataFrame, acl: DataFrame, tenants: DataFrame) -> DataFrame:
    """requests (key, token) with ``verdict``: both layers must pass, and the tenant's is told first."""
    own = F.exists("rules", lambda r: (r["token"] == F.col("token")) & F.col("key").startswith(r["prefix"]))
    rows = requests.crossJoin(_rules(tenants, "prefix", "token")).select(*requests.columns, F.coalesce(own, F.lit(False)).alias("tenant_ok"))
    rows = authorize(rows, acl)
    return rows.select(*requests.columns, F.when(~F.col("tenant_ok"), "tenant denied").when(~F.col("allowed"), "acl denied").otherwise("allowed").alias("verdict"))


def keyless(requests: DataFrame, acl: DataFrame, tenants: DataFrame) -> DataFrame:
    """requests (token) whose token some tenant has and some rule: calls that name no key."""
    return requests.join(acl.select("token").distinct(), "token", "left_semi").join(tenants.select("token").distinct(), "token", "left_semi")


def parse_prefix(literal: Column) -> Column:
    """A prefix as written in a configuration: 0x.. or hex:.. are hexadecimal (null if they are not), all else is text."""
    low = F.lower(literal)
    digits = F.when(low.startswith("0x"), F.substring(low, 3, 1 << 30)).when(low.startswith("hex:"), F.substring(low, 5, 1 << 30))
    good = (F.length(digits) % 2 == 0) & digits.rlike("^[0-9a-f]*$")
    return F.when(digits.isNull(), literal.cast("binary")).when(good, F.unhex(digits))


def tenant_filter(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """Requests whose token's tenant owns the key's prefix."""
    return requests.join(F.broadcast(tenants.select("token", "prefix", "tenant")), "token").where(F.col("key").startswith(F.col("prefix"))).drop("prefix")


def clashing_prefixes(tenants: DataFrame) -> DataFrame:
    a, b = tenants.select(F.col("tenant").alias("a"), F.col("prefix").alias("pa")), tenants.select(F.col("tenant").alias("b"), F.col("prefix").alias("pb"))
    return a.join(F.broadcast(b), (F.col("a") < F.col("b")) & (F.col("pa").startswith(F.col("pb")) | F.col("pb").startswith(F.col("pa")))).select("a", "b")


def snapshot_reads(reads: DataFrame, log: DataFrame) -> DataFrame:
    """As-of join: reads (txn, key, snapshot) with the newest version at their snapshot; null for none or a tombstone.

    Reads and versions of a key are sorted together once, so a key of many versions costs no product. Of versions of one
    seq the greatest (op, value) is taken."""
    v = log.where("seq is not null and key is not null").select("key", F.col("seq").alias("at"), F.lit(0).alias("is_read"), F.lit(None).cast(reads.schema["txn"].dataType).alias("txn"), F.lit(None).cast(reads.schema["snapshot"].dataType).alias("snapshot"), F.struct("op", "value").alias("x"))
    r = reads.select("key", F.col("snapshot").alias("at"), F.lit(1).alias("is_read"), "txn", "snapshot", F.lit(None).cast(v.schema["x"].dataType).alias("x"))
    so_far = Window.partitionBy("key").orderBy("at", "is_read", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return v.unionByName(r).withColumn("x", F.last("x", ignorenulls=True).over(so_far)).where("is_read = 1").select("txn", "key", "snapshot", F.col("x.value").alias("value"))


def write_conflicts(writes: DataFrame, log: DataFrame) -> DataFrame:
    """Writes (txn, key, snapshot) for which a later version is committed: the last one of the key tells."""
    last = log.groupBy(F.col("key").alias("k")).agg(F.max("seq").alias("s"))
    return writes.join(last, (F.col("key") == F.col("k")) & (F.col("s") > F.col("snapshot")), "left_semi")


def recover_2pc(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records (txn, state) with their outcome: a decision wins; Preparing aborts; Prepared waits; Committing finishes."""
    rows = records.join(decisions, "txn", "left")
    outcome = F.when(F.col("state") == 3, "committed").when(F.col("state") == 4, "aborted").when(F.col("state") == 5, "committed")
    outcome = outcome.when(F.col("decision").isNotNull(), F.when(F.col("decision"), "committed").otherwise("aborted")).when(F.col("state") == 1, "aborted").otherwise("in_doubt")
    return rows.select("txn", "state", outcome.alias("outcome"))


def in_doubt(records: DataFrame, decisions: DataFrame) -> DataFrame:
    return records.where("state = 2").join(decisions, "txn", "left_anti").select("txn")


def coordinators(mutations: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each transaction the group of its smallest key, and its number of groups."""
    return lookup(mutations, ranges).groupBy("txn").agg(F.min_by("group_id", "key").alias("coordinator"), F.countDistinct("group_id").alias("groups"))


def commit_quorum(votes: DataFrame) -> DataFrame:
    """votes (entry, config, matched): an entry commits when each of its configurations has half of its voters, rounded up."""
    per = votes.groupBy("entry", "config").agg((F.sum(F.col("matched").cast("int")) >= F.ceil(F.count("*") / 2)).alias("ok"))
    return per.groupBy("entry").agg(F.bool_and("ok").alias("committed"))


def unsafe_terms(leaders: DataFrame) -> DataFrame:
    return leaders.groupBy("term").agg(F.countDistinct("leader").alias("leaders")).where("leaders > 1")


def diverged(states: DataFrame) -> DataFrame:
    """states (node, applied, key, value): keys on which nodes at the highest applied index differ."""
    top = F.broadcast(states.agg(F.max("applied").alias("applied")))
    rows = states.join(top, "applied")
    nodes = F.broadcast(rows.agg(F.countDistinct("node").alias("nodes")))
    per = rows.groupBy("key").agg(F.countDistinct("node").alias("have"), F.countDistinct("value").alias("values"))
    return per.crossJoin(nodes).where("have < nodes or values > 1").select("key")


def elected(votes: DataFrame, voters: int) -> DataFrame:
    """votes (term, voter, granted): a term is won by more than half of its voters; a voter counts once."""
    per = votes.groupBy("term").agg(F.countDistinct(F.when(F.col("granted"), F.col("voter"))).alias("votes"))
    return per.withColumn("elected", F.col("votes") > voters // 2)
