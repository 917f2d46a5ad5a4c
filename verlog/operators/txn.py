"""Transactions: replay of an ordered event log under snapshot isolation, and the two-phase commit record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replay(events: DataFrame) -> DataFrame:
    """Outcome of each event (shard, pos, txn, kind, key, value) of shards that keep their own order of events.

    begin takes the shard's last sequence as snapshot; put and delete stage an intent, which fails with ``conflict`` on
    another transaction's live intent or on a version committed after the snapshot; get reads the own intent first, then
    the snapshot; commit checks all keys again, then writes them in key order, one sequence each; a commit that fails
    leaves the transaction open with its intents; rollback drops them; an unknown or finished transaction is
    ``unknown``. A shard's events are folded in order: state depends on all before it, so a shard is the unit of scale."""

    def fold(t):
        import pandas as pd

        seq, snapshots, keys, intents, versions, out = 0, {}, {}, {}, {}, []
        for e in t.sort_values("pos").itertuples():
            txn, result, value = e.txn, "ok", None
            clash = lambda k: intents.get(k, (txn,))[0] != txn or any(s > snapshots[txn] for s, _ in versions.get(k, [])[-1:])  # noqa: B023, E731
            if e.kind == "begin":
                snapshots[txn], keys[txn] = seq, set()
            elif txn not in snapshots:
                result = "unknown"
            elif e.kind in ("put", "delete"):
                if clash(e.key):
                    result = "conflict"
                else:
                    intents[e.key] = txn, e.value if e.kind == "put" else None
                    keys[txn].add(e.key)
            elif e.kind == "get":
                own = intents.get(e.key, (None,))
                value = own[1] if own[0] == txn else next((v for s, v in reversed(versions.get(e.key, [])) if s <= snapshots[txn]), None)
            elif e.kind == "commit" and any(map(clash, keys[txn])):
                result = "conflict"
            else:
                for k in sorted(keys.pop(txn)):
                    _, v = intents.pop(k)
                    if e.kind == "commit":
                        seq += 1
                        versions.setdefault(k, []).append((seq, v))
                del snapshots[txn]
            out.append((e.shard, e.pos, txn, e.kind, result, value, seq))
        return pd.DataFrame(out, columns=["shard", "pos", "txn", "kind", "result", "value", "last_seq"])

    return events.groupBy("shard").applyInPandas(fold, "shard long, pos long, txn long, kind string, result string, value string, last_seq long")


def replay_2pc(events: DataFrame) -> DataFrame:
    """State of each transaction's record after its events (pos, txn, kind): prepare, commit, abort, decide_commit,
    decide_abort. Each transaction is folded alone, in the row.

    A commit of an aborted record and an abort of a committed one are errors; repeated ones change nothing; a decision
    never flips (an error) and settles a prepared record, no other."""
    steps = events.groupBy("txn").agg(F.sort_array(F.collect_list(F.struct("pos", "kind"))).alias("steps"))
    zero = F.struct(F.lit("none").alias("state"), F.lit(None).cast("string").alias("decision"), F.lit(0).cast("long").alias("errors"))

    def step(s: Column, x: Column) -> Column:
        kind, state, told = x["kind"], s["state"], s["decision"]
        wants = F.when(kind.isin("commit", "decide_commit"), "committed").when(kind.isin("abort", "decide_abort"), "aborted")
        decides = kind.startswith("decide_")
        flips = decides & told.isNotNull() & (told != wants)
        wrong = ~decides & wants.isNotNull() & state.isin("committed", "aborted") & (state != wants)
        to = F.when(kind == "prepare", F.lit("prepared")).when(flips | wrong, state).when(decides & (state != "prepared"), state).otherwise(wants)
        return F.struct(to.alias("state"), F.when(decides & told.isNull(), wants).otherwise(told).alias("decision"), (s["errors"] + (flips | wrong).cast("long")).alias("errors"))

    return steps.select("txn", F.aggregate("steps", zero, step).alias("x")).select("txn", "x.state", "x.decision", "x.errors")


def decision_flips(decisions: DataFrame) -> DataFrame:
    """decisions (pos, txn, decision) that contradict the first one of their transaction."""
    first = F.first("decision").over(Window.partitionBy("txn").orderBy("pos"))
    return decisions.withColumn("first", first).where("decision <> first").select("pos", "txn")


def cross_group_outcome(votes: DataFrame) -> DataFrame:
    """votes (txn, group_id, prepared): all groups prepared commit, else all abort."""
    return votes.groupBy("txn").agg(F.bool_and(F.coalesce("prepared", F.lit(False))).alias("committed"), F.count("*").alias("groups"))


def orphan_aborts(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """The abort decisions that settle prepared records (txn, state 2) which nobody has decided."""
    return records.where("state = 2").join(decisions, "txn", "left_anti").select("txn", F.lit(False).alias("decision"))
