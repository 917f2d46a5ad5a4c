"""A cluster's members, its pages for operators, and the control of online backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def member_changes(members: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (change, cluster, kind add | remove | promote, node, self) with ``allowed`` and ``after``, the voters and
    learners (ids with ``*``) that a cluster would have, by id; each change is judged on members (cluster, node,
    is_learner) as they are. A node never removes itself; a voter goes only if two voters stay; a learner may always go;
    only learners are promoted; an added node takes the place of one of its id, as a voter."""
    sets = members.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("node", "is_learner"))).alias("held"))  # a cluster's nodes, a few
    rows = changes.join(sets, "cluster", "left").withColumn("held", F.coalesce("held", F.array().cast(sets.schema["held"].dataType)))
    mine = F.element_at(F.filter("held", lambda m: m["node"] == F.col("node")), 1)
    mine = F.when(F.exists("held", lambda m: m["node"] == F.col("node")), mine)
    voters = F.size(F.filter("held", lambda m: ~m["is_learner"]))
    remove = (F.col("node") != F.col("self")) & mine.isNotNull() & (F.coalesce(mine["is_learner"], F.lit(False)) | (voters > 2))
    promote = F.coalesce(mine["is_learner"], F.lit(False))
    allowed = F.when(F.col("kind") == "add", True).when(F.col("kind") == "remove", remove).otherwise(promote)
    others = F.filter("held", lambda m: m["node"] != F.col("node"))
    stays = F.when(F.col("kind") == "remove", others).otherwise(F.array_sort(F.array_append(others, F.struct(F.col("node"), F.lit(False).alias("is_learner")))))
    names = F.transform(stays, lambda m: F.concat(m["node"].cast("string"), F.when(m["is_learner"], "*").otherwise("")))
    return rows.withColumn("allowed", allowed).withColumn("after", F.when(F.col("allowed"), F.array_join(names, ","))).drop("held")


def ranges_page(ranges: DataFrame, groups: DataFrame, meta_epoch: int) -> DataFrame:
    """One row: the range table as JSON, in order of start; a range is healthy if its group (group_id, leader_id) has a
    leader. Ranges are configuration, so a row of them all is small."""
    led = groups.where("leader_id is not null").select("group_id").distinct().withColumn("led", F.lit(True))
    rows = ranges.join(led, "group_id", "left").select("start", F.struct("range_id", "epoch", "group_id", "start", "end", F.coalesce("led", F.lit(False)).alias("healthy")).alias("r"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("start", "r"))), lambda x: x["r"])
    return rows.agg(F.to_json(F.struct(F.lit(meta_epoch).alias("meta_epoch"), listed.alias("ranges"))).alias("json"))


def raft_pages(groups: DataFrame) -> DataFrame:
    """One row of groups (group_id, leader_id, term, commit, role): ``raft``, a list of them in JSON, and ``leadership``, an
    object by group. A null leader is written out."""
    opts = {"ignoreNullFields": "false"}
    g = groups.withColumn("is_leader", F.col("role") == "leader")
    rows = g.select("group_id", F.struct("group_id", "leader_id", "term", "commit", "role", "is_leader").alias("r"), F.concat(F.lit('"'), F.col("group_id").cast("string"), F.lit('":'), F.to_json(F.struct("leader_id", "term", "role", "is_leader"), opts)).alias("l"))
    all_ = F.sort_array(F.collect_list(F.struct("group_id", "r", "l")))
    told = rows.agg(F.transform(all_, lambda x: x["r"]).alias("r"), F.transform(all_, lambda x: x["l"]).alias("l"))
    return told.select(F.to_json(F.struct(F.col("r").alias("groups")), opts).alias("raft"), F.concat(F.lit('{"groups":{'), F.array_join("l", ","), F.lit("}}")).alias("leadership"))


def cluster_page(ranges: DataFrame, groups: DataFrame, node_id: int, drain: bool, meta_epoch: int) -> DataFrame:
    """One row: a node's state as JSON, with the groups that it leads."""
    led = groups.agg(F.sort_array(F.collect_list(F.when(F.col("role") == "leader", F.col("group_id")))).alias("led"))
    n = ranges.agg(F.count("*").alias("n"))
    page = F.struct(F.lit(node_id).alias("node_id"), F.lit(drain).alias("drain"), F.col("n").alias("range_count"), F.col("led").alias("leader_group_ids"), F.lit(meta_epoch).alias("meta_epoch"))
    return led.crossJoin(F.broadcast(n)).select(F.to_json(page).alias("json"))


#: Fixed value: how many errors a node remembers.
REMEMBERED = 50


def errors_page(errors: DataFrame) -> DataFrame:
    """One row: the last errors (pos, ts_unix_ms, kind, message) as JSON, the oldest first."""
    last = errors.orderBy(F.desc("pos")).limit(REMEMBERED)
    rows = F.transform(F.sort_array(F.collect_list(F.struct("pos", "ts_unix_ms", "kind", "message"))), lambda x: F.struct(x["ts_unix_ms"].alias("ts_unix_ms"), x["kind"].alias("kind"), x["message"].alias("message")))
    return last.agg(F.to_json(F.struct(rows.alias("errors"))).alias("json"))


def backfill_control(actions: DataFrame) -> DataFrame:
    """actions (name, pos, action pause | resume | finish) with ``status`` after each and ``error``. A backfill is idle until
    it is first resumed; a pause stops a running one only; the step that runs out finishes a running one, and to resume a
    complete one is an error. Two windows instead of a fold: the last pause or resume tells whether it runs, the first
    finish of a running one is final."""
    w = Window.partitionBy("name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("action") != "finish", F.col("action"))
    rows = actions.withColumns({"__begun": F.coalesce(F.max((F.col("action") == "resume").cast("int")).over(w), F.lit(0)) == 1, "__turn": F.last(turn, ignorenulls=True).over(w)})
    runs = F.col("__begun") & (F.col("__turn") == "resume")
    done = F.max((F.col("action") == "finish").cast("int") * runs.cast("int")).over(w) == 1
    rows = rows.withColumn("__done", F.coalesce(done, F.lit(False)))
    status = F.when(F.col("__done"), "complete").when(~F.col("__begun"), "idle").when(runs, "running").otherwise("paused")
    error = F.when(F.col("__done") & (F.col("action") == "resume"), "already complete")
    return rows.withColumns({"status": status, "error": error}).drop("__begun", "__turn", "__done")
