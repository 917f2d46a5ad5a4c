"""Every registered query with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import index, log, observe, routing, store
from ..sources import tables as T
from ..sources.jsonl import decode_cdc

EVENTS = "select 'user:' || lpad(cast(user_id as varchar), 6, '0') as key, event_id + 1 as seq, case when event_type = 'error' then 'delete' else 'put' end as op, case when event_type <> 'error' then event_type || '|' || cast(cast(floor(value * 100 + 0.5) as bigint) as varchar) || '|' || props end as value from events"
ORDERS = "select 'cust:' || lpad(cast(o_custkey as varchar), 6, '0') as key, o_orderkey + 1 as seq, case when o_orderstatus = 'F' then 'delete' else 'put' end as op, case when o_orderstatus <> 'F' then o_orderpriority || '|' || cast(cast(floor(o_totalprice * 100 + 0.5) as bigint) as varchar) end as value from orders"
WITH = f"with L as ({EVENTS}), O as ({ORDERS})"
RANGES = "R(start, \"end\", range_id, epoch, group_id) as (values " + ", ".join(f"('{a}', '{b}', {c}, {d}, {e})" for a, b, c, d, e in T.RANGES) + ")"
META = "M as (select s_suppkey as table_id, s_suppkey % 4 as level, 100 + (s_suppkey * 37) % 400 as file_size, s_suppkey % 5 = 0 as pinned from supplier)"
FIELD = "case when op = 'put' then split_part(value, '|', 1) end"
READ_TS, PREFIX, WATERMARK = 6000, "user:0000", 5000
BOUND_CASE = "case " + " ".join(f"when v <= {b} then {i}" for i, b in enumerate(observe.BOUNDS)) + f" else {len(observe.BOUNDS)} end"
CENTS = "cast(floor(l_extendedprice * 100 + 0.5) as bigint) % 700000"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def latest(source: str, where: str = "true") -> str:
    return f"(select * from (select *, row_number() over (partition by key order by seq desc) as rn from {source} where {where}) where rn = 1)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _ops(spark, d):
    """A recorded history: event i of a user is a put, a get of what its writer last wrote (each seventh stale), or a failed put."""
    e = T.event_log(spark, d)
    return e.select(F.col("seq").alias("pos"), "key", F.when(F.col("seq") % 3 == 0, "get").otherwise("put").alias("op"), F.when(F.col("seq") % 3 == 0, F.when(F.col("seq") % 2 == 0, F.lit("v0"))).otherwise(F.concat(F.lit("v"), (F.col("seq") % 2).cast("string"))).alias("value"), (F.col("seq") % 11 != 0).alias("ok"))


OPS = "P as (select seq as pos, key, case when seq % 3 = 0 then 'get' else 'put' end as op, case when seq % 3 = 0 then case when seq % 2 = 0 then 'v0' end else 'v' || cast(seq % 2 as varchar) end as value, seq % 11 <> 0 as ok from L)"


@query(f"{WITH} select key, value from {latest('L')} where op = 'put'")
def latest_scan(spark, d):
    return log.scan(T.event_log(spark, d))


@query(f"{WITH} select key, value from {latest('L', f'seq <= {READ_TS}')} where op = 'put' and starts_with(key, '{PREFIX}')")
def snapshot_scan(spark, d):
    return log.scan(T.event_log(spark, d), READ_TS, PREFIX)


@query(f"{WITH} select key, value from {latest('L', f'seq <= {READ_TS}')} where op = 'put' and key = 'user:000042'")
def point_get(spark, d):
    return log.get(T.event_log(spark, d), "user:000042", READ_TS)


@query(f"{WITH} select * from O where starts_with(key, 'cust:0001')")
def raw_versions(spark, d):
    return log.raw_versions(T.order_log(spark, d), "cust:0001")


@query(f"{WITH} select key, value from (select * from {latest('L')} order by key limit 50) where op = 'put'")
def capped_scan(spark, d):
    return log.capped_scan(T.event_log(spark, d), 50)


@query(f"{WITH}, C as (select key, value, sum(strlen(key) + strlen(value)) over (order by key) as t, row_number() over (order by key) as rn2 from (select * from {latest('L')} order by key limit 100) where op = 'put') select key, value from C where t <= 1500 or rn2 = 1")
def byte_capped_scan(spark, d):
    return log.byte_capped_scan(T.event_log(spark, d), 100, 1500)


@query(f"{WITH} select key, max(seq) as seq from O group by key")
def latest_seq(spark, d):
    return log.latest_seq(T.order_log(spark, d))


@query(f"{WITH}, C as (select *, seq % 8 as part, sum(strlen(key) + 8 + coalesce(strlen(value), 0)) over (partition by seq % 8 order by seq) as t from L) select part, cast(floor((t - 1) / 4096) as bigint) as bucket, count(*) as entries, min(seq) as min_seq, max(seq) as max_seq from C group by 1, 2")
def flush_buckets(spark, d):
    return log.flush_buckets(T.event_log(spark, d), 4096, F.col("seq") % 8)


@query(f"{WITH}, A as (select *, row_number() over (partition by key order by seq desc) as rn, first_value(op) over (partition by key order by seq desc) as top, first_value(seq) over (partition by key order by seq desc) as ts from L) select key, seq, op, value from A where not (top = 'delete' and ts < {WATERMARK}) and (seq >= {WATERMARK} or (rn = 1 and op = 'put'))")
def gc_reference(spark, d):
    return log.gc(T.event_log(spark, d), WATERMARK, "reference")


@query(f"{WITH}, A as (select *, row_number() over (partition by key, seq < {WATERMARK} order by seq desc) as rn from L) select key, seq, op, value from A where seq >= {WATERMARK} or (rn = 1 and op = 'put')")
def gc_safe(spark, d):
    return log.gc(T.event_log(spark, d), WATERMARK)


@query(f"with {META} select table_id from M where not pinned and (select count(*) from M where not pinned) >= 2")
def compaction_pick_l0(spark, d):
    return log.pick_l0(T.tables_meta(spark, d))


@query(f"with {META}, G as (select level, count(*) as n from M where not pinned group by level), C as (select min(level) as level from G where n >= case when level = 0 then 4 else 2 end) select table_id, cast(level + 1 as int) as output_level from M join C using (level) where not pinned")
def compaction_pick_leveled(spark, d):
    return log.pick_leveled(T.tables_meta(spark, d))


@query(f"with {META}, G as (select *, case when file_size > 1.5 * lag(file_size) over (partition by level order by file_size, table_id) then 1 else 0 end as larger from M where not pinned), N as (select *, sum(larger) over (partition by level order by file_size, table_id) as run from G), C as (select level, run from N group by level, run having count(*) >= 4 order by level, run limit 1) select table_id, cast(level + 1 as int) as output_level from N join C using (level, run)")
def compaction_pick_tiered(spark, d):
    return log.pick_tiered(T.tables_meta(spark, d))


@query(f"{WITH} select value as secondary, key as primary from {latest('O')} where op = 'put'")
def index_whole(spark, d):
    return index.build(T.order_log(spark, d), "cust:", index.whole)


@query(f"{WITH} select substr(value, 1, 3) as secondary, key as primary from {latest('O')} where op = 'put'")
def index_prefix(spark, d):
    return index.build(T.order_log(spark, d), "cust:", index.head(3))


@query(f"{WITH} select split_part(value, '|', 2) as secondary, key as primary from {latest('O')} where op = 'put'")
def index_field(spark, d):
    return index.build(T.order_log(spark, d), "cust:", index.field("|", 1))


@query(f"{WITH} select split_part(value, '|', 1) as secondary, key as primary from {latest('O')} where op = 'put' and starts_with(value, '1')")
def index_scan(spark, d):
    return index.index_scan(index.build(T.order_log(spark, d), "cust:", index.field("|", 0)), "1")


@query(f"{WITH}, A as (select key, seq, {FIELD} as n, lag({FIELD}) over (partition by key order by seq) as o from L) select seq, 'remove' as change, o as secondary, key as primary from A where n is distinct from o and o is not null union all select seq, 'add', n, key from A where n is distinct from o and n is not null")
def index_delta(spark, d):
    return index.delta(T.event_log(spark, d), index.field("|", 0))


@query(f"{WITH}, E as (select {FIELD} as secondary, key as primary from {latest('L')} where op = 'put'), A as (select {FIELD} as secondary, key as primary from {latest('L', f'seq <= {READ_TS}')} where op = 'put') select 'missing' as divergence, * from (select * from E except select * from A) union all select 'extra', * from (select * from A except select * from E)")
def index_verify(spark, d):
    events = T.event_log(spark, d)
    return index.verify(index.build(events, "user:", index.field("|", 0)), index.build(events.where(F.col("seq") <= READ_TS), "user:", index.field("|", 0)))


@query(f"{WITH} select key, split_part(value, '|', 1) as secondary from {latest('L')} where op = 'put' and key > 'user:000020' order by key limit 25")
def backfill_page(spark, d):
    return index.backfill_page(T.event_log(spark, d), "user:", index.field("|", 0), "user:000020", 25)


@query(f"{WITH} select * from L where seq > 1000 order by seq limit 200")
def cdc_poll(spark, d):
    return observe.cdc_poll(T.event_log(spark, d), 1000, 200)


def _cursors(spark):
    return spark.createDataFrame([("a", 3000), ("b", 4500), ("c", 9000)], "consumer string, last_seq long")


CURSORS = "C(consumer, last_seq) as (values ('a', 3000), ('b', 4500), ('c', 9000))"


@query(f"{WITH}, {CURSORS} select consumer, (select max(seq) from L) - last_seq as lag from C")
def cdc_lag(spark, d):
    return observe.cdc_lag(T.event_log(spark, d), _cursors(spark))


@query(f"{WITH} select * from L where seq > 3000")
def cdc_compact(spark, d):
    return observe.cdc_compact(T.event_log(spark, d), _cursors(spark))


@query(f"{WITH} select key, value from {latest('L')} where op = 'put'")
def cdc_rebuild(spark, d):
    lines = observe.cdc_events(T.event_log(spark, d)).select(F.col("line").alias("value"))
    return log.latest_of_feed(decode_cdc(lines).where("not error"))


@query(f"{WITH}, {RANGES} select key, seq, range_id, coalesce(group_id, 0) as group_id from L left join R on key >= start and (\"end\" = '' or key < \"end\")")
def range_lookup(spark, d):
    return routing.lookup(T.event_log(spark, d).select("key", "seq"), T.ranges(spark))


@query(f"with {RANGES} select * from R where range_id <> 2 union all values ('user:000030', 'user:000045', 2, 2, 2), ('user:000045', 'user:000060', 9, 1, 9)")
def range_split(spark, d):
    return routing.split(T.ranges(spark), "user:000045", 9, 9)


@query(f"with {RANGES} select * from R where range_id not in (2, 3) union all values ('user:000030', 'user:000100', 2, 3, 2)")
def range_merge(spark, d):
    return routing.merge_next(T.ranges(spark), "user:000030")


@query(f"with {RANGES} select start, \"end\", range_id, case when range_id = 3 then epoch + 1 else epoch end as epoch, case when range_id = 3 then 1 else group_id end as group_id from R")
def range_move(spark, d):
    return routing.move(T.ranges(spark), "user:000060", 1)


@query(f"with {RANGES} select * from R where range_id = 1 or range_id = 4 union all values ('user:000030', 'user:000099', 7, 5, 2)")
def range_overlap(spark, d):
    fresh = spark.createDataFrame([("user:000030", "user:000099", 7, 5, 2)], T.ranges(spark).schema)
    return routing.overlapping(T.ranges(spark), fresh)


@query(f"with {RANGES} select distinct cast(n_nationkey as bigint) as group_id from nation where n_nationkey <> 0 and n_nationkey < 12 and n_nationkey not in (select group_id from R)")
def range_orphans(spark, d):
    hosted = T.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("group_id")).distinct()
    return routing.orphan_groups(hosted, T.ranges(spark), 12)


@query(f"{WITH}, {RANGES} select key, count(range_id) as owners from (select distinct key from L) left join R on key >= start and (\"end\" = '' or key < \"end\") group by key having count(range_id) <> 1")
def range_coverage(spark, d):
    return routing.uncovered(T.event_log(spark, d).select("key"), T.ranges(spark))


def _reads(spark, d):
    e = T.event_log(spark, d).where("seq % 10 = 0")
    return e.select(F.expr("seq div 10").alias("txn"), "key", (F.col("seq") - 50).alias("snapshot"))


READS = "T as (select seq // 10 as txn, key, seq - 50 as snapshot from L where seq % 10 = 0)"


@query(f"{WITH}, {READS}, B as (select txn, T.key, snapshot, value, op, row_number() over (partition by txn, T.key order by seq desc nulls last) as rn from T left join L on T.key = L.key and seq <= snapshot) select txn, key, snapshot, value from B where rn = 1")
def txn_snapshot_read(spark, d):
    return routing.snapshot_reads(_reads(spark, d), T.event_log(spark, d))


@query(f"{WITH}, {READS} select * from T where exists (select 1 from L where L.key = T.key and seq > snapshot + 100)")
def txn_conflicts(spark, d):
    shifted = T.event_log(spark, d).withColumn("seq", F.col("seq") - 100)
    return routing.write_conflicts(_reads(spark, d), shifted)


def _all_reads(spark, d):
    """Each event reads its key, and writes it, at a snapshot of 50 versions before."""
    return T.event_log(spark, d).select(F.col("seq").alias("txn"), "key", (F.col("seq") - 50).alias("snapshot"))


@query(f"{WITH}, T as (select seq as txn, key, seq - 50 as snapshot from L) select txn, T.key, snapshot, case when op = 'put' then value end as value from T asof left join L on T.key = L.key and T.snapshot >= L.seq")
def txn_snapshot_read_all(spark, d):
    return routing.snapshot_reads(_all_reads(spark, d), T.event_log(spark, d))


@query(f"{WITH}, K as (select key, max(seq) as newest from L group by key) select seq as txn, key, seq - 50 as snapshot from L join K using (key) where newest > seq + 50")
def txn_conflicts_all(spark, d):
    shifted = T.event_log(spark, d).withColumn("seq", F.col("seq") - 100)
    return routing.write_conflicts(_all_reads(spark, d), shifted)


def _records(spark, d):
    o = T.table(spark, d, "orders")
    rec = o.select(F.col("o_orderkey").alias("txn"), F.expr("cast(o_orderkey % 5 + 1 as int)").alias("state"))
    return rec, o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("txn"), F.expr("o_orderkey % 2 = 0").alias("decision"))


TWOPC = "X as (select o_orderkey as txn, cast(o_orderkey % 5 + 1 as int) as state from orders), D as (select o_orderkey as txn, o_orderkey % 2 = 0 as decision from orders where o_orderkey % 3 = 0)"


@query(f"with {TWOPC} select txn, state, case when state in (3, 5) then 'committed' when state = 4 then 'aborted' when decision then 'committed' when not decision then 'aborted' when state = 1 then 'aborted' else 'in_doubt' end as outcome from X left join D using (txn)")
def twopc_recovery(spark, d):
    return routing.recover_2pc(*_records(spark, d))


@query(f"with {TWOPC} select txn from X where state = 2 and txn not in (select txn from D)")
def twopc_in_doubt(spark, d):
    return routing.in_doubt(*_records(spark, d))


@query(f"{WITH}, {RANGES}, G as (select seq // 4 as txn, key, coalesce(group_id, 0) as g from L left join R on key >= start and (\"end\" = '' or key < \"end\")) select txn, arg_min(g, key) as coordinator, count(distinct g) as groups from G group by txn")
def twopc_coordinator(spark, d):
    return routing.coordinators(T.event_log(spark, d).select(F.expr("seq div 4").alias("txn"), "key"), T.ranges(spark))


ACL = "A(prefix, token) as (values ('user:', 't0'), ('user:0000', 't1'), ('user:00001', 't2'))"


def _requests(spark, d):
    return T.event_log(spark, d).select("seq", "key", F.concat(F.lit("t"), (F.col("seq") % 3).cast("string")).alias("token"))


@query(f"{WITH}, {ACL}, Q as (select seq, key, 't' || cast(seq % 3 as varchar) as token from L), B as (select Q.*, A.token as r, row_number() over (partition by seq order by length(prefix) desc) as rn from Q left join A on starts_with(key, prefix)) select seq, key, token, coalesce(r = token, false) as allowed from B where rn = 1")
def acl_longest_prefix(spark, d):
    acl = spark.createDataFrame([("user:", "t0"), ("user:0000", "t1"), ("user:00001", "t2")], "prefix string, token string")
    return routing.authorize(_requests(spark, d), acl)


@query(f"{WITH} select 't' || cast(seq % 3 as varchar) as token, seq, key, case seq % 3 when 0 then 'acme' else 'globex' end as tenant from L where (seq % 3 = 0 and starts_with(key, 'user:0000')) or (seq % 3 = 1 and starts_with(key, 'user:0001'))")
def tenant_filter(spark, d):
    tenants = spark.createDataFrame([("acme", "t0", "user:0000"), ("globex", "t1", "user:0001")], "tenant string, token string, prefix string")
    return routing.tenant_filter(_requests(spark, d), tenants)


def _latencies(spark, d):
    return T.table(spark, d, "lineitem").select("l_returnflag", F.expr(CENTS).alias("v"))


HIST = f"V as (select l_returnflag, {CENTS} as v from lineitem), B as (select l_returnflag, {BOUND_CASE} as bucket, count(*) as n from V group by 1, 2), G as (select l_returnflag, cast(bucket as int) as bucket from (select distinct l_returnflag from V), range(14) as t(bucket)), H as (select G.l_returnflag, G.bucket, coalesce(n, 0) as n, cast(sum(coalesce(n, 0)) over (partition by G.l_returnflag order by G.bucket) as bigint) as cumulative from G left join B on G.l_returnflag = B.l_returnflag and G.bucket = B.bucket)"


@query(f"with {HIST} select * from H")
def histogram(spark, d):
    return observe.histogram(_latencies(spark, d), "l_returnflag", "v")


@query(f"with {HIST} select l_returnflag, count(*) as n, cast(sum(v) as bigint) as total, max(v) as top, cast(sum(v) // count(*) as bigint) as mean from V group by 1")
def latency_summary(spark, d):
    return observe.summary(_latencies(spark, d), "l_returnflag", "v")


@query(f"with {HIST}, S as (select l_returnflag, count(*) as n, max(v) as top from V group by 1), K as (select H.l_returnflag, min(bucket) as bucket, any_value(top) as top from H join S using (l_returnflag) where cumulative >= greatest(1, (S.n * 99 + 99) // 100) group by 1) select l_returnflag, cast(coalesce(list_extract({observe.BOUNDS}, bucket + 1), top) as bigint) as p from K")
def percentile_bucket(spark, d):
    return observe.percentile(_latencies(spark, d), "l_returnflag", "v", 99)


@query(f"with {HIST} select bucket, cast(sum(n) as bigint) as n from H group by bucket")
def histogram_merge(spark, d):
    return observe.merge_histograms(observe.histogram(_latencies(spark, d), "l_returnflag", "v"))


@query("select event_id, event_id * 65536 + event_id % 70 as stamp, event_id as ms, event_id % 70 as logical from events")
def hlc_pack(spark, d):
    e = T.table(spark, d, "events").select("event_id", keys.hlc_pack(F.col("event_id"), F.col("event_id") % 70).alias("stamp"))
    return e.select("event_id", "stamp", keys.hlc_ms(F.col("stamp")).alias("ms"), keys.hlc_logical(F.col("stamp")).alias("logical"))


@query()
def hlc_fold(spark, d):
    e = T.table(spark, d, "events").select((F.col("user_id") % 16).alias("node"), F.col("event_id").alias("pos"), F.expr("event_id div 3").alias("now"), keys.hlc_pack(F.expr("event_id div 2"), F.col("event_id") % 5).alias("remote"))
    return observe.hlc_fold(e)


def _wal(spark, d):
    """Records of segments of a thousand; each 4,877th is bad, each 6,011th repeats the number before."""
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return o.select(F.expr("k div 1000").alias("segment"), F.expr("k % 1000").alias("pos"), F.expr("k + 7 - if(k % 6011 = 6010, 1, 0)").alias("lsn"), F.expr("k % 4877 <> 4876").alias("ok"))


WAL = "W as (select o_orderkey // 1000 as segment, o_orderkey % 1000 as pos, o_orderkey + 7 - case when o_orderkey % 6011 = 6010 then 1 else 0 end as lsn, o_orderkey % 4877 <> 4876 as ok from orders), X as (select *, case when not ok or lsn <> lag(lsn) over (order by segment, pos) + 1 then 1 else 0 end as bad from W), Y as (select *, max(bad) over (order by segment, pos) as seen from X)"


@query(f"with {WAL} select segment, pos, lsn, ok from Y where seen = 0")
def wal_prefix(spark, d):
    return store.valid_prefix(_wal(spark, d))


@query(f"with {WAL}, S as (select min(segment) as s from Y where seen = 1) select count(*) filter (where seen = 0) as records, max(lsn) filter (where seen = 0) as last_lsn, count(*) filter (where seen = 1 and segment = s) as truncated, count(distinct segment) filter (where segment > s) as ignored_segments from Y, S")
def wal_report(spark, d):
    return store.recovery_report(_wal(spark, d))


@query("select s_suppkey as table_id from supplier where s_suppkey % 3 <> 0")
def manifest_live(spark, d):
    s = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("table_id"))
    edit = lambda rows, kind, seq: rows.select(seq.alias("edit_seq"), F.lit(kind).alias("kind"), "table_id", F.lit(None).cast("long").alias("sequence"), F.lit(True).alias("ok"))
    edits = edit(s, "create", 2 * F.col("table_id")).unionByName(edit(s.where("table_id % 3 = 0"), "delete", 2 * F.col("table_id") + 1))
    return store.replay_manifest(edits).select("table_id")


@query("select event_id % 5000 as idx, min(event_id) as lsn from events group by 1")
def apply_index_dedupe(spark, d):
    return store.first_by_index(T.table(spark, d, "events").select(F.col("event_id").alias("pos"), F.expr("event_id % 5000").alias("idx"), F.col("event_id").alias("lsn")))


@query(f"{WITH}, {OPS}, S as (select *, last_value(case when ok and op = 'put' then value end ignore nulls) over (partition by key order by pos rows between unbounded preceding and 1 preceding) as s from P) select pos, key from S where op = 'get' and ok and value is distinct from s")
def history_seq_check(spark, d):
    return observe.sequential_violations(_ops(spark, d))


@query("with S as (select event_id as id, user_id % 4 as client, event_id * 3 as s, event_id * 3 + 1 + event_id % 9 as e from events) select a.id as a_id, b.id as b_id from S a join S b on b.id > a.id and b.id <= a.id + 4 and a.client <> b.client and a.s < b.e and b.s < a.e")
def history_overlap(spark, d):
    s = T.table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr("user_id % 4").alias("client"), F.expr("event_id * 3").alias("s"), F.expr("event_id * 3 + 1 + event_id % 9").alias("e"))
    return observe.overlaps(s, 16)


@query(f"{WITH}, {OPS} select op, count(*) as n, cast(sum(case when ok then 1 else 0 end) as bigint) as acked, count(distinct key) as keys from P group by op")
def history_stats(spark, d):
    return observe.history_stats(_ops(spark, d))


@query("with X as (select o_orderkey as pos, o_custkey % 10 as src, (o_custkey + 1 + o_orderkey % 8) % 10 as dst, 1 + o_orderkey % 50 as amount from orders where o_orderstatus <> 'P'), G as (select pos, src as account, -amount as d from X union all select pos, dst, amount from X), R as (select account, d, sum(d) over (partition by account order by pos, d rows unbounded preceding) as run from G) select account, cast(sum(d) as bigint) as change, cast(min(run) as bigint) as lowest from R group by account")
def bank_invariant(spark, d):
    o = T.table(spark, d, "orders")
    t = o.select(F.col("o_orderkey").alias("pos"), F.expr("o_custkey % 10").alias("src"), F.expr("(o_custkey + 1 + o_orderkey % 8) % 10").alias("dst"), F.expr("1 + o_orderkey % 50").alias("amount"), (F.col("o_orderstatus") != "P").alias("committed"))
    return observe.bank(t)


@query("select event_id // 100 as term, count(distinct user_id % 3) as leaders from events where event_id % 100 < 2 group by 1 having count(distinct user_id % 3) > 1")
def leader_per_term(spark, d):
    e = T.table(spark, d, "events").where("event_id % 100 < 2")
    return routing.unsafe_terms(e.select(F.expr("event_id div 100").alias("term"), F.expr("user_id % 3").alias("leader")))


@query("select event_id // 100 as term, count(distinct user_id % 3) as leaders from events group by 1 having count(distinct user_id % 3) > 1")
def leader_per_term_all(spark, d):
    e = T.table(spark, d, "events")
    return routing.unsafe_terms(e.select(F.expr("event_id div 100").alias("term"), F.expr("user_id % 3").alias("leader")))


@query(f"{WITH} select key from {latest('L')} where op = 'put' and seq % 7 = 0 and key > 'user:000010'")
def state_convergence(spark, d):
    s = log.versions_at(T.event_log(spark, d)).where("op = 'put'")
    node = lambda n, v: s.select(F.lit(n).alias("node"), F.lit(9).alias("applied"), "key", v.alias("value"))
    other = F.when((F.col("seq") % 7 == 0) & (F.col("key") > "user:000010"), F.concat("value", F.lit("!"))).otherwise(F.col("value"))
    return routing.diverged(node("a", F.col("value")).unionByName(node("b", other)))


@query("with V as (select l_orderkey as entry, l_linenumber % 2 as config, l_returnflag <> 'N' as m from lineitem), P as (select entry, config, sum(case when m then 1 else 0 end) >= ceil(count(*) / 2.0) as ok from V group by 1, 2) select entry, bool_and(ok) as committed from P group by entry")
def commit_quorum(spark, d):
    v = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry"), (F.col("l_linenumber") % 2).alias("config"), (F.col("l_returnflag") != "N").alias("matched"))
    return routing.commit_quorum(v)


@query("with S as (select user_id as source, event_id as pos, (event_id * 7) % 1000 as total from events) select source, pos, greatest(total - coalesce(lag(total) over (partition by source order by pos), 0), 0) as delta from S")
def counter_deltas(spark, d):
    return observe.counter_deltas(T.table(spark, d, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("pos"), F.expr("(event_id * 7) % 1000").alias("total")))


@query(f"{WITH} select seq, '{{\"v\":1,\"seq\":' || cast(seq as varchar) || ',\"op\":\"' || op || '\",\"key\":\"' || lower(hex(encode(key))) || '\"' || coalesce(',\"value\":\"' || lower(hex(encode(value))) || '\"', '') || '}}' as line from L")
def cdc_jsonl(spark, d):
    return observe.cdc_events(T.event_log(spark, d))


@query()
def wgl_check(spark, d):
    e = T.table(spark, d, "events")
    ops = e.select(F.format_string("h%06d", F.expr("event_id div 10")).alias("key"), (F.col("event_id") * 2).alias("s"), (F.col("event_id") * 2 + 1 + F.col("event_id") % 4).alias("e"), F.when(F.col("event_id") % 2 == 0, "put").otherwise("get").alias("op"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("v"), (F.col("event_id") % 4).cast("string"))).alias("value"), F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("v"), ((F.col("event_id") - 1) % 4).cast("string"))).alias("result"))
    return observe.check_histories(ops)


@query()
def rebalance_plan(spark, d):
    """Nodes and ranges are configuration: the plan is made on the driver."""
    rows = T.table(spark, d, "nation").select("n_regionkey", "n_nationkey").collect()  # one row a range
    held: dict[str, list[int]] = {f"n{r['n_regionkey']}": [] for r in rows}
    for r in rows:
        if r["n_nationkey"] < 18:
            held[f"n{r['n_regionkey'] // 2}"].append(r["n_nationkey"])
    return spark.createDataFrame(routing.rebalance(held), "range_id long, from_node string, to_node string")
