"""Registered queries of stored state, transactions, access, probes and histories, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import index, log, observe, routing, store, txn
from ..sources import tables as T
from .catalog import EVENTS, FIELD, OPS, ORDERS, RANGES, TWOPC, WITH, _cursors, _ops, _records, _requests, latest, query

FSYNC_CASE = "case " + " ".join(f"when latency_us <= {b} then {i}" for i, b in enumerate(observe.FSYNC_BOUNDS)) + f" else {len(observe.FSYNC_BOUNDS)} end"


@query(f"{WITH} select cast(seq // 500 as bigint) as segment, cast(coalesce(sum(40 + strlen(key) + coalesce(strlen(value), 0)) over (partition by seq // 500 order by seq rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\", seq as lsn, seq, op, strlen(key) as key_len, coalesce(strlen(value), 0) as value_len from L")
def wal_inspect(spark, d):
    return store.inspect_records(T.event_log(spark, d).withColumns({"segment": F.expr("seq div 500"), "lsn": F.col("seq")}))


@query(f"{WITH} select key, seq, op, value from L where seq % 6 <> 0")
def payload_apply(spark, d):
    return store.apply_payloads(T.event_log(spark, d).withColumn("op", F.when(F.col("seq") % 6 == 0, "noop").otherwise(F.col("op"))))


@query(f"{WITH} select seq // 1000 as table_id, count(*) as entries, count(*) filter (where op = 'delete') as tombstones, min(key) as min_key, max(key) as max_key, min(seq) as min_seq, max(seq) as max_seq from L group by 1")
def table_stats(spark, d):
    return store.table_stats(T.event_log(spark, d).withColumn("table_id", F.expr("seq div 1000")), "table_id")


EDITS = "E as (select o_orderkey as edit_seq, case when o_orderkey % 3 = 0 then 'delete' when o_orderkey % 31 = 1 then 'set_last_sequence' else 'create' end as kind, o_custkey as table_id, o_orderkey * 2 as sequence, o_orderkey % 11003 <> 11002 as ok from orders), B as (select * from E where edit_seq < coalesce((select min(edit_seq) from E where not ok), 9223372036854775807))"


def _edits(spark, d):
    o = T.table(spark, d, "orders")
    kind = F.expr("case when o_orderkey % 3 = 0 then 'delete' when o_orderkey % 31 = 1 then 'set_last_sequence' else 'create' end")
    return o.select(F.col("o_orderkey").alias("edit_seq"), kind.alias("kind"), F.col("o_custkey").alias("table_id"), F.expr("o_orderkey * 2").alias("sequence"), F.expr("o_orderkey % 11003 <> 11002").alias("ok"))


@query(f"with {EDITS}, P as (select table_id, max(edit_seq) filter (where kind = 'create') as created, max(edit_seq) filter (where kind = 'delete') as deleted from B group by 1) select table_id, created from P where created is not null and (deleted is null or created > deleted)")
def manifest_replay(spark, d):
    return store.replay_manifest(_edits(spark, d))


@query(f"with {EDITS} select count(*) as edits, max(edit_seq) as last_edit_seq, coalesce(arg_max(sequence, edit_seq) filter (where kind = 'set_last_sequence'), 0) as last_sequence from B")
def manifest_state(spark, d):
    return store.manifest_state(_edits(spark, d))


@query()
def crc32c_values(spark, d):
    return T.event_log(spark, d).select("seq", store.crc32c(F.coalesce("value", F.lit("")).cast("binary")).alias("crc"))


@query(f"{WITH} select key, seq, op, value from O where seq <= 9000")
def snapshot_export(spark, d):
    return store.snapshot_rows(T.order_log(spark, d), 9000)


@query("select 'sst-' || s_suppkey as name, 100 + s_suppkey as size from supplier where s_suppkey % 4 = 0 or s_suppkey % 7 = 0")
def backup_incremental(spark, d):
    s = T.table(spark, d, "supplier").select(F.concat(F.lit("sst-"), F.col("s_suppkey").cast("string")).alias("name"), (100 + F.col("s_suppkey")).alias("size"), "s_suppkey")
    held = s.where("s_suppkey % 7 <> 0").select("name", F.when(F.col("s_suppkey") % 4 == 0, F.col("size") - 1).otherwise(F.col("size")).alias("size"))
    return store.files_to_copy(s.select("name", "size"), held)


@query("select '2024-01-01T00:00:00Z' as ts, event_id % 3 as node_id, '{\"ts\":\"2024-01-01T00:00:00Z\",\"node_id\":' || event_id % 3 || ',\"peer\":\"10.0.0.1:' || event_id % 100 || '\",\"opcode\":' || event_id % 5 || ',\"status\":0,\"auth\":\"acl\"' || case when event_id % 2 = 0 then ',\"key_len\":11' else '' end || case when event_id % 4 = 1 then ',\"tenant\":\"acme\"' else '' end || '}' as line, '<134>1 2024-01-01T00:00:00Z - verlog ' || event_id % 3 || ' audit - ' || line as syslog from events")
def audit_jsonl(spark, d):
    e = T.table(spark, d, "events")
    calls = e.select(F.lit("2024-01-01T00:00:00Z").alias("ts"), (F.col("event_id") % 3).alias("node_id"), F.concat(F.lit("10.0.0.1:"), (F.col("event_id") % 100).cast("string")).alias("peer"), (F.col("event_id") % 5).alias("opcode"), F.lit(0).alias("status"), F.lit("acl").alias("auth"), F.when(F.col("event_id") % 2 == 0, 11).alias("key_len"), F.when(F.col("event_id") % 4 == 1, "acme").alias("tenant"))
    return store.audit_lines(calls)


PROBE = "P as (select event_id + 1 as pos, event_id + 1 + case when event_id >= 777 then 1 else 0 end as seq, case event_id % 4 when 0 then 'fsync_latency' when 1 then 'usdt_marker' when 2 then 'publish_syscall' else 'usdt_marker' end as kind, case when event_id % 4 = 1 then 'wal_fsync' when event_id % 4 = 3 then 'flush' end as site, case when event_id % 8 < 4 then 'enter' else 'exit' end as phase, case when event_id % 8 = 0 then 'fsync' when event_id % 8 = 4 then 'fdatasync' when event_id % 4 = 2 then 'sys' || event_id % 3 end as syscall, case when event_id % 4 = 0 then (event_id * 37) % 60000 end as latency_us, case when event_id % 8 = 5 then event_id % 900 end as duration_us from events)"


def _probe(spark, d):
    e = T.table(spark, d, "events")
    x = F.expr
    return e.select(
        x("event_id + 1").alias("pos"), x("event_id + 1 + if(event_id >= 777, 1, 0)").alias("seq"), x("case event_id % 4 when 0 then 'fsync_latency' when 1 then 'usdt_marker' when 2 then 'publish_syscall' else 'usdt_marker' end").alias("kind"),
        x("case when event_id % 4 = 1 then 'wal_fsync' when event_id % 4 = 3 then 'flush' end").alias("site"), x("if(event_id % 8 < 4, 'enter', 'exit')").alias("phase"),
        x("case when event_id % 8 = 0 then 'fsync' when event_id % 8 = 4 then 'fdatasync' when event_id % 4 = 2 then concat('sys', event_id % 3) end").alias("syscall"),
        x("case when event_id % 4 = 0 then (event_id * 37) % 60000 end").alias("latency_us"), x("case when event_id % 8 = 5 then event_id % 900 end").alias("duration_us"),
    )


@query(f"with {PROBE} select true as seed_ok, min(pos) filter (where pos <> seq) as expected_seq, arg_min(seq, pos) filter (where pos <> seq) as actual_seq, count(*) as durability_events, false as valid from P")
def probe_validate(spark, d):
    return store.validate_trace(_probe(spark, d), 42, 42)


@query(f"with {PROBE} select seq, kind, site, kind = 'fsync_latency' or coalesce(site, '') = 'wal_fsync' as wal, kind = 'publish_syscall' or coalesce(site, '') = 'flush' as publish, true as durability from P")
def probe_filters(spark, d):
    return observe.probe_filters(_probe(spark, d)).select("seq", "kind", "site", "wal", "publish", "durability")


@query(f"with {PROBE} select syscall, cast({FSYNC_CASE} as int) as bucket, count(*) as n, cast(sum(latency_us) as bigint) as total_us from P where latency_us is not null group by 1, 2")
def fsync_histogram(spark, d):
    return observe.fsync_histogram(_probe(spark, d))


@query(f"with {PROBE}, A as (select count(*) filter (where kind = 'fsync_latency' or site = 'wal_fsync') as kernel_events, cast(sum(latency_us) as bigint) as total, max(latency_us) as kernel_max_us, count(*) filter (where kind = 'publish_syscall') as published, count(*) filter (where site = 'wal_fsync' and phase = 'enter') as wal_fsync_enter, count(*) filter (where site = 'wal_fsync' and phase = 'exit') as wal_fsync_exit, count(*) filter (where site = 'flush' and phase = 'enter') as flush_enter, count(*) filter (where site = 'flush' and phase = 'exit') as flush_exit from P), K as (select string_agg(syscall, ',' order by f) as kinds from (select syscall, min(seq) as f from P where kind = 'publish_syscall' group by 1)) select kernel_events, kernel_max_us, published, wal_fsync_enter, wal_fsync_exit, flush_enter, flush_exit, cast(total // kernel_events as bigint) as kernel_avg_us, cast(14000 as bigint) as user_avg_us, abs(14000 - total // kernel_events) * 100 / (total // kernel_events) as apart_percent, apart_percent <= 5 as agrees, kinds from A, K")
def correlate(spark, d):
    return observe.correlate(_probe(spark, d), 100, 1_400_000)


@query(f"with {PROBE}, S as (select site, seq, phase, duration_us, lag(seq) over w as f, lag(phase) over w as p from P where kind = 'usdt_marker' window w as (partition by site order by seq)) select site, f as from_seq, seq as to_seq, duration_us from S where phase = 'exit' and p = 'enter'")
def span_pairs(spark, d):
    return observe.span_pairs(_probe(spark, d).where("kind = 'usdt_marker'"))


@query("select user_id as source, event_id, row_number() over (partition by user_id order by event_id) as seq from events")
def event_numbers(spark, d):
    return observe.numbered(T.table(spark, d, "events").select(F.col("user_id").alias("source"), "event_id"), "event_id", "source")


CALLS = "C as (select event_type as op, length(props) as bytes, event_id % 700 as us from events)"


def _counters(spark, d):
    return observe.engine_counters(T.table(spark, d, "events").select(F.col("event_type").alias("op"), F.length("props").alias("bytes"), F.expr("event_id % 700").alias("us")))


@query(f"with {CALLS} select op, count(*) as n, cast(sum(bytes) as bigint) as bytes, cast(sum(us) as bigint) as total_us, max(us) as max_us from C group by op")
def engine_counters(spark, d):
    return _counters(spark, d)


@query(f"with {CALLS}, G as (select op, count(*) as n, sum(bytes) as bytes, sum(us) as total_us, max(us) as max_us from C group by op) select '[' || string_agg('{{\"op\":\"' || op || '\",\"n\":' || n || ',\"bytes\":' || bytes || ',\"total_us\":' || total_us || ',\"max_us\":' || max_us || '}}', ',' order by op) || ']' as json, string_agg('verlog_' || op || '_total ' || n, chr(10) order by op) as exposition from G")
def stats_json(spark, d):
    return observe.stats_json(_counters(spark, d))


@query("select s_name as name, s_suppkey * 100 as ops, s_suppkey * 1000003 as ns, case when s_suppkey > 0 then s_suppkey * 100000000000 // (s_suppkey * 1000003) end as per_second from supplier")
def bench_throughput(spark, d):
    return observe.throughput(T.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.expr("s_suppkey * 100").alias("ops"), F.expr("s_suppkey * 1000003").alias("ns")))


@query(f"{WITH} select key, string_agg(cast(seq as varchar), ',' order by seq) as versions from O group by key")
def key_versions(spark, d):
    return log.versions_of(T.order_log(spark, d)).select("key", F.array_join("versions", ",").alias("versions"))


@query("select user_id as source, event_id as pos, (event_id * 7919) % 10007 as watermark, max((event_id * 7919) % 10007) over (partition by user_id order by event_id) as effective from events")
def gc_watermark(spark, d):
    return log.watermarks(T.table(spark, d, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("pos"), F.expr("(event_id * 7919) % 10007").alias("watermark")))


@query("select s_suppkey as table_id, s_suppkey % 4 as level from supplier")
def tables_newest_first(spark, d):
    return store.newest_first(T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("table_id"), (F.col("s_suppkey") % 4).alias("level")))


@query(f"{WITH}, R as (select key, split_part(value, '|', 1) as sec, row_number() over (order by key) - 1 as rn from {latest('L')} where op = 'put'), S as (select rn // 7 as step, count(*) as scanned, count(sec) as indexed, max(key) as last_key, count(*) < 7 as complete from R group by 1) select * from S union all select count(*), 0, 0, null, true from S having not bool_or(complete)")
def backfill_steps(spark, d):
    return index.backfill_steps(T.event_log(spark, d), "user:", index.field("|", 0), 7)


@query(f"{WITH} select count(*) as scanned, count(case when value like '%|%|%' then 1 end) as indexed from {latest('O')} where op = 'put'")
def backfill_counts(spark, d):
    return index.backfill_counts(T.order_log(spark, d), "cust:", index.field("|", 2))


@query("with D as (select s_suppkey as pos, case when s_suppkey % 9 = 0 then 'bad name' else 'idx' || s_suppkey % 40 end as name, case when s_suppkey % 13 = 0 then '' else 'user:' end as prefix from supplier) select *, case when not regexp_full_match(name, '[A-Za-z0-9_-]{1,64}') then 'bad name' when prefix = '' then 'empty prefix' when row_number() over (partition by name order by pos) > 1 then 'duplicate' end as error from D")
def index_definitions(spark, d):
    s = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.expr("if(s_suppkey % 9 = 0, 'bad name', concat('idx', s_suppkey % 40))").alias("name"), F.expr("if(s_suppkey % 13 = 0, '', 'user:')").alias("prefix"))
    return index.definition_errors(s)


@query("select cast(3000 as bigint) as position")
def cdc_min_position(spark, d):
    return observe.min_position(_cursors(spark))


@query(f"{WITH}, X as (select seq from L where seq > 1000 order by seq limit 200) select count(*) as events, coalesce(max(seq), 1000) as position from X")
def cdc_poll_position(spark, d):
    return observe.cdc_position(T.event_log(spark, d), 1000, 200)


@query(f"{WITH} select count(*) filter (where seq <= 4000) as removed, count(*) filter (where seq > 4000) as \"left\" from L")
def cdc_compact_count(spark, d):
    return observe.cdc_compacted(T.event_log(spark, d), 4000)


@query()
def txn_replay(spark, d):
    """Each user shard runs transactions of eight events over five keys."""
    e = T.table(spark, d, "events")
    kind = F.expr("case event_id % 8 when 0 then 'begin' when 1 then 'begin' when 6 then 'commit' when 7 then if(event_id % 3 = 0, 'rollback', 'commit') when 4 then 'get' when 3 then 'delete' else 'put' end")
    rows = e.select((F.col("user_id") % 16).alias("shard"), F.col("event_id").alias("pos"), F.expr("event_id div 8 * 2 + event_id % 2").alias("txn"), kind.alias("kind"), F.concat(F.lit("k"), (F.col("event_id") * 7 % 5).cast("string")).alias("key"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"))
    return txn.replay(rows)


STEPS = "S as (select event_id as pos, event_id % 2000 as txn, case (event_id // 2000 * 5 + event_id % 7) % 6 when 0 then 'commit' when 1 then 'abort' when 2 then 'decide_commit' when 3 then 'decide_abort' else 'prepare' end as kind from events)"


def _steps(spark, d):
    e = T.table(spark, d, "events")
    kind = F.expr("case (event_id div 2000 * 5 + event_id % 7) % 6 when 0 then 'commit' when 1 then 'abort' when 2 then 'decide_commit' when 3 then 'decide_abort' else 'prepare' end")
    return e.select(F.col("event_id").alias("pos"), (F.col("event_id") % 2000).alias("txn"), kind.alias("kind"))


@query(f"""with recursive {STEPS}, N as (select *, row_number() over (partition by txn order by pos) as rn, kind like 'decide%' as dec, case when kind like '%commit' then 'committed' when kind like '%abort' then 'aborted' end as wants from S),
R(txn, rn, state, decision, errors) as (select distinct txn, cast(0 as bigint), 'none', cast(null as varchar), cast(0 as bigint) from S union all
select N.txn, N.rn, case when kind = 'prepare' then 'prepared' when bad then state when dec and state <> 'prepared' then state else wants end, case when dec then coalesce(decision, wants) else decision end, errors + cast(bad as bigint)
from (select N.*, R.state, R.decision, R.errors, coalesce(dec and decision is not null and decision <> wants, false) or (not dec and wants is not null and state in ('committed', 'aborted') and state <> wants) as bad from R join N on N.txn = R.txn and N.rn = R.rn + 1) N)
select txn, arg_max(state, rn) as state, max(decision) as decision, max(errors) as errors from R group by txn""")
def twopc_replay(spark, d):
    return txn.replay_2pc(_steps(spark, d))


@query("with X as (select event_id as pos, event_id % 2000 as txn, (event_id // 2000) % 3 <> 1 as decision from events), F as (select *, first_value(decision) over (partition by txn order by pos) as f from X) select pos, txn from F where decision <> f")
def decision_flips(spark, d):
    return txn.decision_flips(T.table(spark, d, "events").select(F.col("event_id").alias("pos"), F.expr("event_id % 2000").alias("txn"), F.expr("(event_id div 2000) % 3 <> 1").alias("decision")))


@query("select l_orderkey as txn, bool_and(l_quantity < 45) as committed, count(*) as groups from lineitem group by 1")
def cross_group_outcome(spark, d):
    return txn.cross_group_outcome(T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("txn"), F.col("l_linenumber").alias("group_id"), (F.col("l_quantity") < 45).alias("prepared")))


@query(f"with {TWOPC} select txn, false as decision from X where state = 2 and txn not in (select txn from D)")
def orphan_aborts(spark, d):
    return txn.orphan_aborts(*_records(spark, d))


@query("select event_id, event_id // 3 as now, cast(event_id // 2 as bigint) * 65536 + 3 as remote from events where event_id // 2 > event_id // 3 + 500")
def hlc_offset(spark, d):
    e = T.table(spark, d, "events").select("event_id", F.expr("event_id div 3").alias("now"), F.expr("event_id div 2 * 65536 + 3").alias("remote"))
    return observe.too_far_ahead(e)


@query("select start, \"end\", range_id, epoch, group_id from (values ('', 'b', 1, 1, 1), ('b', 'd', 7, 4, 2), ('d', 'f', 8, 1, 3), ('f', 'm', 3, 2, 1), ('m', '', 9, 1, 5)) t(start, \"end\", range_id, epoch, group_id)")
def range_build(spark, d):
    given = [("m", "", 0, 0, 5), ("", "b", 0, 1, 1), ("d", "f", 0, 0, 3), ("b", "d", 7, 4, 2), ("f", "m", 3, 2, 1)]
    return routing.build_ranges(spark.createDataFrame(given, "start string, end string, range_id long, epoch long, group_id long"))


@query("select r.r_name as leader, count(n_nationkey) as n, coalesce(string_agg(cast(n_nationkey as varchar), ',' order by n_nationkey), '') as ids from region r left join nation on n_regionkey = r_regionkey and n_nationkey < 12 and n_regionkey <> 2 group by 1")
def ranges_per_leader(spark, d):
    n = T.table(spark, d, "nation").where("n_nationkey < 12").join(F.broadcast(T.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    held = n.select(F.col("n_nationkey").alias("range_id"), F.when(F.col("r_regionkey") != 2, F.col("r_name")).alias("leader"))
    return routing.ranges_per_leader(T.table(spark, d, "region").select(F.col("r_name").alias("leader")), held)


@query("select event_id, event_id % 9 as client_epoch from events where event_id % 9 < 4")
def range_stale(spark, d):
    return routing.stale(T.table(spark, d, "events").select("event_id", (F.col("event_id") % 9).alias("client_epoch")), 4)


@query()
def range_cas(spark, d):
    s = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.expr("s_suppkey div 3").alias("base_epoch"), F.expr("s_suppkey div 3 + 1").alias("epoch"), F.concat(F.lit("t"), F.expr("s_suppkey div 3 + s_suppkey % 3 div 2").cast("string")).alias("snapshot"))
    return routing.apply_epochs(s)


RULES = "A(prefix, token) as (values ('user:', 't0'), ('user:0000', 't1'), ('user:00001', 't2')), N(tenant, token, prefix) as (values ('acme', 't0', 'user:0000'), ('globex', 't1', 'user:000'))"


def _rules(spark):
    acl = spark.createDataFrame([("user:", "t0"), ("user:0000", "t1"), ("user:00001", "t2")], "prefix string, token string")
    return acl, spark.createDataFrame([("acme", "t0", "user:0000"), ("globex", "t1", "user:000")], "tenant string, token string, prefix string")


@query(f"{WITH}, {RULES}, Q as (select seq, key, 't' || cast(seq % 3 as varchar) as token from L), B as (select Q.*, A.token as r, row_number() over (partition by seq order by length(prefix) desc) as rn from Q left join A on starts_with(key, prefix)) select seq, key, token, case when not exists (select 1 from N where N.token = B.token and starts_with(key, N.prefix)) then 'tenant denied' when not coalesce(r = token, false) then 'acl denied' else 'allowed' end as verdict from B where rn = 1")
def access_gate(spark, d):
    return routing.gate(_requests(spark, d), *_rules(spark))


@query(f"{WITH}, {RULES}, Q as (select seq, key, 't' || cast(seq % 3 as varchar) as token from L) select * from Q where token in (select token from A) and token in (select token from N)")
def access_keyless(spark, d):
    return routing.keyless(_requests(spark, d), *_rules(spark))


@query("select 'acme' as a, 'globex' as b")
def access_clashes(spark, d):
    return routing.clashing_prefixes(_rules(spark)[1])


@query("with X as (select s_suppkey, case s_suppkey % 4 when 0 then '0x' || hex(encode(s_name)) when 1 then 'hex:' || lower(hex(encode(s_name))) when 2 then '0xZZ' else s_name end as literal from supplier) select s_suppkey, case s_suppkey % 4 when 2 then null else (select s_name from supplier s where s.s_suppkey = X.s_suppkey) end as prefix from X")
def prefix_parse(spark, d):
    s = T.table(spark, d, "supplier")
    name = F.col("s_name")
    literal = F.expr("s_suppkey % 4").cast("int")
    literal = F.when(literal == 0, F.concat(F.lit("0x"), F.hex(name))).when(literal == 1, F.concat(F.lit("hex:"), F.lower(F.hex(name)))).when(literal == 2, "0xZZ").otherwise(name)
    return s.select("s_suppkey", routing.parse_prefix(literal).cast("string").alias("prefix"))


INTERVALS = "S as (select event_id as id, 'h' || event_id // 10 as key, event_id * 3 as s, event_id * 3 + 1 + event_id % 9 as e from events)"


@query(f"with {INTERVALS} select a.key, a.id as a_id, b.id as b_id from S a join S b on a.key = b.key and a.e < b.s")
def history_realtime_order(spark, d):
    s = T.table(spark, d, "events").select(F.concat(F.lit("h"), F.expr("event_id div 10").cast("string")).alias("key"), F.col("event_id").alias("id"), F.expr("event_id * 3").alias("s"), F.expr("event_id * 3 + 1 + event_id % 9").alias("e"))
    return observe.realtime_order(s)


@query(f"{WITH}, C(scan_id, prefix) as (values (1, 'user:0000'), (2, 'user:00001'), (3, 'zzz')) select scan_id, seq as id, key from L join C on starts_with(key, prefix)")
def history_scan_related(spark, d):
    scans = spark.createDataFrame([(1, "user:0000"), (2, "user:00001"), (3, "zzz")], "scan_id int, prefix string")
    return observe.scan_related(T.event_log(spark, d).select(F.col("seq").alias("id"), "key"), scans)


@query("with X as (select event_id // 100 as history, event_id as pos, user_id % 3 as client from events), C as (select *, row_number() over (partition by history, client order by pos) as own from X), K as (select *, row_number() over (partition by history order by pos) as total from C where own <= 20) select history, pos, client from K where total <= 40")
def history_capped(spark, d):
    return observe.capped_recording(T.table(spark, d, "events").select(F.expr("event_id div 100").alias("history"), F.col("event_id").alias("pos"), F.expr("user_id % 3").alias("client")), 40)


@query(f"{WITH}, {OPS} select key, op, count(*) as n from P group by key, op")
def history_tally(spark, d):
    return observe.tally(_ops(spark, d))


@query("with X as (select o_custkey % 10 as account, 1 + o_orderkey % 50 as amount, (o_custkey + 1 + o_orderkey % 8) % 10 as dst from orders where o_orderstatus <> 'P'), G as (select account, -amount as d from X union all select dst, amount from X) select 10 as accounts, cast(1000 + sum(d) as bigint) as total, true as constant from G")
def bank_total(spark, d):
    o = T.table(spark, d, "orders")
    t = o.select(F.col("o_orderkey").alias("pos"), F.expr("o_custkey % 10").alias("src"), F.expr("(o_custkey + 1 + o_orderkey % 8) % 10").alias("dst"), F.expr("1 + o_orderkey % 50").alias("amount"), (F.col("o_orderstatus") != "P").alias("committed"))
    return observe.bank_total(t, accounts=10, initial=100)


@query("with V as (select l_orderkey as term, l_linenumber % 5 as voter, l_returnflag <> 'N' as granted from lineitem) select term, count(distinct voter) filter (where granted) as votes, count(distinct voter) filter (where granted) > 2 as elected from V group by term")
def election_quorum(spark, d):
    v = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("term"), (F.col("l_linenumber") % 5).alias("voter"), (F.col("l_returnflag") != "N").alias("granted"))
    return routing.elected(v, 5)
