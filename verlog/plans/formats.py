"""Registered queries of byte formats, recorded runs, generators and operators' pages, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admin, codec, simulate
from ..sources import tables as T
from .catalog import RANGES, WITH, query

BROKEN = "case seq % 50 when 1 then 'partial header' when 2 then 'bad magic' when 3 then 'partial payload' when 4 then 'bad payload checksum' when 5 then 'bad header checksum' end"


@query(f"{WITH}, X as (select seq, case when seq % 50 = 6 then 'noop' else op end as op, key, value, {BROKEN} as error from L) select seq as place, error, case when error is null then seq + 1 end as lsn, case when error is null then seq end as seq, case when error is null then op end as op, case when error is null and op <> 'noop' then key end as key, case when error is null and op = 'put' then value end as value from X")
def record_codec(spark, d):
    """Records written and read back, a tenth of them damaged: cut, of another magic number, or with changed bytes."""
    log = T.event_log(spark, d)
    noop = F.col("seq") % 50 == 6
    rows = codec.encode_records(log.select("seq", (F.col("seq") + 1).alias("lsn"), F.when(noop, "noop").otherwise(F.col("op")).alias("op"), F.when(~noop, F.col("key")).alias("key"), F.when(~noop, F.col("value")).alias("value")))
    raw, size = F.col("bytes"), F.octet_length("bytes")
    cut = lambda a, n: F.substring(raw, F.lit(a), n)
    damaged = (
        F.when(F.col("seq") % 50 == 1, cut(1, F.lit(39))).when(F.col("seq") % 50 == 2, F.concat(F.lit(b"\x00"), cut(2, size))).when(F.col("seq") % 50 == 3, cut(1, size - 1))
        .when(F.col("seq") % 50 == 4, F.concat(cut(1, size - 1), F.lit(b"\xff"))).when(F.col("seq") % 50 == 5, F.concat(cut(1, F.lit(19)), F.lit(b"\xff"), cut(21, size))).otherwise(raw)
    )
    read = codec.decode_records(rows.select(F.col("seq").alias("place"), damaged.alias("bytes")))
    return read.select("place", "error", "lsn", "seq", "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(f"{WITH} select seq, case when op = 'put' then '01' || hex(encode(value)) else '00' end as raw, op, value from L")
def intent_codec(spark, d):
    rows = T.event_log(spark, d).select("seq", codec.encode_intent(F.col("op"), F.col("value")).alias("raw"))
    x = rows.withColumn("x", codec.decode_intent(F.col("raw")))
    return x.select("seq", F.hex("raw").alias("raw"), "x.op", F.col("x.value").cast("string").alias("value"))


@query(f"{WITH} select seq, '006964782F646174612F' || '0004' || hex(encode('prio')) || hex(encode(split_part(value, '|', 1))) || hex(encode(key)) || printf('%08X', strlen(key)) as raw, split_part(value, '|', 1) as secondary, key as primary, true as other_is_null from O where op = 'put'")
def index_keys(spark, d):
    rows = T.order_log(spark, d).where("op = 'put'").select("seq", codec.index_key("prio", F.split("value", "\\|")[0], F.col("key")).alias("raw"))
    x = rows.withColumns({"x": codec.parse_index_key("prio", F.col("raw")), "other": codec.parse_index_key("prix", F.col("raw"))})
    return x.select("seq", F.hex("raw").alias("raw"), F.col("x.secondary").cast("string").alias("secondary"), F.col("x.primary").cast("string").alias("primary"), F.col("other").isNull().alias("other_is_null"))


@query()
def bloom_probe(spark, d):
    """Filters of tables of a thousand entries; each event's key is looked for in its own table and in the next."""
    log = T.event_log(spark, d).select("key", F.expr("seq div 1000").alias("table_id"))
    near = log.unionByName(log.select("key", (F.col("table_id") + 1).alias("table_id"))).distinct()
    return codec.might_contain(codec.build_bloom(log.distinct()), near)


SCANS = "H as (select seq as pos, key, case when seq % 10 = 0 then 'scan' else op end as op, value, seq % 11 <> 0 as ok, case seq % 30 when 0 then 'zzz' when 10 then key else 'user:00000' || (seq // 10) % 10 end as prefix, case when seq % 30 = 10 then lag(case when op = 'put' then key || '=' || value end) over (partition by key order by seq) end as obs from L), W as (select pos, key, case when op = 'put' then value end as value from H where ok and op <> 'scan'), S as (select * from H where ok and op = 'scan')"


def _scanned(spark, d):
    log = T.event_log(spark, d)
    pair = F.when(F.col("op") == "put", F.array(F.struct("key", "value")))
    prefix = F.expr("case seq % 30 when 0 then 'zzz' when 10 then key else concat('user:00000', (seq div 10) % 10) end")
    from pyspark.sql import Window

    seen = F.when(F.col("seq") % 30 == 10, F.lag(pair).over(Window.partitionBy("key").orderBy("seq")))
    rows = log.withColumns({"seen": seen, "prefix": prefix})
    none = F.array().cast("array<struct<key:string,value:string>>")
    return rows.select(F.col("seq").alias("pos"), "key", F.when(F.col("seq") % 10 == 0, "scan").otherwise(F.col("op")).alias("op"), "value", (F.col("seq") % 11 != 0).alias("ok"), "prefix", F.coalesce("seen", none).alias("observed"))


@query(f"{WITH}, {SCANS}, X as (select S.pos, W.key, W.value, row_number() over (partition by S.pos, W.key order by W.pos desc) as rn from S join W on starts_with(W.key, S.prefix) and W.pos < S.pos), E as (select pos, count(value) as n, string_agg(key || '=' || value, ',' order by key) as pairs from X where rn = 1 group by pos) select S.pos, S.prefix, coalesce(E.n, 0) as expected, cast(case when obs is null then 0 else 1 end as bigint) as observed from S left join E using (pos) where E.pairs is distinct from S.obs")
def history_scan_check(spark, d):
    return simulate.scan_violations(_scanned(spark, d))


TRACE = "E as (select event_id as i, 'user:' || lpad(cast(user_id as varchar), 6, '0') as key, case when event_id % 20 = 7 then 'scan' when event_id % 4 = 0 then 'get' when event_type = 'error' then 'delete' else 'put' end as cmd, 'user:00000' || (event_id // 20) % 10 as prefix from events), W as (select i, key, case when cmd = 'put' then 'v' || i % 2 end as value from E where cmd in ('put', 'delete'))"


@query(f"with {TRACE}, G as (select E.i + 1 as oid, 'get' as cmd, case when E.i % 3 > 0 then 'v' || E.i % 3 % 2 end as expected, W.value as actual from E asof left join W on E.key = W.key and E.i > W.i where E.cmd = 'get' and (E.i % 17 <> 3 or E.i = (select max(i) from E))), X as (select E.i, W.key, W.value, row_number() over (partition by E.i, W.key order by W.i desc) as rn from E join W on starts_with(W.key, E.prefix) and W.i < E.i where E.cmd = 'scan'), N as (select i, count(value) as n from X where rn = 1 group by i) select * from G where expected is distinct from actual union all select E.i + 1, 'scan', cast(E.i % 3 as varchar), cast(coalesce(n, 0) as varchar) from E left join N using (i) where cmd = 'scan' and (E.i % 17 <> 3 or E.i = (select max(i) from E)) and coalesce(n, 0) <> E.i % 3")
def trace_divergence(spark, d):
    """Each event is an operation and its result; each seventeenth result comes too late."""
    e, x = T.table(spark, d, "events"), F.expr
    e = e.select(F.col("event_id").alias("i"), x("concat('user:', lpad(user_id, 6, '0'))").alias("key"), x("case when event_id % 20 = 7 then 'scan' when event_id % 4 = 0 then 'get' when event_type = 'error' then 'delete' else 'put' end").alias("cmd"), x("concat('user:00000', (event_id div 20) % 10)").alias("prefix"))
    ops = e.select((F.col("i") * 2 + 1).alias("eid"), F.lit("op").alias("kind"), (F.col("i") + 1).alias("oid"), "cmd", "key", x("case when cmd = 'put' then concat('v', i % 2) end").alias("val"), "prefix", F.lit(None).cast("long").alias("count"))
    said = x("case when cmd = 'get' and i % 3 > 0 then concat('v', i % 3 % 2) end")
    results = e.select(x("i * 2 + if(i % 17 = 3, 4, 2)").alias("eid"), F.lit("op_result").alias("kind"), (F.col("i") + 1).alias("oid"), "cmd", F.lit(None).cast("string").alias("key"), said.alias("val"), F.lit(None).cast("string").alias("prefix"), x("if(cmd = 'scan', i % 3, null)").alias("count"))
    return simulate.replay_divergence(ops.unionByName(results))


@query(f"{WITH}, A as (select seq + case seq % 4 when 0 then 0 else 5 end as pos, seq, key, op, case when seq % 13 = 0 then 'bad' when op = 'put' then value end as value, case seq % 4 when 2 then 'restart' when 3 then 'snapshot' else 'now' end as place from L), B as (select A.*, L.seq as wrote, L.op as wop, case when L.op = 'put' then L.value end as wvalue from A asof left join L on A.key = L.key and A.pos >= L.seq), C as (select case when place = 'restart' then 'ENG-001' when place = 'snapshot' then 'MVCC-001' when wrote = pos and wop = 'delete' then 'ENG-003' else 'ENG-002' end as invariant, value is distinct from wvalue as bad from B union all select 'ENG-004', seq % 7 = 0 from L where seq % 5 = 0) select invariant, count(*) as checked, count(*) filter (where bad) as violated from C group by 1")
def invariant_checks(spark, d):
    log = T.event_log(spark, d)
    writes = log.select(F.col("seq").alias("pos"), "key", F.when(F.col("op") == "put", F.col("value")).alias("value"))
    seen = log.select(F.expr("seq + if(seq % 4 = 0, 0, 5)").alias("pos"), "key", F.expr("case when seq % 13 = 0 then 'bad' when op = 'put' then value end").alias("value"), F.expr("case seq % 4 when 2 then 'restart' when 3 then 'snapshot' else 'now' end").alias("at"))
    scans = simulate.scans_as_of(writes, log.where("seq % 5 = 0").select(F.col("seq").alias("pos"), F.lit("user:").alias("prefix")))
    return simulate.invariants(writes, seen, scans.withColumn("n", F.expr("n + if(pos % 7 = 0, 1, 0)")))


@query()
def generated_runs(spark, d):
    """A run of 200 operations for each supplier."""
    return simulate.generate(T.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("seed")), 200)


@query("with recursive R(seed, seq, state, next) as (select n_nationkey, cast(0 as bigint), cast(0 as hugeint), (cast(n_nationkey as hugeint) * 11400714819323198485) % 18446744073709551616 from nation union all select seed, seq + 1, (next * 6364136223846793005 + 1) % 18446744073709551616, (((next * 6364136223846793005 + 1) % 18446744073709551616) * 6364136223846793005 + 1) % 18446744073709551616 from R where seq < 200) select cast(seed as bigint) as seed, seq, case when state % 2 = 0 then 'fsync' else 'fdatasync' end as syscall, cast(50 + state % 900 as bigint) as latency_us from R where seq > 0")
def seeded_fsyncs(spark, d):
    return simulate.seeded_fsyncs(T.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seed")), 200)


@query("with E as (select event_id as pos, event_id % 4 as t from events) select 'register' as kind, pos, case when t < 2 then 'put' else 'get' end as op, 'register' as key, case when t < 2 then cast(pos as varchar) end as value from E union all select 'counter', pos, case when t < 3 then 'add' else 'get' end, 'counter', case when t < 3 then '1' end from E union all select 'set', pos, case when t < 3 then 'put' else 'scan' end, case when t < 3 then 'set:' || pos else 'set:' end, case when t < 3 then '1' end from E union all select 'map', pos, case when t < 2 then 'put' when t = 2 then 'get' else 'delete' end, 'map:' || pos * 7 % 5, case when t < 2 then cast(pos as varchar) end from E union all select 'bank', pos, 'transfer', 'account:' || pos % 5 || '>account:' || (pos + 1 + pos % 4) % 5, cast(1 + pos % 10 as varchar) from E")
def workloads(spark, d):
    ticks = T.table(spark, d, "events").select(F.col("event_id").alias("pos"))
    first, *rest = (simulate.workload(ticks, k).withColumn("kind", F.lit(k)) for k in simulate.WORKLOADS)
    for other in rest:
        first = first.unionByName(other)
    return first


@query("with M as (select n_regionkey as cluster, n_nationkey as node, n_nationkey % 3 = 0 as learner from nation where n_nationkey % 4 <> 1), C as (select s_suppkey as change, s_suppkey % 6 as cluster, s_suppkey * 7 % 27 as node, case s_suppkey % 3 when 0 then 'add' when 1 then 'remove' else 'promote' end as kind, s_suppkey % 5 as self from supplier), J as (select C.*, (select learner from M where M.cluster = C.cluster and M.node = C.node) as mine, (select count(*) from M where M.cluster = C.cluster and not learner) as voters from C), A as (select *, case kind when 'add' then true when 'remove' then node <> self and mine is not null and (mine or voters > 2) else coalesce(mine, false) end as allowed from J), N as (select change, M.node, M.learner from A join M on M.cluster = A.cluster and M.node <> A.node union all select change, node, false from A where kind <> 'remove') select change, cluster, node, kind, self, allowed, case when allowed then coalesce((select string_agg(N.node || case when learner then '*' else '' end, ',' order by N.node) from N where N.change = A.change), '') end as after from A")
def member_changes(spark, d):
    members = T.table(spark, d, "nation").where("n_nationkey % 4 <> 1").select(F.col("n_regionkey").cast("long").alias("cluster"), F.col("n_nationkey").cast("long").alias("node"), (F.col("n_nationkey") % 3 == 0).alias("is_learner"))
    s, x = T.table(spark, d, "supplier"), F.expr
    return admin.member_changes(members, s.select(x("s_suppkey").alias("change"), x("cast(s_suppkey % 6 as long)").alias("cluster"), x("cast(s_suppkey * 7 % 27 as long)").alias("node"), x("case s_suppkey % 3 when 0 then 'add' when 1 then 'remove' else 'promote' end").alias("kind"), x("cast(s_suppkey % 5 as long)").alias("self")))


GROUPS = "G as (select n_nationkey as group_id, case when n_nationkey % 4 <> 3 then n_regionkey end as leader_id, n_nationkey * 2 as term, n_nationkey * 10 as commit, case n_nationkey % 3 when 0 then 'leader' when 1 then 'follower' else 'candidate' end as role from nation)"


def _groups(spark, d):
    x = F.expr
    return T.table(spark, d, "nation").select(x("cast(n_nationkey as long)").alias("group_id"), x("if(n_nationkey % 4 <> 3, cast(n_regionkey as long), null)").alias("leader_id"), x("n_nationkey * 2").alias("term"), x("n_nationkey * 10").alias("commit"), x("case n_nationkey % 3 when 0 then 'leader' when 1 then 'follower' else 'candidate' end").alias("role"))


@query(f"with {RANGES}, {GROUPS} select '{{\"meta_epoch\":7,\"ranges\":[' || string_agg('{{\"range_id\":' || range_id || ',\"epoch\":' || epoch || ',\"group_id\":' || R.group_id || ',\"start\":\"' || start || '\",\"end\":\"' || \"end\" || '\",\"healthy\":' || case when leader_id is null then 'false' else 'true' end || '}}', ',' order by start) || ']}}' as json from R left join G on G.group_id = R.group_id")
def page_ranges(spark, d):
    return admin.ranges_page(T.ranges(spark), _groups(spark, d), 7)


FIELDS = "'\"leader_id\":' || coalesce(cast(leader_id as varchar), 'null') || ',\"term\":' || term"
TAIL = "',\"role\":\"' || role || '\",\"is_leader\":' || case when role = 'leader' then 'true' else 'false' end || '}}'"


@query(f"with {GROUPS} select '{{\"groups\":[' || string_agg('{{\"group_id\":' || group_id || ',' || {FIELDS} || ',\"commit\":' || commit || {TAIL.replace('}}', '}')}, ',' order by group_id) || ']}}' as raft, '{{\"groups\":{{' || string_agg('\"' || group_id || '\":{{' || {FIELDS} || {TAIL.replace('}}', '}')}, ',' order by group_id) || '}}}}' as leadership from G")
def page_raft(spark, d):
    return admin.raft_pages(_groups(spark, d))


@query(f"with {RANGES}, {GROUPS} select '{{\"node_id\":3,\"drain\":false,\"range_count\":' || (select count(*) from R) || ',\"leader_group_ids\":[' || string_agg(cast(group_id as varchar), ',' order by group_id) || '],\"meta_epoch\":7}}' as json from G where role = 'leader'")
def page_cluster(spark, d):
    return admin.cluster_page(T.ranges(spark), _groups(spark, d), 3, False, 7)


@query("with X as (select event_id, '{\"ts_unix_ms\":' || event_id * 10 || ',\"kind\":\"' || event_type || '\",\"message\":\"user ' || user_id || '\"}' as j from events where event_type = 'error' order by event_id desc limit 50) select '{\"errors\":[' || string_agg(j, ',' order by event_id) || ']}' as json from X")
def page_errors(spark, d):
    e = T.table(spark, d, "events").where("event_type = 'error'")
    return admin.errors_page(e.select(F.col("event_id").alias("pos"), (F.col("event_id") * 10).alias("ts_unix_ms"), F.col("event_type").alias("kind"), F.format_string("user %d", "user_id").alias("message")))


@query("""with recursive A as (select user_id as name, event_id as pos, case (event_id * 7 // 3) % 11 when 0 then 'finish' else case when event_id % 3 = 0 then 'resume' else 'pause' end end as action, row_number() over (partition by user_id order by event_id) as rn from events),
R(name, rn, status, error) as (select distinct name, cast(0 as bigint), 'idle', cast(null as varchar) from A union all
select A.name, A.rn, case when action = 'pause' and status = 'running' then 'paused' when action = 'resume' and status in ('idle', 'paused') then 'running' when action = 'finish' and status = 'running' then 'complete' else status end, case when action = 'resume' and status = 'complete' then 'already complete' end from R join A on A.name = R.name and A.rn = R.rn + 1)
select A.name, pos, action, status, error from R join A using (name, rn)""")
def backfill_control(spark, d):
    e, x = T.table(spark, d, "events"), F.expr
    return admin.backfill_control(e.select(F.col("user_id").alias("name"), F.col("event_id").alias("pos"), x("if((event_id * 7 div 3) % 11 = 0, 'finish', if(event_id % 3 = 0, 'resume', 'pause'))").alias("action")))
