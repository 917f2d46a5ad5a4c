"""Byte formats, recorded runs and generators against golden cases and brute force."""

import math
import random
from itertools import islice

from pyspark.sql import functions as F

from verlog.operators import admin, codec, simulate

from .test_operators import rows


def checksum(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_record_bytes(spark):
    df = spark.createDataFrame([(7, 9, "put", "k", "vv"), (8, 10, "delete", "k", None), (2**40, 11, "noop", None, None), (1, 1, "put", "", "")], "lsn long, seq long, op string, key string, value string")
    got = {r["lsn"]: bytes(r["bytes"]) for r in codec.encode_records(df).collect()}
    body = (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"kvv"
    head = b"".join(n.to_bytes(size, "little") for n, size in ((codec.MAGIC, 4), (1, 2), (40, 2), (0, 2), (1, 2), (7, 8), (9, 8), (len(body), 4), (0, 4), (checksum(body), 4)))
    assert got[7] == head[:32] + checksum(head).to_bytes(4, "little") + head[36:] + body
    back = codec.decode_records(codec.encode_records(df).select("bytes"))
    assert sorted((r["lsn"], r["op"], r["error"]) for r in back.collect()) == [(1, "put", None), (7, "put", None), (8, "delete", None), (2**40, "noop", None)]
    wrong = body[:4] + (9).to_bytes(4, "little") + b"kvv"  # a value length that does not fit, with right checksums
    head = head[:36] + checksum(wrong).to_bytes(4, "little")
    odd = head[:32] + checksum(head).to_bytes(4, "little") + head[36:] + wrong
    df = spark.createDataFrame([(odd,), (b"",), (None,), (got[7][:40],), (got[7] + b"tail",)], "bytes binary")
    assert [r["error"] for r in codec.decode_records(df).collect()] == ["malformed payload", "partial header", "partial header", "partial payload", None]


def test_intents(spark):
    df = spark.createDataFrame([(b"\x00",), (b"\x01",), (b"\x01v",), (b"",), (b"\x00x",), (b"\x07",), (None,)], "b binary")
    got = [tuple(r["x"]) for r in df.select(codec.decode_intent(F.col("b")).alias("x")).collect()]
    assert got == [("delete", None, None), ("put", b"", None), ("put", b"v", None), (None, None, "empty"), (None, None, "delete of more than a byte"), (None, None, "unknown tag"), (None, None, "empty")]


def test_bloom_against_brute_force(spark):
    random.seed(5)
    keys = {t: [f"{t}-{i}" for i in range(n)] for t, n in ((1, 3), (2, 500))}
    probes = [(t, f"{random.choice((1, 2))}-{i}") for t in (1, 2, 3) for i in range(300)]

    def places(key, bits):
        one = checksum(key.encode())
        two = checksum(key.encode() + one.to_bytes(4, "little")) | 1
        return {(one + i * two) % bits for i in range(math.ceil(10 * math.log(2)))}

    filters = {}
    for t, held in keys.items():
        bits = -(-max(64, 10 * len(held)) // 8) * 8
        filters[t] = bits, set().union(*(places(k, bits) for k in held))
    want = sorted({(t, k, t in filters and places(k, filters[t][0]) <= filters[t][1]) for t, k in probes})
    built = codec.build_bloom(spark.createDataFrame([(t, k) for t, held in keys.items() for k in held], "table_id long, key string"))
    got = codec.might_contain(built, spark.createDataFrame(sorted(set(probes)), "table_id long, key string"))
    assert rows(got.select("table_id", "key", "might")) == want


def test_draws_and_runs(spark):
    assert next(simulate.draws(1)) == 1082269761 and next(simulate.draws(0)) == next(simulate.draws(simulate.ZERO_SEED))
    assert all(0 < x < 1 << 64 for x in islice(simulate.draws(3), 1000))
    seeds = spark.createDataFrame([(1,), (2,), (1,)], "seed long")
    got = simulate.generate(seeds, 400).collect()
    one = [tuple(r) for r in got if r["seed"] == 1]
    assert len(got) == 1200 and all(one.count(r) == 2 for r in one[:20])
    share = sum(r["cmd"] == "put" for r in got) / len(got)
    assert 0.35 < share < 0.55 and {r["cmd"] for r in got} <= set(simulate.COMMANDS)
    assert all((r["val"] is not None) == (r["cmd"] == "put") for r in got)
    assert simulate.generate(seeds.limit(0), 5).count() == 0


def test_scans_against_model(spark):
    random.seed(9)
    ops, state, want = [], {}, []
    for pos in range(300):
        kind = random.choice(["put", "put", "delete", "scan"])
        key, ok = f"{random.choice('ab')}{random.randint(0, 4)}", random.random() > 0.1
        if kind == "scan":
            prefix = random.choice(["", "a", "b1", "zz", "a0long"])
            live = sorted((k, v) for k, v in state.items() if k.startswith(prefix))
            seen = list(live)
            if random.random() < 0.3:
                seen = random.choice([seen[1:], seen[::-1], [(k, v + "!") for k, v in seen], seen + [("c", "x")]])
            if ok and seen != live:
                want.append((pos, prefix, len(live), len(seen)))
            ops.append((pos, "scan", None, None, prefix, seen, ok))
        else:
            ops.append((pos, kind, key, f"v{pos}" if kind == "put" else None, None, None, ok))
            if ok:
                state[key] = f"v{pos}" if kind == "put" else None
                state = {k: v for k, v in state.items() if v is not None}
    df = spark.createDataFrame(ops, "pos long, op string, key string, value string, prefix string, observed array<struct<key:string,value:string>>, ok boolean")
    assert want and rows(simulate.scan_violations(df)) == want
    assert simulate.scan_violations(df.limit(0)).count() == 0


def test_running_sums_over_blocks(spark):
    df = spark.createDataFrame([("a", i, i % 7) for i in range(100)] + [("b", 50, 3)], "p string, at long, n long")
    got = {(r["p"], r["at"]): r["n"] for r in simulate.running(df, ["p"], "at", ["n"], block=8).collect()}
    assert all(got["a", i] == sum(k % 7 for k in range(i + 1)) for i in range(100)) and got["b", 50] == 3


def test_pages_of_nothing(spark):
    groups = spark.createDataFrame([], "group_id long, leader_id long, term long, commit long, role string")
    assert tuple(admin.raft_pages(groups).first()) == ('{"groups":[]}', '{"groups":{}}')
    members = spark.createDataFrame([(1, 1, False), (1, 2, False), (1, 3, True)], "cluster long, node long, is_learner boolean")
    asked = [(0, 1, "remove", 2, 1), (1, 1, "remove", 3, 1), (2, 1, "promote", 3, 1), (3, 1, "promote", 2, 1), (4, 1, "add", 9, 1), (5, 7, "remove", 1, 2)]
    changes = spark.createDataFrame(asked, "change long, cluster long, kind string, node long, self long")
    got = rows(admin.member_changes(members, changes).select("change", "allowed", "after"))
    assert got == [(0, False, None), (1, True, "1,2"), (2, True, "1,2,3"), (3, False, None), (4, True, "1,2,3*,9"), (5, False, None)]
