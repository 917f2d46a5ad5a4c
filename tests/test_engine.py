"""The store in a folder, and its command line."""

import random

import pytest

from verlog.__main__ import main
from verlog.engine import Store
from verlog.errors import InvalidArgument, StoreError, TxnConflict

from .test_operators import rows


def test_store_against_model(spark, tmp_path):
    random.seed(2)
    of, state, at = Store(spark, str(tmp_path / "s")), {}, {}
    assert of.get("a") is None and of.flush() == of.compact() == of.last_sequence() == 0
    seq = 0
    for step in range(3):
        batch = []
        for _ in range(8):
            key, op = f"k{random.randint(0, 5)}", random.choice(["put", "put", "delete"])
            batch.append((key, op, f"v{seq}" if op == "put" else None))
            seq += 1
            state = {**state, key: batch[-1][2]}
            at[seq] = dict(state)
        assert of.write(batch) == seq
        if step < 2:
            assert of.flush() == 8 and of.flush() == 0
    live = lambda s: sorted((k, v) for k, v in s.items() if v is not None)
    for ts in (5, 13, 24):
        assert rows(of.scan("k", ts)) == live(at[ts])
    assert of.set_watermark(16) == 16 and of.set_watermark(3) == 16
    assert of.compact() == 2 and of.compact() == 0
    assert of.stats() == {"tables": 1, "unflushed": 8, "flushed_sequence": 16, "last_sequence": 24, "watermark": 16}
    again = Store(spark, str(tmp_path / "s"))
    for ts in (16, 20, 24):
        assert rows(again.scan("", ts)) == live(at[ts])
    other = Store(spark, str(tmp_path / "t"))
    assert other.install(again.backup(str(tmp_path / "b"))) == 24 and rows(other.scan()) == live(state) and other.put("z", "1") == 25
    with pytest.raises(StoreError):
        other.install(again.backup(str(tmp_path / "c")))


def test_refusals_indexes_and_cursors(spark, tmp_path):
    of = Store(spark, str(tmp_path / "s"))
    with pytest.raises(InvalidArgument):
        of.put("", "x")
    with pytest.raises(InvalidArgument):
        of.put("\x00idx", "x")
    assert of.last_sequence() == 0 and of.write([("\x00idx", "put", "x")], raw=True) == 1
    of.write([("user:1", "put", "ann|admin"), ("user:2", "put", "bob")])
    assert of.create_index("role", "user:", "field", "|1") == {"scanned": 2, "indexed": 1}
    with pytest.raises(InvalidArgument):
        of.create_index("role", "user:")
    assert rows(of.scan_index("role")) == [("admin", "user:1")]
    of.drop_index("role")
    with pytest.raises(InvalidArgument):
        of.scan_index("role")
    assert of.create_index("role", "user:", "prefix", "2")["indexed"] == 2
    assert [r["seq"] for r in of.poll("c", 2).collect()] == [1, 2]
    of.checkpoint("c", 2)
    assert [r["seq"] for r in of.poll("c", 2).collect()] == [3] and rows(of.lag()) == [("c", 1)]


def test_transactions(spark, tmp_path):
    of = Store(spark, str(tmp_path / "s"))
    of.put("a", "1")
    one, two = of.begin(), of.begin()
    one.put("a", "2")
    two.put("a", "3")
    two.delete("b")
    assert (one.get("a"), two.get("a"), two.get("b")) == ("2", "3", None)
    one.commit()
    with pytest.raises(TxnConflict):
        two.commit()
    with pytest.raises(InvalidArgument):
        two.put("a", "4")
    third = of.begin()
    third.put("a", "5")
    third.rollback()
    assert of.get("a") == "2" and of.get("a", 1) == "1" and of.begin().commit() == 2


def test_command_line(spark, tmp_path, capsys):
    run = lambda *a: main(["--data", str(tmp_path / "s"), *a], spark)
    assert run("put", "k1", "v1") == run("put", "k2", "v2") == run("delete", "k2") == 0
    assert run("get", "k1") == 0 and run("get", "k2") == 2 and run("get", "k2", "--at", "2") == 0
    assert run("put", "", "x") == 4 and run("flush") == 0 and run("scan", "k") == 0
    out = capsys.readouterr().out.split("\n")
    assert out[3:6] == ["v1", "v2", "3"] and out[6] == '{"key": "k1", "value": "v1"}'
