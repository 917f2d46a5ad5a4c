"""Byte formats: write-ahead records, intents, keys of index entries; Bloom filters as rows of 64-bit words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import HEADER_BYTES, crc32c

#: A record's magic number, version and kinds; the greatest payload.
MAGIC, VERSION, KINDS, MAX_PAYLOAD = 0x4B415941, 1, {"put": 1, "delete": 2, "noop": 3}, 32 << 20
#: The tags of an intent, and what keys of index entries begin with.
INTENT_DELETE, INTENT_PUT, INDEX_DATA = "00", "01", b"\x00idx/data/"


def _empty() -> Column:
    return F.lit(b"")


def little(value: Column, size: int) -> Column:
    """The ``size`` low bytes of a number, least first."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(size))))


def big(value: Column, size: int) -> Column:
    return F.unhex(F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * size, 2 * size))


def number(raw: Column, at: int | Column, size: int, least_first: bool = True) -> Column:
    """The number in ``size`` bytes from place ``at`` (from 1) on; the greatest of 8 bytes wrap to below 0."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substring(raw, at, F.lit(size)))
    if least_first:
        digits = F.concat(*(F.substring(digits, 2 * size - 1 - 2 * i, 2) for i in range(size)))
    return F.conv(digits, 16, -10).cast("long")


def _payload(op: Column, key: Column, value: Column) -> Column:
    put = F.concat(little(F.octet_length(key), 4), little(F.octet_length(value), 4), key, value)
    return F.when(op == "put", put).when(op == "delete", F.concat(little(F.octet_length(key), 4), key)).otherwise(_empty())


def encode_records(records: DataFrame) -> DataFrame:
    """records (lsn, seq, op put | delete | noop, key, value) with ``bytes``: a header of 40, then the payload. A null key
    or value is empty."""
    text = lambda c: F.coalesce(F.col(c).cast("binary"), _empty())
    kind = F.coalesce(*(F.when(F.col("op") == name, n) for name, n in KINDS.items()))
    rows = records.withColumn("__payload", _payload(F.col("op"), text("key"), text("value")))
    head = F.concat(little(F.lit(MAGIC), 4), little(F.lit(VERSION), 2), little(F.lit(HEADER_BYTES), 2), little(F.lit(0), 2), little(kind, 2), little(F.col("lsn"), 8), little(F.col("seq"), 8), little(F.octet_length("__payload"), 4))
    rows = rows.withColumns({"__head": head, "__body": crc32c(F.col("__payload"))})
    rows = rows.withColumn("__check", crc32c(F.concat("__head", little(F.lit(0), 4), little(F.col("__body"), 4))))
    return rows.withColumn("bytes", F.concat("__head", little(F.col("__check"), 4), little(F.col("__body"), 4), F.col("__payload"))).drop("__payload", "__head", "__body", "__check")


def decode_records(rows: DataFrame) -> DataFrame:
    """rows with ``bytes``, a record each, with lsn, seq, op, key and value, or ``error``: the first rule that they break.
    Null or empty bytes are a partial header. Bytes after the record are ignored."""
    raw = F.coalesce(F.col("bytes"), _empty())
    n = lambda at, size: number(raw, at, size)
    size, kind = n(29, 4), n(11, 2)
    payload = F.substring(raw, F.lit(HEADER_BYTES + 1), size.cast("int"))
    head = F.concat(F.substring(raw, 1, 32), little(F.lit(0), 4), F.substring(raw, 37, 4))
    x = rows.withColumns({"__payload": payload, "__head": crc32c(head), "__body": crc32c(payload)})
    key_len, value_len = number(F.col("__payload"), 1, 4), number(F.col("__payload"), 5, 4)
    length, put = F.octet_length("__payload"), kind == KINDS["put"]
    sound = F.when(put, (length >= 8) & (length == 8 + key_len + value_len)).when(kind == KINDS["delete"], (length >= 4) & (length == 4 + key_len)).otherwise(length == 0)
    error = (
        F.when(F.octet_length(raw) < HEADER_BYTES, "partial header").when(n(1, 4) != MAGIC, "bad magic").when(n(5, 2) != VERSION, "unsupported version")
        .when(n(7, 2) != HEADER_BYTES, "bad header length").when(n(9, 2) != 0, "unknown flags").when(~kind.isin(*KINDS.values()), "unknown record type")
        .when(size > MAX_PAYLOAD, "oversized payload").when(n(33, 4) != F.col("__head"), "bad header checksum").when(F.octet_length(raw) < HEADER_BYTES + size, "partial payload")
        .when(n(37, 4) != F.col("__body"), "bad payload checksum").when(~F.coalesce(sound, F.lit(False)), "malformed payload")
    )
    x = x.withColumn("error", error)
    good = lambda c: F.when(F.col("error").isNull(), c)
    op = F.coalesce(*(F.when(kind == code, name) for name, code in KINDS.items()))
    at = F.when(put, 9).otherwise(5)
    key = F.when(kind != KINDS["noop"], F.substring(F.col("__payload"), at, key_len.cast("int")))
    value = F.when(put, F.substring(F.col("__payload"), (9 + key_len).cast("int"), value_len.cast("int")))
    out = {"lsn": good(n(13, 8)), "seq": good(n(21, 8)), "op": good(op), "key": good(key), "value": good(value)}
    return x.withColumns(out).drop("__payload", "__head", "__body")


def encode_intent(op: Column, value: Column) -> Column:
    """A staged write as bytes: a tag, then a put's value."""
    return F.when(op == "delete", F.unhex(F.lit(INTENT_DELETE))).otherwise(F.concat(F.unhex(F.lit(INTENT_PUT)), F.coalesce(value.cast("binary"), _empty())))


def decode_intent(raw: Column) -> Column:
    """struct (op, value, error) of a staged write's bytes."""
    tag, size = F.hex(F.substring(raw, 1, 1)), F.octet_length(raw)
    error = F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when((tag == INTENT_DELETE) & (size != 1), "delete of more than a byte").when(~tag.isin(INTENT_DELETE, INTENT_PUT), "unknown tag")
    op = F.when(error.isNull(), F.when(tag == INTENT_PUT, "put").otherwise("delete"))
    return F.struct(op.alias("op"), F.when(op == "put", F.substring(raw, F.lit(2), size)).alias("value"), error.alias("error"))


def index_key(name: str, secondary: Column, primary: Column) -> Column:
    """An index entry's key: what all begin with, the name and its length, secondary, primary, the primary's length."""
    head = INDEX_DATA + len(name.encode()).to_bytes(2, "big") + name.encode()
    return F.concat(F.lit(head), secondary.cast("binary"), primary.cast("binary"), big(F.octet_length(primary), 4))


def parse_index_key(name: str, key: Column) -> Column:
    """struct (secondary, primary) of an index entry's key; null for keys of another index, or of none."""
    head = INDEX_DATA + len(name.encode()).to_bytes(2, "big") + name.encode()
    size, rest = F.octet_length(key), len(head)
    primary = number(key, size - 3, 4, least_first=False).cast("int")
    fits = (size >= rest + 4) & (F.substring(key, 1, rest) == F.lit(head)) & (size >= rest + 4 + primary)
    parts = F.struct(F.substring(key, F.lit(rest + 1), size - 4 - primary - rest).alias("secondary"), F.substring(key, size - 3 - primary, primary).alias("primary"))
    return F.when(fits, parts)


def _places(rows: DataFrame, bits_per_key: int) -> DataFrame:
    """rows (table_id, key, bits) with each bit that a key sets: two checksums, the second odd, step by step."""
    steps = max(1, math.ceil(bits_per_key * math.log(2)))
    rows = rows.withColumn("__one", crc32c(F.col("key").cast("binary")))
    rows = rows.withColumn("__two", crc32c(F.concat(F.col("key").cast("binary"), little(F.col("__one"), 4))).bitwiseOR(F.lit(1).cast("long")))
    return rows.withColumn("__bit", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: (F.col("__one") + i * F.col("__two")) % F.col("bits"))))


def build_bloom(entries: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """entries (table_id, key, distinct within a table) as filters: (table_id, bits, word, mask), a row for each 64 bits
    that are not all 0, so a filter of any size is spread over tasks."""
    sizes = entries.groupBy("table_id").agg((F.ceil(F.greatest(F.count("*") * bits_per_key, F.lit(64)) / 8) * 8).cast("long").alias("bits"))
    bit = _places(entries.join(sizes, "table_id"), bits_per_key)
    mask = F.expr("shiftleft(1L, cast(__bit % 64 as int))")
    return bit.groupBy("table_id", "bits", F.expr("__bit div 64").alias("word")).agg(F.bit_or(mask).alias("mask"))


def might_contain(filters: DataFrame, probes: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """probes (table_id, key), each once, with ``might``: False only if the table surely lacks the key; a table without a
    filter has none."""
    sizes = filters.select("table_id", "bits").distinct()
    bit = _places(probes.select("table_id", "key").join(sizes, "table_id"), bits_per_key).withColumn("word", F.expr("__bit div 64"))
    hit = bit.join(filters.select("table_id", "word", "mask"), ["table_id", "word"], "left")
    is_set = F.coalesce(F.expr("shiftright(mask, cast(__bit % 64 as int)) & 1L"), F.lit(0)) == 1
    told = hit.groupBy("table_id", "key").agg(F.bool_and(is_set).alias("might"))
    return probes.join(told, ["table_id", "key"], "left").withColumn("might", F.coalesce("might", F.lit(False)))
