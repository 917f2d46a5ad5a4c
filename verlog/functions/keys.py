"""Column functions on keys, values and clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def successor(prefix: bytes) -> bytes | None:
    """The least key above all keys with this prefix; None if there is none. Scans become ranges that reach Parquet."""
    trimmed = prefix.rstrip(b"\xff")
    return trimmed[:-1] + bytes([trimmed[-1] + 1]) if trimmed else None


def has_prefix(key: str, prefix: str) -> Column:
    """Text keys: a pushed-down StringStartsWith."""
    return F.col(key).startswith(prefix) if prefix else F.lit(True)


def extract_whole(value: Column) -> Column:
    return value


def extract_prefix(value: Column, n: int) -> Column:
    return F.substring(value, 1, n)


def extract_field(value: Column, delimiter: str, index: int) -> Column:
    """Field ``index`` from 0; null if there are fewer. The delimiter is quoted, as split takes a pattern."""
    return F.get(F.split(value, "\\Q" + delimiter + "\\E", -1), F.lit(index))


def hlc_pack(ms: Column, logical: Column) -> Column:
    return F.shiftleft(ms.cast("long"), 16).bitwiseOR(F.least(logical.cast("long"), F.lit(65535)))


def hlc_ms(stamp: Column) -> Column:
    return F.shiftright(stamp, 16)


def hlc_logical(stamp: Column) -> Column:
    return stamp.bitwiseAND(F.lit(65535).cast("long"))


def entry_bytes(key: Column, value: Column) -> Column:
    """Accounting of an entry: key, eight bytes, value."""
    return F.octet_length(key) + 8 + F.coalesce(F.octet_length(value), F.lit(0))
