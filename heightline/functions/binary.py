"""Byte-level columns: script hashes, big-endian numbers, length-prefixed text, outpoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reversed_bytes(raw: Column) -> Column:
    """Bytes in reverse; reverse() itself would read them as text."""
    return F.unhex(F.regexp_replace(F.reverse(F.hex(raw)), "(.)(.)", "$2$1"))


def script_hash(script: Column) -> Column:
    """Lower-case hex of the reversed sha256 of a script."""
    return F.lower(F.hex(reversed_bytes(F.unhex(F.sha2(script, 256)))))


def be32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0"))


def be64(n: Column) -> Column:
    """Two's complement of a signed 64-bit number."""
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 16, "0"))


def be64_unsigned(n: Column) -> Column:
    return F.unhex(F.lpad(F.conv(n.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0"))


def utf8(s: Column | str) -> Column:
    return F.encode(F.lit(s) if isinstance(s, str) else s, "UTF-8")


def prefixed(s: Column | str) -> Column:
    """Length in bytes as a big-endian u32, then the bytes."""
    raw = utf8(s)
    return F.concat(be32(F.octet_length(raw)), raw)


def marker(present: Column) -> Column:
    return F.when(present, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))


def hash_bytes(display: Column) -> Column:
    """Bytes of a block hash or txid in their internal order, which is the reverse of what is shown."""
    return reversed_bytes(F.unhex(display))


def sha256_hex(raw: Column) -> Column:
    return F.sha2(raw, 256)


def outpoint_text(txid: Column, vout: Column) -> Column:
    return F.concat_ws(":", txid, vout.cast("string"))


def outpoint_bytes(txid: Column, vout: Column) -> Column:
    return F.concat(hash_bytes(txid), be32(vout))


def script_kind(script: Column) -> Column:
    """Class of a script, tested in this order."""
    h, n = F.hex(script), F.octet_length(script)
    return (
        F.when((n == 34) & h.startswith("5120"), "p2tr")
        .when((n == 22) & h.startswith("0014"), "p2wpkh")
        .when((n == 34) & h.startswith("0020"), "p2wsh")
        .when((n == 23) & h.startswith("A914") & h.endswith("87"), "p2sh")
        .when((n == 25) & h.startswith("76A914") & h.endswith("88AC"), "p2pkh")
        .when(h.startswith("6A"), "op_return")
        .otherwise("non_standard")
    )


def is_op_return(script: Column) -> Column:
    return F.hex(script).startswith("6A")
