"""Inscriptions in the witness bytes of transaction inputs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StructType

# Fixed values of the script format: a false condition around pushes that begin with the protocol's name.
OPENING = b"\x00\x63\x03ord"
OP_FALSE, OP_IF, OP_ENDIF = 0x00, 0x63, 0x68
PUSH_1, PUSH_2, PUSH_4, NEGATE, NUMBER_1, NUMBER_16 = 0x4C, 0x4D, 0x4E, 0x4F, 0x51, 0x60
ANNEX = 0x50
CONTENT_TYPE = b"\x01"

FOUND = ArrayType(StructType().add("content_type", "string").add("content_string", "string"))


def instructions(script: bytes) -> Iterator[tuple[int, bytes | None]]:
    """(operation, pushed bytes or None); ends before an instruction that is cut off."""
    at = 0
    while at < len(script):
        op, at = script[at], at + 1
        size = op if op < PUSH_1 else 0
        if wide := {PUSH_1: 1, PUSH_2: 2, PUSH_4: 4}.get(op):
            size, at = int.from_bytes(script[at : at + wide], "little"), at + wide
        if at + size > len(script):
            return
        if op <= PUSH_4:
            yield op, script[at : at + size]
        elif op == NEGATE:
            yield op, b"\x81"
        elif NUMBER_1 <= op <= NUMBER_16:
            yield op, bytes([op - NUMBER_1 + 1])
        else:
            yield op, None
        at += size


def _text(value: bytes | None) -> str | None:
    try:
        return None if value is None else value.decode()
    except UnicodeDecodeError:
        return None


def envelopes(script: bytes) -> list[dict]:
    """Content type and text of each whole envelope of a script, in order; an open or broken one is none."""
    found, recent, pushes = [], [], None
    for op, pushed in instructions(script):
        if pushes is None:
            recent = [*recent[-2:], (op, pushed)]
            if [x[0] for x in recent] == [OP_FALSE, OP_IF, 3] and pushed == OPENING[3:]:
                pushes = []
        elif pushed is not None:
            pushes.append(pushed)
        else:
            if op == OP_ENDIF:
                body = next((i for i in range(0, len(pushes), 2) if pushes[i] == b""), None)
                fields = pushes[:body]
                kind = next((fields[i + 1] for i in range(0, len(fields) - 1, 2) if fields[i] == CONTENT_TYPE), None)
                found.append({"content_type": _text(kind), "content_string": _text(None if body is None else b"".join(pushes[body + 1 :]))})
            recent, pushes = [], None
    return found


@pandas_udf(FOUND)
def _envelopes(scripts: pd.Series) -> pd.Series:
    return scripts.map(envelopes)


def read_envelopes(inputs: DataFrame) -> DataFrame:
    """Inscriptions of inputs (height, tx_index, txid, input_index, witness array of binary).

    The script is the element before the last, an annex left out; only scripts that hold the opening bytes go
    to Python. Envelopes are counted through a transaction: the count is the inscription's index and number.
    Content that is not UTF-8, or absent, is null. Null or short witnesses have no inscriptions.
    """
    whole = F.col("witness")
    annex = (F.size(whole) >= 2) & F.hex(F.element_at(whole, -1)).startswith(f"{ANNEX:02X}")
    place = F.when(annex, F.size(whole) - 2).otherwise(F.size(whole) - 1)
    scripts = inputs.withColumn("_script", F.when(place >= 1, F.get(whole, place - 1))).where(F.contains("_script", F.lit(OPENING)))
    each = scripts.select("height", "tx_index", "txid", "input_index", F.posexplode(_envelopes("_script")).alias("_at", "e"))
    index = F.row_number().over(Window.partitionBy("txid").orderBy("input_index", "_at")) - 1
    numbered = each.withColumn("inscription_number", index)
    return numbered.select("height", "tx_index", F.concat("txid", F.lit("i"), F.col("inscription_number").cast("string")).alias("inscription_id"), "inscription_number", "e.content_type", "e.content_string")
