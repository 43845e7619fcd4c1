"""Block files, block JSON and inscription fixtures as tables."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the network's record magic, little-endian.
MAGIC = 0xD9B4BEF9
ZERO_TXID = "0" * 64
#: Blocks that leave a task at once.
AT_ONCE = 64
RECORDS = "file string, record_index bigint, file_offset bigint, block_hash string, prev_hash string, time bigint, payload binary"


def records(data: bytes, key: bytes = b"", magic: int = MAGIC) -> Iterator[tuple[int, bytes]]:
    """Offset and payload of each record: magic, size, payload. Zero padding ends a file."""
    if any(key):
        data = (np.frombuffer(data, np.uint8) ^ np.resize(np.frombuffer(key, np.uint8), len(data))).tobytes()
    at = 0
    while at + 8 <= len(data):
        found, size = struct.unpack_from("<II", data, at)
        if found == 0 and not any(data[at : at + 8]):
            return
        if found != magic:
            raise ValueError(f"bad magic {found:08x} at {at}")
        if at + 8 + size > len(data):
            raise ValueError(f"short payload at {at}")
        yield at + 8, data[at + 8 : at + 8 + size]
        at += 8 + size


def read_block_files(spark: SparkSession, path: str, key: bytes = b"", magic: int = MAGIC, skip_last: bool = True) -> DataFrame:
    """One row a block. A file is one task's work; the last one may be incomplete and is left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "blk*.dat").load(path).select("path", "content")
    if skip_last:
        last = files.agg(F.max("path").alias("_last"))
        files = files.join(F.broadcast(last), F.col("path") < F.col("_last")).drop("_last")

    def parse(frames):
        for frame in frames:
            for name, content in zip(frame.path, frame.content):
                found = ((name, i, at, hashlib.sha256(hashlib.sha256(p[:80]).digest()).digest()[::-1].hex(), p[4:36][::-1].hex(), struct.unpack_from("<I", p, 68)[0], p) for i, (at, p) in enumerate(records(content, key, magic)))
                while rows := list(islice(found, AT_ONCE)):
                    yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RECORDS.split(", ")])

    return files.mapInPandas(parse, RECORDS)


def decoded(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs and outputs of block JSON rows (height, txs); coinbase inputs and OP_RETURN outputs are dropped.

    txs: array of (txid, vin array of (txid, vout), vout array of (value, script binary)).
    """
    return decoded_transactions(blocks.select("height", F.posexplode("txs").alias("tx_index", "tx")))


def decoded_transactions(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As decoded, of rows (height, tx_index, tx) that hold a transaction each."""
    vin = tx.select("height", "tx_index", F.col("tx.txid").alias("txid"), F.posexplode("tx.vin").alias("input_index", "i")).select("height", "tx_index", "txid", "input_index", F.col("i.txid").alias("prev_txid"), F.col("i.vout").alias("prev_vout")).where("prev_txid is not null")
    vout = tx.select("height", "tx_index", F.col("tx.txid").alias("txid"), F.posexplode("tx.vout").alias("vout", "o")).select("height", "tx_index", "txid", F.col("vout").cast("bigint"), F.col("o.value").alias("value"), F.col("o.script").alias("script_pubkey"))
    return vin, vout.where(~F.hex("script_pubkey").startswith("6A"))


INSCRIPTION = "struct<inscription_id:string,inscription_number:int,timestamp:bigint,satpoint:string,content_type:string,content_string:string>"


def read_inscriptions(spark: SparkSession, path: str, block_times: DataFrame | None = None) -> DataFrame:
    """Fixture files {"blocks": {height: [inscription]}}; a missing timestamp is the block's, else 0."""
    raw = spark.read.schema(f"blocks map<string,array<{INSCRIPTION}>>").option("multiLine", True).json(path)
    rows = raw.select(F.explode("blocks").alias("height", "items")).select(F.col("height").cast("bigint").alias("height"), F.posexplode("items").alias("inscription_index", "i")).select("height", "inscription_index", "i.*")
    if block_times is not None:
        rows = rows.join(block_times.select("height", F.col("time").alias("_t")), "height", "left").withColumn("timestamp", F.coalesce("timestamp", "_t")).drop("_t")
    return rows.withColumn("timestamp", F.coalesce("timestamp", F.lit(0)))


def linearized_index(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """Heights joined to the place of each block in its file."""
    return index.join(blocks.select("block_hash", "file", "file_offset", "record_index"), "block_hash")


def index_gaps(index: DataFrame) -> DataFrame:
    """Heights of a restored index with no entry below them; any but the first means a rebuild."""
    below = index.select((F.col("height") + 1).alias("height"))
    return index.join(below, "height", "left_anti").where("height > 0")


def index_verdict(index: DataFrame, tip: DataFrame) -> DataFrame:
    """One row, outcome and reason: what to do with a restored index (height, block_hash, prev_hash), given the tip (height, block_hash).

    reuse: it is whole and ends at the tip. extend: it is whole and ends below. rebuild: it is empty, holds two blocks of one
    height, lacks a height, has a block whose parent isn't the one below it, ends above the tip, or has another block there.
    """
    below = index.select((F.col("height") + 1).alias("height"), F.col("block_hash").alias("_below"))
    sizes = index.agg(F.count("*").alias("n"), F.count_distinct("height").alias("heights"), F.min("height").alias("low"), F.max("height").alias("high"))
    broken = index.join(below, "height").agg(F.count_if(~F.col("_below").eqNullSafe(F.col("prev_hash"))).alias("broken"))
    ends = tip.select(F.col("height").alias("tip"), F.col("block_hash").alias("tip_hash"))
    at = index.join(ends, (F.col("height") == F.col("tip"))).agg(F.count("*").alias("there"), F.count_if(F.col("block_hash") == F.col("tip_hash")).alias("same"))
    reason = (
        F.when(F.col("n") == 0, "empty").when(F.col("n") > F.col("heights"), "fork").when((F.col("low") > 0) | (F.col("heights") <= F.col("high")), "gap").when(F.col("broken") > 0, "broken_link")
        .when(F.col("high") > F.col("tip"), "beyond_tip").when(F.col("there") > F.col("same"), "other_tip")
    )
    one = sizes.join(broken).join(at).join(ends.select("tip"))  # one row each
    outcome = F.when(F.col("reason").isNotNull(), "rebuild").when(F.col("high") == F.col("tip"), "reuse").otherwise("extend")
    return one.withColumn("reason", reason).select(outcome.alias("outcome"), "reason", "high", "tip")
