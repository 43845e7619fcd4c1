"""From tables to block files and back: orders become serialised transactions in files, and the files a ledger."""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heightline.functions import binary as B
from heightline.operators import chain, ledger
from heightline.sources import rawblocks
from heightline.sources import testdata as T
from heightline.sources.blockfiles import MAGIC
from heightline.sources.blockstream import RANGE, BlockFiles, Options
from heightline.staging import shared_dir, staged

#: Days whose blocks are in one file, at most, and about the most bytes of a file with several.
DAYS = 256
FILE = 64 << 20
VERSION = struct.pack("<I", 1)


def _hex(n: Column, width: int) -> Column:
    """Hexadecimal digits of a number of so many bytes, little-endian."""
    digits = F.lpad(F.hex(n.cast("bigint")), 2 * width, "0")
    return F.concat(*(F.substring(digits, 2 * i - 1, 2) for i in range(width, 0, -1)))


def _compact(n: Column) -> Column:
    """As rawblocks.compact, in hexadecimal digits."""
    return F.when(n < 0xFD, _hex(n, 1)).when(n < 1 << 16, F.concat(F.lit("fd"), _hex(n, 2))).otherwise(F.concat(F.lit("fe"), _hex(n, 4)))


def serialised(rows: DataFrame) -> DataFrame:
    """rows (o_orderkey, prev, outs) with raw: transactions whose input is output 1 of the one whose hash is prev, or none.

    Built-in functions write what rawblocks.serialised does. A coinbase's input script is its key, which its hash covers: equal outputs make other transactions.
    """
    fixed = lambda digits: F.unhex(F.lit(digits))
    coinbase = F.concat(fixed("00" * 32 + "ffffffff" + "08"), F.unhex(_hex(F.col("o_orderkey"), 8)))
    spent = F.when(F.col("prev").isNull(), coinbase).otherwise(F.concat("prev", fixed("01000000" + "00")))
    return rows.withColumn("raw", F.concat(fixed("02000000" + "01"), spent, fixed("ffffffff"), "outs", fixed("00000000")))


def transactions(s: SparkSession, d: str) -> DataFrame:
    """o_orderkey, day and raw: orders as transactions whose lines are outputs; every second order of a customer spends the second output of the one before it."""
    value = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    script = F.when(F.col("l_linenumber") == 1, "036a01ff").otherwise(F.concat(F.lit("160014"), F.substring(F.sha2((F.col("l_partkey") % 50).cast("string"), 256), 1, 40)))
    lines = T.table(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", value.alias("value"), F.unhex(F.concat(_hex(value, 8), script)).alias("raw")).alias("o"))
    whole = F.transform(F.sort_array(F.collect_list("o")), lambda o: F.hex(o["raw"]))  # the lines of an order
    outs = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_join(whole, "").alias("_outs"))
    outs = outs.select("l_orderkey", "n", F.unhex(F.concat(_compact(F.col("n")), "_outs")).alias("outs"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = T.table(s, d, "orders").select("o_orderkey", T.day("o_orderdate").alias("day"), F.row_number().over(order).alias("_r"), F.lag("o_orderkey").over(order).alias("_before"))
    rows = staged(orders.join(outs, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey"), "orders")
    first = serialised(rows.where("_r % 2 = 1").withColumn("prev", F.lit(None).cast("binary")))
    wide = first.where("n > 1").select(F.col("o_orderkey").alias("_before"), F.unhex(F.sha2(F.unhex(F.sha2("raw", 256)), 256)).alias("prev"))
    then = serialised(rows.where("_r % 2 = 0").join(wide, "_before", "left"))
    return first.unionByName(then).select("o_orderkey", "day", "raw")


def write_files(s: SparkSession, txs: DataFrame, folder: str) -> int:
    """Writes a block for each day into files of days, each by one task, a block at a time; how many blocks that makes.

    Headers form a chain in order of days and hold no digest of their transactions, so a block's parent is known before its bytes are.
    """
    txs = staged(txs, "transactions")
    days = sorted(tuple(r) for r in txs.groupBy("day").agg(F.sum(F.octet_length("raw"))).collect())  # one entry a block, which its header makes anyway
    prev, parents, file, began, held = bytes(32), [], 0, 0, 0
    for day, size in days:
        if parents and (held + size > FILE or len(parents) - began == DAYS):
            file, began, held = file + 1, len(parents), 0
        held += size
        parents.append((day, prev, file))
        prev = hashlib.sha256(hashlib.sha256(_header(prev, day)).digest()).digest()
    known = s.createDataFrame(pa.Table.from_pylist([dict(zip(("day", "prev", "file"), p)) for p in parents], pa.schema({"day": pa.int64(), "prev": pa.binary(), "file": pa.int64()})))
    placed = txs.join(F.broadcast(known), "day")  # one row a block
    dealt = placed.repartition("file").sortWithinPartitions("file", "day", "o_orderkey").select("file", "day", "prev", "raw")

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        at, out, made, waiting, prev = (None, None), None, 0, [], b""

        def close():
            body = _header(prev, at[1]) + rawblocks.compact(len(waiting)) + b"".join(waiting)
            out.write(struct.pack("<II", MAGIC, len(body)) + body)

        for batch in batches:
            for file, day, parent, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (file, day) != at:
                    if waiting:
                        close()
                    if file != at[0]:
                        if out:
                            out.close()
                        out = store.open_output_stream(f"{root}/blk{file:05}.dat")
                    at, waiting, prev, made = (file, day), [], parent, made + 1
                waiting.append(raw)
        if waiting:
            close()
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], ["blocks"])

    return dealt.mapInArrow(run, "blocks long").agg(F.sum("blocks")).first()[0] or 0


def _header(prev: bytes, day: int) -> bytes:
    return VERSION + prev + bytes(32) + struct.pack("<III", day, 0, 0)


def from_files(s: SparkSession, folder: str, each: int) -> DataFrame:
    """The ledger of the block files in a folder: read by byte ranges, decoded, linked to a chain, and summed up."""
    s.dataSource.register(BlockFiles)
    records = staged(s.read.format("block_files").option("path", folder).option("range", each).load().select("block_hash", "prev_hash", "payload"), "records")
    heights = chain.linearize(records.select("block_hash", "prev_hash"))
    decoded = rawblocks.decode(records.select("block_hash", "payload")).join(heights, "block_hash")
    parts = staged(decoded.select("height", "txid", "place", "prev_txid", "prev_vout", "value", "script_pubkey"), "parts")
    outs = rawblocks.outputs(parts).select(F.unhex("txid").alias("prev_txid"), F.col("vout").alias("prev_vout"), "height", F.col("value").cast("bigint").alias("value"), F.col("script_pubkey").alias("account"))
    spends = ledger.resolved_inputs(rawblocks.inputs(parts).select("height", F.unhex("prev_txid").alias("prev_txid"), "prev_vout"), outs, ["prev_txid", "prev_vout"]).where("account is not null")
    return of_scripts(outs, spends)


def of_scripts(outs: DataFrame, spends: DataFrame) -> DataFrame:
    """The ledger of outputs and spends whose accounts are scripts; these are hashed behind the sums of a script and height."""
    moved = ledger.deltas(ledger.signed_rows(outs, spends)).withColumn("account", B.script_hash(F.col("account")))
    return ledger.running_balance(staged(moved, "deltas"))


def block_file_ledger(s: SparkSession, d: str) -> DataFrame:
    folder = f"{shared_dir(s)}/blocks-{uuid.uuid4().hex}"
    write_files(s, transactions(s, d), folder)
    held = sum(size for _, size in Options({"path": folder}).files())
    return from_files(s, folder, min(max(held // (8 * s.sparkContext.defaultParallelism), 1 << 20), RANGE))


def sql(reversed_hash: str) -> str:
    """reversed_hash: the SQL of an account from a script."""
    return f"""WITH lines AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, value, script) - 1 AS vout, value, script
  FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS value, CASE WHEN l_linenumber = 1 THEN '6A01FF' ELSE '0014' || upper(substr(sha256((l_partkey % 50)::VARCHAR), 1, 40)) END AS script FROM lineitem)
), ranked AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER c AS r, lag(o_orderkey) OVER c AS before FROM orders WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderkey)
), txs AS (
  SELECT o_orderkey, (dense_rank() OVER (ORDER BY day) - 1)::BIGINT AS height, CASE WHEN r % 2 = 0 THEN before END AS prev FROM ranked WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
), outputs AS (
  SELECT o_orderkey, vout, height, value, {reversed_hash} AS account FROM lines JOIN txs ON l_orderkey = o_orderkey WHERE script NOT LIKE '6A%'
), moved AS (
  SELECT account, height, value AS delta FROM outputs UNION ALL SELECT o.account, t.height, -o.value FROM txs t JOIN outputs o ON o.o_orderkey = t.prev AND o.vout = 1
), summed AS (SELECT account, height, sum(delta)::BIGINT AS delta FROM moved GROUP BY account, height)
SELECT account, height, delta, (sum(delta) OVER (PARTITION BY account ORDER BY height ROWS UNBOUNDED PRECEDING))::BIGINT AS balance FROM summed"""
