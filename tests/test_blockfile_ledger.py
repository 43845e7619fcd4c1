import os
import struct

import pytest
from pyspark.sql import functions as F

from heightline.plans import blockfile_ledger, catalog
from heightline.sources import rawblocks
from heightline.sources.blockstream import Options
from tests.oracle import TABLES, same


@pytest.fixture(scope="module")
def twice(spark, sf_dir, tmp_path_factory):
    """The tables with every order a second time, of another customer and under another key."""
    folder = tmp_path_factory.mktemp("twice")
    for t in TABLES:
        os.symlink(f"{sf_dir}/{t}.parquet", folder / f"{t}.parquet") if t not in ("orders", "lineitem") else None
    for t, keys in (("orders", ("o_orderkey", "o_custkey")), ("lineitem", ("l_orderkey",))):
        rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        again = rows.withColumns({k: F.col(k) + 10_000_000 for k in keys})
        rows.unionByName(again).coalesce(1).write.parquet(str(folder / f"{t}.parquet"))
    return str(folder)


def test_equal_orders_are_transactions_of_their_own(spark, twice):
    same(catalog.queries()["block_file_ledger"](spark, twice), catalog.oracle_sql()["block_file_ledger"], twice)


def test_built_in_functions_write_what_the_serialiser_does(spark):
    key, prev = 77, bytes(range(32))
    for n in (1, 252, 253):
        made = [(2**40 + i, b"\x00\x14" + b"s" * 20) for i in range(n)]
        outs = rawblocks.compact(n) + b"".join(struct.pack("<Q", v) + rawblocks.compact(len(s)) + s for v, s in made)
        rows = spark.createDataFrame([(key, None, bytearray(outs)), (key, bytearray(prev), bytearray(outs))], "o_orderkey bigint, prev binary, outs binary")
        coinbase, spent = (rawblocks.transaction(rawblocks.Cursor(bytes(r["raw"]))) for r in blockfile_ledger.serialised(rows).orderBy(F.col("prev").isNotNull()).collect())
        assert coinbase.inputs == [(rawblocks.ZERO_TXID, 2**32 - 1, [])] and coinbase.outputs == spent.outputs == made
        assert spent.txid == rawblocks.transaction(rawblocks.Cursor(rawblocks.serialised([(prev[::-1].hex(), 1, [])], made))).txid
        digits = spark.range(1).select(blockfile_ledger._compact(F.lit(n))).first()[0]
        assert bytes.fromhex(digits) == rawblocks.compact(n)


def test_files_grow_in_number_with_their_bytes(spark, sf_dir, tmp_path, monkeypatch):
    txs = blockfile_ledger.transactions(spark, sf_dir)
    folders = [str(tmp_path / x) for x in "ab"]
    blocks = blockfile_ledger.write_files(spark, txs, folders[0])
    few = Options({"path": folders[0]}).files()
    monkeypatch.setattr(blockfile_ledger, "FILE", 20_000)
    assert blockfile_ledger.write_files(spark, txs, folders[1]) == blocks
    many = Options({"path": folders[1]}).files()
    assert sum(n for _, n in many) == sum(n for _, n in few) and len(many) > 2 * len(few)
    ledgers = [sorted(map(tuple, blockfile_ledger.from_files(spark, f, 1 << 16).collect())) for f in folders]
    assert ledgers[0] == ledgers[1]


@pytest.mark.parametrize("cut", range(1, 60))
def test_a_transaction_cut_off_anywhere_raises(cut):
    raw = rawblocks.serialised([("ab" * 32, 7, [b"x" * 300])], [(5, b"s" * 300)])
    with pytest.raises(ValueError, match="cut off"):
        rawblocks.transaction(rawblocks.Cursor(raw[: len(raw) * cut // 60]))


def test_decoded_ledger_gathers_no_blocks_and_hashes_sums(spark, twice, monkeypatch):
    """What is staged has a row for each transaction, not one for each day, and scripts are hashed behind the sums."""
    written = {}
    for module in (catalog, blockfile_ledger):
        kept = module.staged
        monkeypatch.setattr(module, "staged", lambda df, name, kept=kept: written.setdefault(name, kept(df, name)))
    same(catalog.queries()["decoded_ledger"](spark, twice), catalog.oracle_sql()["decoded_ledger"], twice)
    lines = spark.read.parquet(f"{twice}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey"))
    txs = spark.read.parquet(f"{twice}/orders.parquet").join(lines, "o_orderkey", "left_semi")
    assert sorted(written) == ["deltas", "transactions"] and written["transactions"].count() == txs.count()
    assert written["deltas"].count() == written["deltas"].select("account", "height").distinct().count()
