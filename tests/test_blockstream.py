import struct

import pytest
from pyspark.sql import functions as F

from heightline.functions import binary
from heightline.operators import asserts, chain, ledger
from heightline.sources import blockfiles, rawblocks
from heightline.sources.blockstream import BlockFiles, Options

KEY = bytes.fromhex("0102030405a6f708")
SCRIPT = {n: b"\x00\x14" + bytes([i]) * 20 for i, n in enumerate("ABCDEFMN", 1)}
NOTHING = b"\x6a\x01\xff"


def tx(spent, made):
    raw = rawblocks.serialised(spent, made)
    return raw, rawblocks.transaction(rawblocks.Cursor(raw)).txid


def coinbase(height, *made):
    return tx([(rawblocks.ZERO_TXID, 0xFFFFFFFF, [struct.pack("<I", height)])], list(made))


def block(prev, time, *txs):
    raw = struct.pack("<I", 1) + bytes.fromhex(prev)[::-1] + bytes(32) + struct.pack("<III", time, 0, 0) + rawblocks.compact(len(txs)) + b"".join(t[0] for t in txs)
    return raw, rawblocks._twice(raw[:80])


@pytest.fixture(scope="module")
def world():
    """The chain fixture with its reorganisation: blocks by name, each with its hash."""
    made = lambda *parts: [(v, SCRIPT.get(n, NOTHING)) for n, v in parts]
    b0 = block("0" * 64, 100, coinbase(0, (0, NOTHING)))
    c1 = coinbase(1, *made(("A", 100), ("-", 0)))
    b1 = block(b0[1], 101, c1)
    t1 = tx([(c1[1], 0, [b"sig", b"key"])], made(("B", 40), ("C", 60)))
    t2 = tx([(t1[1], 0, [])], made(("D", 25), ("A", 15), ("-", 0)))
    b2 = block(b1[1], 102, coinbase(2, *made(("M", 50))), t1, t2)
    t3 = tx([(t1[1], 1, []), (t2[1], 0, [])], made(("E", 80), ("A", 5), ("-", 0)))
    b3 = block(b2[1], 103, coinbase(3, *made(("N", 50))), t3)
    other = tx([(t1[1], 1, [])], made(("F", 55), ("A", 5)))
    return {"b0": b0, "b1": b1, "b2": b2, "b3": b3, "other": block(b2[1], 104, coinbase(3, *made(("N", 50))), other)}


def stored(path, name, blocks, tail=b""):
    """Adds records to a file; returns nothing else than what lies there now."""
    file = path / name
    old = file.read_bytes() if file.exists() else b""
    options = Options({"key": KEY.hex()})
    new = b"".join(struct.pack("<II", blockfiles.MAGIC, len(b[0])) + b[0] for b in blocks) + tail
    file.write_bytes(old + options.plain(new, len(old)))


def accounts(spark, records, canonical=None):
    """(account name, height) -> (delta, balance), from block records alone."""
    heights = chain.linearize(records.select("block_hash", "prev_hash"), canonical)
    parts = rawblocks.decode(records.select("block_hash", "payload")).join(heights, "block_hash")
    outs = rawblocks.outputs(parts).select("txid", "vout", "height", F.col("value").cast("bigint").alias("value"), binary.script_hash(F.col("script_pubkey")).alias("account"))
    made = outs.select(F.col("txid").alias("prev_txid"), F.col("vout").alias("prev_vout"), "account", "value")
    spends = ledger.resolved_inputs(rawblocks.inputs(parts).select("height", "prev_txid", "prev_vout"), made, ["prev_txid", "prev_vout"])
    rows = ledger.running_balance(ledger.deltas(ledger.signed_rows(outs, spends)))
    names = spark.createDataFrame([(n, bytearray(s)) for n, s in SCRIPT.items()], "name string, s binary").select("name", binary.script_hash(F.col("s")).alias("account"))
    return {(r["name"], r["height"]): (r["delta"], r["balance"]) for r in rows.join(names, "account").collect()}


BEFORE = {("A", 1): (100, 100), ("A", 2): (-85, 15), ("B", 2): (0, 0), ("C", 2): (60, 60), ("D", 2): (25, 25), ("M", 2): (50, 50)}


@pytest.mark.parametrize("each", [250, 1 << 20])
def test_files_to_ledger(spark, tmp_path, world, each):
    stored(tmp_path, "blk00000.dat", [world[n] for n in ("b0", "b1", "b2")], bytes(64))
    stored(tmp_path, "blk00001.dat", [world["b3"]])
    spark.dataSource.register(BlockFiles)
    load = lambda: spark.read.format("block_files").option("path", str(tmp_path)).option("key", KEY.hex()).option("range", each).load()
    records = load()
    assert [r["block_hash"] for r in records.orderBy("file", "file_offset").collect()] == [world[n][1] for n in ("b0", "b1", "b2", "b3")]
    assert records.rdd.getNumPartitions() == (2 if each > 1000 else sum(-(-f.stat().st_size // each) for f in tmp_path.glob("blk*")))
    got = accounts(spark, records)
    assert got == BEFORE | {("A", 3): (5, 20), ("C", 3): (-60, 0), ("D", 3): (-25, 0), ("E", 3): (80, 80), ("N", 3): (50, 50)}
    stored(tmp_path, "blk00001.dat", [world["other"]])
    canonical = spark.createDataFrame([(3, world["other"][1])], "height bigint, block_hash string")
    got = accounts(spark, load(), canonical)  # files are listed as a read is planned
    assert got == BEFORE | {("A", 3): (5, 20), ("C", 3): (-60, 0), ("F", 3): (55, 55), ("N", 3): (50, 50)}


def test_a_stream_gets_exactly_the_new_blocks(spark, tmp_path, world):
    spark.dataSource.register(BlockFiles)
    files, tip, batches = tmp_path / "f", tmp_path / "tip", []
    files.mkdir()

    def run():
        """Blocks of each batch that the stream starts up to its present end."""
        batches.clear()
        rows = spark.readStream.format("block_files").option("path", str(files)).option("key", KEY.hex()).option("tip", str(tip)).option("range", 200).load()
        rows.writeStream.foreachBatch(lambda df, i: batches.append(sorted(r["block_hash"] for r in df.select("block_hash").collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return [b for b in batches if b] if any(batches) else batches[:]

    hashes = lambda *names: sorted(world[n][1] for n in names)
    stored(files, "blk00000.dat", [world["b0"], world["b1"]])
    tip.write_text(world["b1"][1])
    assert run() == [hashes("b0", "b1")]
    whole = struct.pack("<II", blockfiles.MAGIC, len(world["b2"][0])) + world["b2"][0]
    old = (files / "blk00000.dat").read_bytes()
    plain = Options({"key": KEY.hex()}).plain
    (files / "blk00000.dat").write_bytes(old + plain(whole[:50], len(old)))  # half written: it waits
    assert not any(run())
    (files / "blk00000.dat").write_bytes(old + plain(whole, len(old)))
    stored(files, "blk00001.dat", [world["b3"]])
    assert run() == [hashes("b2", "b3")]
    stored(files, "blk00001.dat", [world["other"]])
    tip.write_text(world["other"][1])
    assert run() == [hashes("other")]
    tip.write_text(world["b3"][1])  # another tip alone starts a batch, which is empty
    assert run() == [[]]
    assert run() == []


def test_damaged_files_raise(spark, tmp_path, world):
    spark.dataSource.register(BlockFiles)
    stored(tmp_path, "blk00000.dat", [world["b0"]], b"garbage.garbage.")
    stored(tmp_path, "blk00001.dat", [world["b1"]])
    with pytest.raises(Exception, match="bad magic"):
        spark.read.format("block_files").option("path", str(tmp_path)).option("key", KEY.hex()).load().collect()
    rows = spark.createDataFrame([(bytearray(world["b2"][0][:-9]),)], "payload binary")
    with pytest.raises(Exception, match="cut off"):
        rawblocks.decode(rows).collect()


def test_serialised_transactions_read_back():
    for n in (0, 1, 252, 253, 70_000):
        raw = rawblocks.serialised([("ab" * 32, 7, [b"x" * n, b""])], [(2**63, b"s" * n)] * 3)
        found = rawblocks.transaction(rawblocks.Cursor(raw))
        assert found.inputs == [("ab" * 32, 7, [b"x" * n, b""])] and found.outputs == [(2**63, b"s" * n)] * 3
        assert found.txid == rawblocks.transaction(rawblocks.Cursor(rawblocks.serialised([("ab" * 32, 7, [])], [(2**63, b"s" * n)] * 3))).txid


def test_index_verdicts(spark):
    ddl = "height bigint, block_hash string, prev_hash string"
    whole = [(0, "a", "z"), (1, "b", "a"), (2, "c", "b")]

    def verdict(rows, height, block_hash):
        tip = spark.createDataFrame([(height, block_hash)], "height bigint, block_hash string")
        r = blockfiles.index_verdict(spark.createDataFrame(rows, ddl), tip).first()
        return r["outcome"], r["reason"]

    assert verdict(whole, 2, "c") == ("reuse", None) and verdict(whole, 5, "f") == ("extend", None)
    assert verdict([], 2, "c") == ("rebuild", "empty") and verdict(whole, 2, "x") == ("rebuild", "other_tip") and verdict(whole, 1, "b") == ("rebuild", "beyond_tip")
    assert verdict([whole[0], whole[2]], 2, "c") == ("rebuild", "gap") and verdict(whole[1:], 2, "c") == ("rebuild", "gap")
    assert verdict([*whole, (1, "q", "a")], 2, "c") == ("rebuild", "fork") and verdict([*whole[:2], (2, "c", "q")], 2, "c") == ("rebuild", "broken_link")


def test_index_places_and_gaps(spark):
    blocks = spark.createDataFrame([("h", "blk00000.dat", 8, 0)], "block_hash string, file string, file_offset bigint, record_index bigint")
    index = spark.createDataFrame([(4, "h"), (6, "i")], "height bigint, block_hash string")
    assert [tuple(r) for r in blockfiles.linearized_index(blocks, index).select("height", "file", "file_offset").collect()] == [(4, "blk00000.dat", 8)]
    assert sorted(r["height"] for r in blockfiles.index_gaps(index).collect()) == [4, 6]


def test_faults_raise_and_sound_data_pass(spark):
    events = spark.createDataFrame([(1, "t1"), (2, "t2")], "height bigint, txid string")
    places = spark.createDataFrame([(1, "t1", 4, 0), (2, "t2", 0, 1)], "height bigint, txid string, tx_position int, input_index int")
    keys = ["height", "txid"]
    assert sorted(r["tx_position"] for r in asserts.event_positions(events, places, keys).collect()) == [0, 4]
    with pytest.raises(Exception, match="EVENT_WITHOUT_POSITION height=2 txid=t2"):
        asserts.event_positions(events, places.where("height = 1"), keys).collect()
    spent = spark.createDataFrame([("t", 0), ("t", 1)], "txid string, vout int")
    one, two = (spark.createDataFrame([("t", v, f"a{v}", 5)], "txid string, vout int, account string, value bigint") for v in (0, 1))
    assert sorted((r["account"], r["source"]) for r in asserts.resolved_inputs(spent, one, two, ["txid", "vout"]).collect()) == [("a0", "first"), ("a1", "second")]
    with pytest.raises(Exception, match="OUTPUT_NOT_FOUND txid=t vout=1"):
        asserts.resolved_inputs(spent, one, one, ["txid", "vout"]).collect()
    board = spark.createDataFrame([("k", 5), ("l", 3)], "key string, energy bigint")
    active = spark.createDataFrame([("o", 10), ("p", 7)], "owner string, balance bigint")
    told = spark.createDataFrame([(17, 2)], "total_balance bigint, active_address_count bigint")
    assert asserts.cross_checked(board, board, active, told).count() == 2
    with pytest.raises(Exception, match="LEADERBOARD_ENERGY key=l"):
        asserts.cross_checked(board, board.where("key = 'k'"), active, told).collect()
    with pytest.raises(Exception, match="SNAPSHOT_DIFFERS"):
        asserts.cross_checked(board, board, active.limit(1), told).collect()
