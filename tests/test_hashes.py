import hashlib
import json
import struct

from pyspark.sql import functions as F

from heightline.functions import binary as B
from heightline.functions import mint
from heightline.operators import commit, derived
from heightline.plans import catalog
from heightline.sources import blockfiles


def sha(*parts):
    return hashlib.sha256(b"".join(parts)).hexdigest()


def test_script_hash_and_kinds(spark):
    scripts = [bytes.fromhex(x) for x in ("5120" + "ab" * 32, "0014" + "ff" * 20, "0020" + "00" * 32, "a914" + "11" * 20 + "87", "76a914" + "22" * 20 + "88ac", "6a0102", "51")]
    df = spark.createDataFrame([(bytearray(s),) for s in scripts], "s binary")
    got = df.select(B.script_hash(F.col("s")).alias("h"), B.script_kind(F.col("s")).alias("k")).collect()
    assert [r.h for r in got] == [hashlib.sha256(s).digest()[::-1].hex() for s in scripts]
    assert [r.k for r in got] == ["p2tr", "p2wpkh", "p2wsh", "p2sh", "p2pkh", "op_return", "non_standard"]


def test_commit_chain_equals_hashlib(spark):
    blocks = spark.createDataFrame([(5, "ab" * 32), (6, "0102" * 16)], "height bigint, block_hash string")
    rows = spark.createDataFrame([("ff" * 32, 5, -7, 3), ("0a" * 32, 5, 9, 2**63 - 1)], "script_hash string, height bigint, delta bigint, balance bigint")
    last, want = bytes(32), []
    for h, name in ((5, "ab" * 32), (6, "0102" * 16)):
        body = b"".join(bytes.fromhex(s) + struct.pack(">IqQ", hh, d, b) for s, hh, d, b in sorted((tuple(r) for r in rows.collect())) if hh == h)
        shown = bytes.fromhex(name)[::-1]
        root = hashlib.sha256(b"balance-history:block-delta-root:v1" + struct.pack(">I", h) + shown + body).digest()
        last = hashlib.sha256(b"balance-history:block-commit:v1" + struct.pack(">I", h) + shown + root + last).digest()
        want.append((h, name, root.hex(), last.hex()))
    assert sorted(map(tuple, commit.block_commits(commit.delta_roots(blocks, rows)).collect())) == want


def test_commits_stream_and_go_on_over_spans(spark, monkeypatch):
    monkeypatch.setattr(commit, "HEIGHTS", 3, raising=False)
    heights = [0, 1, 2, 4, 9, 10, 11]
    ledger = [(f"{i * 7919 % 65536:064x}", 4, i - 9000, i) for i in range(20_000)] + [("0b" * 32, h, -h, h) for h in heights[1:]] + [("0c" * 32, 77, 1, 1)]
    blocks = spark.createDataFrame([(h, f"{h:064x}") for h in heights], "height bigint, block_hash string")
    roots = commit.delta_roots(blocks, spark.createDataFrame(ledger, "script_hash string, height bigint, delta bigint, balance bigint"))
    assert "collect_list" not in roots._jdf.queryExecution().toString()
    last, want = b"\x07" * 32, []
    for h in heights:
        shown, hashed = bytes.fromhex(f"{h:064x}")[::-1], hashlib.sha256(b"balance-history:block-delta-root:v1")
        hashed.update(struct.pack(">I", h) + shown)
        for s, at, d, b in sorted(r for r in ledger if r[1] == h):
            hashed.update(bytes.fromhex(s) + struct.pack(">IqQ", at, d, b))
        last = hashlib.sha256(b"balance-history:block-commit:v1" + struct.pack(">I", h) + shown + hashed.digest() + last).digest()
        want.append((h, f"{h:064x}", hashed.hexdigest(), last.hex()))
    chained = commit.block_commits(roots, "07" * 32)
    assert "collect_list" not in chained._jdf.queryExecution().toString() and sorted(map(tuple, chained.collect())) == want
    assert commit.block_commits(roots.limit(0)).collect() == []


def test_pass_commits_equal_hashlib(spark):
    texts = [json.dumps({"type": "mint", "inscription_id": "x"}, separators=(",", ":")), "{}"]
    m = spark.createDataFrame([(3, 1, texts[1]), (3, 0, texts[0])], "height bigint, position int, json string")
    roots = commit.mutation_roots(m)
    want = sha(b"1.0.0|", struct.pack(">I", 3), b"|", struct.pack(">I", 2), *(b"|" + struct.pack(">I", len(t)) + t.encode() for t in texts))
    assert roots.first().mutation_root == want
    up = spark.createDataFrame([(3, "cd" * 32)], "height bigint, block_commit string")
    got = commit.pass_commits(roots, up).first().block_commit
    assert got == sha(b"1.0.0|", struct.pack(">I", 3), b"|genesis|", struct.pack(">I", 3), b"|", ("cd" * 32).encode(), b"|", want.encode())


def test_system_state_id_equals_hashlib(spark):
    text = lambda s: struct.pack(">I", len(s.encode())) + s.encode()
    got = spark.range(1).select(commit.system_state_id("v1", F.lit("é"), F.lit("b")).alias("x")).first().x
    assert got == sha(text("v1"), text("é"), text("b"))


def test_mint_classification(spark):
    ok = "0x" + "aB" * 20
    cases = [
        ("not json", "not_mint", None), ("[1]", "not_mint", None), ('{"p":"other","op":"mint"}', "not_mint", None), ('{"p":"usdb","op":"send"}', "not_mint", None), ('{"p":1,"op":"mint"}', "not_mint", None),
        (json.dumps({"p": "usdb", "op": "mint", "eth_main": ok, "prev": []}), "valid", None),
        (json.dumps({"p": "usdb", "op": "mint", "eth_main": ok, "eth_collab": None, "prev": ["ab" * 32 + "i0"]}), "valid", None),
        (json.dumps({"p": "usdb", "op": "mint", "eth_main": ok}), "invalid", "INVALID_SCHEMA"),
        (json.dumps({"p": "usdb", "op": "mint", "eth_main": 5, "prev": []}), "invalid", "INVALID_SCHEMA"),
        (json.dumps({"p": "usdb", "op": "mint", "eth_main": ok, "prev": [1]}), "invalid", "INVALID_SCHEMA"),
        (json.dumps({"p": "usdb", "op": "mint", "eth_main": "0X" + "ab" * 20, "prev": []}), "invalid", "INVALID_ETH_MAIN"),
        (json.dumps({"p": "usdb", "op": "mint", "eth_main": ok, "eth_collab": "x", "prev": []}), "invalid", "INVALID_ETH_COLLAB"),
        (json.dumps({"p": "usdb", "op": "mint", "eth_main": ok, "prev": ["zz"]}), "invalid", "INVALID_PREV_ID"),
        (None, "not_mint", None),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, *_) in enumerate(cases)], "i int, c string")
    got = [(r.m.kind, r.m.code) for r in df.select("i", mint.classify(F.col("c")).alias("m")).orderBy("i").collect()]
    assert got == [(k, code) for _, k, code in cases]


def test_block_records_round_trip(spark, tmp_path):
    heads = [struct.pack("<I", 1) + bytes([i]) * 32 + bytes(32) + struct.pack("<III", 7 + i, 0, 0) + b"rest" for i in range(3)]
    key = bytes(range(1, 9))
    for n in range(2):
        data = b"".join(struct.pack("<II", blockfiles.MAGIC, len(h)) + h for h in heads)
        (tmp_path / f"blk{n:05}.dat").write_bytes(bytes(b ^ key[i % 8] for i, b in enumerate(data)))
    got = blockfiles.read_block_files(spark, str(tmp_path), key).collect()
    assert [(r.record_index, r.time, r.prev_hash) for r in got] == [(i, 7 + i, (bytes([i]) * 32).hex()) for i in range(3)]


def test_inscription_fixture(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"blocks": {"12": [{"inscription_id": "a", "inscription_number": 1}, {"inscription_id": "b", "inscription_number": 2, "timestamp": 9}], "13": []}}))
    times = spark.createDataFrame([(12, 77)], "height bigint, time bigint")
    got = blockfiles.read_inscriptions(spark, str(tmp_path / "f.json"), times).orderBy("inscription_index").collect()
    assert [(r.height, r.inscription_id, r.timestamp) for r in got] == [(12, "a", 77), (12, "b", 9)]


def test_derived_values(spark):
    one = spark.range(1)
    assert int(one.select(derived.real_difficulty(F.lit(1001), F.lit(9900)).alias("x")).first().x) == 991
    assert one.select(derived.difficulty_factor(F.lit(60)).alias("x")).first().x == 5000
    assert int(one.select(derived.emission(F.lit(10**10), F.lit(5), F.lit(100), F.lit(10_000), 10).alias("x")).first().x) == 40
    rows = spark.createDataFrame([("k", 0, 1_000_000), ("k", 10, 500_000), ("k", 20, 500_000)], "key string, height bigint, balance bigint")
    r = derived.raw_energy_v2(rows).first()
    assert (int(r.energy), int(r.age)) == (max(0, 100 - 75) + 50, 15)
    kept = derived.effective_energy(spark.createDataFrame([("l", 100, True), ("c", 51, True)], "key string, energy bigint, active boolean"), spark.createDataFrame([("c", "l")], "key string, leader string"))
    assert {x.key: int(x.effective_energy) for x in kept.collect()} == {"l": 125, "c": 0}


def test_raw_energy_of_every_account(spark, sf_dir):
    rows = {}
    for r in catalog.queries()["ledger_running_balance"](spark, sf_dir).collect():
        rows.setdefault(r["account"], []).append((r["height"], r["balance"]))
    want = []
    for key, balances in rows.items():
        (at, balance), *later = sorted(balances)
        held, age, energy = balance // 100_000, 0, 0
        for height, balance in later:
            now, age = balance // 100_000, age + height - at
            energy = max(0, energy + held * (height - at) - max(held - now, 0) * age * 3 // 2)
            if now < held:
                age = age * now // held
            at, held = height, now
        want.append((key, at, held, age, energy))
    found = catalog.queries()["derived_raw_energy"](spark, sf_dir).select("key", "height", "units", "age", "energy").collect()
    assert len(want) > 20 and sorted(map(tuple, found)) == sorted(want)
