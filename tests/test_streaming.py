import random

import pytest

from heightline.operators import ledger
from heightline.operators.validation import RequestError
from heightline.sources import snapshot
from heightline.streaming.incremental import LedgerStore, stable_target

KIND = "account bigint, height bigint, delta bigint"


def rows(seed=0, first=0, last=200):
    rng = random.Random(seed)
    return [(rng.randint(1, 5), h, rng.randint(0, 20)) for h in range(first, last) for _ in range(2)]


def whole(spark, data):
    return sorted(map(tuple, ledger.running_balance(ledger.deltas(spark.createDataFrame(data, KIND))).collect()))


@pytest.mark.parametrize("size", [50, 200])
def test_batches_of_any_size_give_the_same_ledger(spark, tmp_path, size):
    store, data = LedgerStore(spark, str(tmp_path / "s")), rows()
    for a in range(0, 200, size):
        store.append(spark.createDataFrame([r for r in data if a <= r[1] < a + size], KIND), a + size - 1)
    assert sorted(map(tuple, store.ledger().collect())) == whole(spark, data)


def test_rollback_and_replay(spark, tmp_path):
    store, data, other = LedgerStore(spark, str(tmp_path / "s"), retention=64), rows(), rows(9, 150, 200)
    store.append(spark.createDataFrame([r for r in data if r[1] < 100], KIND), 99)
    store.append(spark.createDataFrame([r for r in data if r[1] >= 100], KIND), 199)
    with pytest.raises(RequestError):
        store.rollback(50)
    assert store.tip() == 199
    store.rollback(149)
    assert sorted(map(tuple, store.ledger().collect())) == whole(spark, [r for r in data if r[1] < 150])
    store.append(spark.createDataFrame(other, KIND), 199)
    assert sorted(map(tuple, store.ledger().collect())) == whole(spark, [r for r in data if r[1] < 150] + other)


def test_stream_catches_up_and_skips_what_is_published(spark, tmp_path):
    data = rows()
    for i, a in enumerate((0, 100)):
        spark.createDataFrame([r for r in data if a <= r[1] < a + 100], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        store = LedgerStore(spark, str(tmp_path / "s"))
        store.catch_up(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), 10_000, str(tmp_path / "cp"))
    assert sorted(map(tuple, store.ledger().collect())) == whole(spark, data)
    assert stable_target(100, 6, 50) == 50


def test_rows_beyond_the_stable_height_wait(spark, tmp_path):
    data = [(1, 5, 7), (1, 50, 2), (2, 8, 1), (2, 120, 4)]
    spark.createDataFrame(data, KIND).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = LedgerStore(spark, str(tmp_path / "s"), retention=200)
    read = lambda: spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
    for stable in (10, 100):
        store.catch_up(read(), stable, str(tmp_path / "cp"))
        assert sorted(map(tuple, store.ledger().collect())) == whole(spark, [r for r in data if r[1] <= stable])
        assert store.tip() == stable
    store.rollback(60)
    store.catch_up(read(), 200, str(tmp_path / "cp"))
    assert sorted(map(tuple, store.ledger().collect())) == whole(spark, [r for r in data if r[1] <= 60])
    spark.createDataFrame([(2, 120, 9)], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store.catch_up(read(), 200, str(tmp_path / "cp"))
    assert sorted(map(tuple, store.ledger().collect())) == whole(spark, [r for r in data if r[1] <= 60] + [(2, 120, 9)])


def test_snapshot_export_verify_install(spark, tmp_path):
    data = spark.createDataFrame([(1, 5, 3, 3), (2, 6, 1, 1), (2, 7, -1, 0)], KIND + ", balance bigint")
    commits = spark.createDataFrame([(5, "a"), (9, "b")], "height bigint, block_commit string")
    registry = spark.createDataFrame([("x", bytearray(b"s"))], "script_hash string, script_pubkey binary")
    m = snapshot.export(spark, str(tmp_path / "e"), data, commits, registry, 7, shards=4)
    assert m["counts"] == {"balance_history": 1, "block_commits": 1, "script_registry": 1}
    assert snapshot.install(spark, str(tmp_path / "e"), str(tmp_path / "live"))["height"] == 7
    with pytest.raises(RequestError):
        snapshot.export(spark, str(tmp_path / "f"), data, commits, registry, 7, utxo=data, tip=9)
    spark.createDataFrame([(1, 5, 4, 4)], data.schema).write.mode("append").parquet(str(tmp_path / "live" / "balance_history"))
    with pytest.raises(RequestError):
        snapshot.verify(spark, str(tmp_path / "live"))
