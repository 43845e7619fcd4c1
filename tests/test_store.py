import random

import pytest
from pyspark.sql import functions as F

from heightline.operators import events, ledger
from heightline.operators.validation import RequestError
from heightline.sources import snapshot
from heightline.streaming.store import BUCKETS, Store

LOG = "id bigint, inscription_id string, block_height bigint, event_type string, new_state string, new_owner string, new_satpoint string"


def block(spark, rng, first, last, start):
    """Rows of some tables for heights in [first, last)."""
    log = [(start + i, f"p{rng.randrange(40)}", rng.randrange(first, last), "state_update", rng.choice(["active", "dormant"]), f"o{i}", f"s{i}") for i in range(60)]
    return {
        "ledger": spark.createDataFrame([(f"a{h % 7}", h, h) for h in range(first, last)], "account string, height bigint, delta bigint"),
        "outputs": spark.createDataFrame([(f"t{h}", 0, "a", h, 5) for h in range(first, last)], "txid string, vout bigint, account string, height bigint, value bigint"),
        "commits": spark.createDataFrame([(h, "x", "y", f"c{h}") for h in range(first, last)], "block_height bigint, btc_block_hash string, balance_delta_root string, block_commit string"),
        "log": spark.createDataFrame(log, LOG),
        "energy": spark.createDataFrame([(f"p{h % 5}", h, "active", h * 10) for h in range(first, last)], "inscription_id string, block_height bigint, state string, energy bigint"),
        "registry": spark.createDataFrame([(f"h{first}", bytearray(b"s"))], "script_hash string, script_pubkey binary"),
    }


def seen(store, version=None):
    """Every table's rows as readers see them."""
    return {t: sorted((tuple(map(str, r)) for r in store.read(t, version).collect())) for t in ("ledger", "outputs", "commits", "log", "passes", "energy", "registry")} | {"tip": store.manifest(version)["tip"]}


def test_a_failure_between_any_two_writes_leaves_the_old_version_whole(spark, tmp_path):
    rng = random.Random(1)
    steps = []
    store = Store(spark, str(tmp_path / "s"), before=steps.append)
    store.commit(99, block(spark, rng, 0, 100, 0))
    old, rows = seen(store), block(spark, rng, 100, 120, 1000)
    steps.clear()
    again = Store(spark, str(tmp_path / "copy"), before=steps.append)
    again.commit(5, rows)
    count = len(steps)
    assert count == 8 and steps[-1] == "publish"
    for at in range(count):
        left = [at]

        def fail(step, left=left):
            if not left[0]:
                raise RuntimeError(step)
            left[0] -= 1

        broken = Store(spark, str(tmp_path / "s"), before=fail)
        with pytest.raises(RuntimeError):
            broken.commit(119, rows)
        assert broken.manifest()["tip"] == 99
    assert seen(store) == old
    store.commit(119, rows, {"energy_synced": 119})
    assert store.manifest()["tip"] == 119 and seen(store, 0) == old
    assert store.read("ledger").count() == 120
    assert store.vacuum(keep=1) > 0 and store.read("ledger").count() == 120


def test_of_two_writers_one_is_refused(spark, tmp_path):
    rows = {"ledger": spark.createDataFrame([("a", 1, 1)], "account string, height bigint, delta bigint")}
    one = Store(spark, str(tmp_path / "s"))
    one.commit(1, rows)
    two = Store(spark, str(tmp_path / "s"), before=lambda step: one.commit(2, rows) if step == "publish" else None)
    with pytest.raises(RequestError, match="VERSION_TAKEN"):
        two.commit(3, rows)
    assert one.manifest()["tip"] == 2 and one.read("ledger").count() == 2
    with pytest.raises(RequestError, match="STALE_VERSION"):
        one.commit(4, rows, expected=0)


def test_rollback_restores_current_rows_and_touches_what_it_must(spark, tmp_path):
    rng = random.Random(3)
    store = Store(spark, str(tmp_path / "s"), retention=200)
    for i, (a, b) in enumerate(((0, 100), (100, 140), (140, 160))):
        store.commit(b - 1, block(spark, rng, a, b, i * 1000), {"energy_synced": b - 1})
    late = spark.createDataFrame([(9000, "p1", 159, "state_update", "burned", "o", "s"), (9001, "fresh", 159, "mint", "active", "o", "s")], LOG)
    store.commit(159, {"log": late})
    before = store.manifest()
    steps = []
    store.before = steps.append
    with pytest.raises(RequestError):
        Store(spark, str(tmp_path / "s"), retention=5).rollback(120)
    after = store.rollback(158)
    log = store.read("log")
    assert log.agg(F.max("block_height")).first()[0] <= 158
    scratch = events.snapshot(log, 158).select("inscription_id", "block_height", "id", F.col("new_state").alias("state"), F.col("new_owner").alias("owner"), F.col("new_satpoint").alias("satpoint"))
    assert sorted(map(tuple, store.read("passes").collect())) == sorted(map(tuple, scratch.collect()))
    kept = {p["dir"] for p in before["tables"]["passes"]} & {p["dir"] for p in after["tables"]["passes"]}
    changed = set(r[0] for r in late.select(F.pmod(F.xxhash64("inscription_id"), F.lit(BUCKETS))).distinct().collect())
    assert len(kept) >= len(before["tables"]["passes"]) - len(changed) - 20 and kept
    assert after["tables"]["ledger"][:2] == before["tables"]["ledger"][:2]  # parts below the height are the same files
    assert after["marks"]["energy_synced"] == 158 and after["tip"] == 158 and store.read("energy").count() == 159
    assert store.read("registry").count() == 3
    replayed = store.commit(159, {"ledger": spark.createDataFrame([("z", 159, 1)], "account string, height bigint, delta bigint")})
    assert replayed["tip"] == 159 and store.read("ledger").count() == 160


def test_keyed_rows_replace_those_of_their_key(spark, tmp_path):
    kind = "block_height bigint, total_balance bigint, active_address_count bigint"
    store = Store(spark, str(tmp_path / "s"))
    store.commit(9000, {"snapshots": spark.createDataFrame([(1, 5, 1), (5000, 6, 1), (9000, 7, 1)], kind)})
    first = store.manifest()["tables"]["snapshots"]
    store.commit(None, {"snapshots": spark.createDataFrame([(5000, 60, 2), (5001, 8, 2)], kind)})
    assert sorted((r[0], int(r[1])) for r in store.read("snapshots").collect()) == [(1, 5), (5000, 60), (5001, 8), (9000, 7)]
    assert len({p["dir"] for p in first} & {p["dir"] for p in store.manifest()["tables"]["snapshots"]}) == 2


def test_energy_follows_the_passes(spark, tmp_path):
    kind = "inscription_id string, block_height bigint, energy bigint"
    store = Store(spark, str(tmp_path / "s"))
    store.commit(10, {"energy": spark.createDataFrame([("p", h, h) for h in range(8, 13)], kind)}, {"energy_synced": 12, "energy_pending": 9})
    made = store.reconcile()
    assert [r[0] for r in store.read("energy").select("block_height").collect()] == [8] and made["marks"] == {"energy_synced": 10, "energy_pending": None}
    store.commit(20, {})
    with pytest.raises(RequestError, match="ENERGY_BEHIND_PASSES"):
        store.reconcile()


def test_a_snapshot_is_installed_by_one_version(spark, tmp_path):
    data = spark.createDataFrame([("1", 5, 3, 3), ("2", 6, 1, 1)], "account string, height bigint, delta bigint, balance bigint")
    commits = spark.createDataFrame([(5, "a")], "height bigint, block_commit string")
    registry = spark.createDataFrame([("x", bytearray(b"s"))], "script_hash string, script_pubkey binary")
    snapshot.export(spark, str(tmp_path / "e"), data, commits, registry, 7, shards=2)
    store = Store(spark, str(tmp_path / "s"))
    store.commit(3, {"ledger": data})
    store.before = lambda step: (_ for _ in ()).throw(RuntimeError(step)) if step == "publish" else None
    with pytest.raises(RuntimeError):
        store.install(str(tmp_path / "e"), {"ledger": "balance_history", "registry": "script_registry"})
    assert store.manifest()["tip"] == 3
    store.before = lambda step: None
    store.install(str(tmp_path / "e"), {"ledger": "balance_history", "registry": "script_registry"})
    assert store.manifest()["tip"] == 7 and ledger.deltas(store.read("ledger")).count() == 2 and store.read("registry").count() == 1
    spark.createDataFrame([("3", 7, 1, 1)], data.schema).write.mode("append").parquet(str(tmp_path / "e" / "balance_history"))
    with pytest.raises(RequestError, match="DIGEST"):
        store.install(str(tmp_path / "e"), {"ledger": "balance_history"})
