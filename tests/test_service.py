import pytest

from heightline.operators.validation import RequestError
from heightline.service import BalanceService, PassService

LEDGER = "account string, height bigint, delta bigint, balance bigint"


@pytest.fixture(scope="module")
def balances(spark):
    rows = [("a", 10, 100, 100), ("a", 12, -40, 60), ("a", 18, 90, 150), ("b", 11, 0, 0)]
    utxo = spark.createDataFrame([("t", 0, "a", 5)], "txid string, vout int, account string, value bigint")
    registry = spark.createDataFrame([("h1", bytearray(b"\x00\x14" + b"x" * 20))], "script_hash string, script_pubkey binary")
    commits = spark.createDataFrame([(18, "c18", "bh18")], "height bigint, block_commit string, stable_block_hash string")
    return BalanceService(spark.createDataFrame(rows, LEDGER), utxo, registry, commits, stable_height=30)


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_balances(balances):
    row = ("height", "delta", "balance")
    assert values(balances.balance("a", 17), *row) == [(12, -40, 60)]
    assert values(balances.balance("a"), *row) == [(18, 90, 150)]
    assert values(balances.balance("zz", 9), *row) == [(0, 0, 0)]
    assert values(balances.balance("a", span=(12, 18)), *row) == [(12, -40, 60)]
    assert values(balances.balance("a", span=(12, 12)), *row) == []
    assert values(balances.balances(["b", "a", "b"], 12), "account", "balance") == [("b", 0), ("a", 60), ("b", 0)]
    assert values(balances.delta("a", 13), *row) == []
    assert values(balances.deltas(["zz", "a"], 12), "account", "delta") == [("zz", None), ("a", -40)]
    for bad in (lambda: balances.balance("a", 31), lambda: balances.delta("a"), lambda: balances.balances(["a"] * 1001), lambda: balances.summary("a", 9, 9), lambda: balances.timeseries("a", 0, 30, 0)):
        with pytest.raises(RequestError):
            bad()


def test_buckets(balances):
    assert values(balances.summary("a", 9, 20), "start_balance", "end_balance", "change_count", "inflow", "outflow", "net_delta", "peak_balance", "low_balance") == [(0, 150, 3, 190, 40, 150, 150, 0)]
    assert balances.timeseries("a", 9, 20, 5).count() == balances.flow_buckets("a", 9, 20, 5).count() == 3


def test_lookups(balances):
    assert balances.live_output("t", 0).count() == 1 and balances.live_output("t", 1).count() == 0
    assert values(balances.resolve(["x", "h1"]), "pos", "kind")[0] == (0, None)
    assert balances.resolve(["h1"]).first()["kind"] is not None
    unknown, known = (r["address"] for r in balances.resolve(["x", "h1"]).collect())
    assert unknown is None and known.startswith("bc1q") and len(known) == 42
    assert balances.state_ref(18, {"stable_block_hash": "bh18"}).count() == 1
    with pytest.raises(RequestError, match="BLOCK_HASH"):
        balances.state_ref(18, {"stable_block_hash": "other"})
    assert balances.readiness()["consensus_ready"] and balances.info()["stable_height"] == 30
    assert balances.verify(balances.rows.where("height <> 12")).count() == 1


@pytest.fixture(scope="module")
def passes(spark):
    log = [(1, "p1", 5, "mint", "active", "o1"), (2, "p2", 6, "mint", "active", "o2"), (3, "p1", 7, "state_update", "dormant", "o1"), (4, "p3", 7, "mint", "active", "o1"), (5, "p4", 8, "invalid_mint", "invalid", "o3"), (6, "p5", 9, "mint", "active", "o2")]
    history = spark.createDataFrame(log, "id bigint, inscription_id string, block_height bigint, event_type string, new_state string, new_owner string")
    own = spark.createDataFrame([("p1", 5, 1), ("p2", 6, 2), ("p3", 7, 3), ("p4", 8, 4), ("p5", 9, 5)], "inscription_id string, mint_block_height bigint, inscription_number int")
    records = spark.createDataFrame([("p1", 5, 200000, 0, 5, 0), ("p2", 6, 300000, 0, 6, 7), ("p3", 7, 500, 0, 7, 9)], "key string, height bigint, balance bigint, delta bigint, active_height bigint, energy bigint").selectExpr("key", "height", "cast(balance as decimal(20,0)) balance", "delta", "active_height", "cast(energy as decimal(20,0)) energy")
    snapshots = spark.createDataFrame([(5, 10, 1), (7, 30, 2)], "block_height bigint, total_balance bigint, active_address_count int")
    commits = spark.createDataFrame([(5, "x"), (7, "y")], "height bigint, block_commit string")
    return PassService(history, own, records, snapshots, commits, genesis=5)


def test_passes(passes):
    ids = lambda df: [r["inscription_id"] for r in df.collect()]
    count = lambda df: df.first()["n"]
    # Events 2 (height 6) and 4 (height 7) made p2 and p3 active: the latest event comes first.
    assert ids(passes.active(8)) == ["p3", "p2"] and ids(passes.active(8, 1, 1)) == ["p2"] and count(passes.active_total(8)) == 2
    assert values(passes.one("p1", 6), "new_state", "mint_block_height") == [("active", 5)] and passes.one("zz").count() == 0
    assert passes.stats().first()["active"] == 3
    # By the latest event: 4 (p3) after 3 (p1).
    assert ids(passes.of_owner("o1")) == ["p3", "p1"] and ids(passes.of_owner("o1", order="asc")) == ["p1", "p3"]
    assert ids(passes.of_owner("o1", states=["Dormant", " "])) == ["p1"] and count(passes.of_owner_total("o1")) == 2
    # By the mint: p1 at 5, p2 at 6, p3 at 7, though p1 has the event after p2's.
    assert ids(passes.recent(7, order="asc")) == ["p1", "p2", "p3"] and ids(passes.recent(7)) == ["p3", "p2", "p1"] and count(passes.recent_total(7)) == 3
    assert [r["owner"] for r in passes.owners().collect()] == ["o1", "o2"]
    assert ids(passes.active_of_owner("o2", 8)) == ["p2"]
    assert values(passes.events_of("p1", 5, 9), "id") == [(1,), (3,)]
    assert ids(passes.invalid(0, 9)) == ["p4"] and count(passes.invalid_total(0, 9)) == 1 and count(passes.events_total("p1", 5, 9)) == 2
    for bad in (lambda: passes.active_of_owner("o2"), lambda: passes.active(99), lambda: passes.active(4), lambda: passes.recent(states=["odd"]), lambda: passes.recent(size=0), lambda: passes.active_balance(6), lambda: passes.energy("p1", mode="odd")):
        with pytest.raises(RequestError):
            bad()


def test_energy(passes):
    assert [r["key"] for r in passes.leaderboard(8).collect()] == ["p2", "p3"]
    assert values(passes.energy_range("p2", 5, 9), "energy") == [(7,)] and passes.energy_range_total("p2", 5, 9).first()["n"] == 1
    assert passes.energy("p2", 6, "exact").count() == 1 and passes.energy("p2", 7, "exact").count() == 0
    assert passes.energy("p2", 8).first()["projected"] > 7
    assert passes.latest_active_balance().first()["total_balance"] == 30 and passes.active_balance(5).count() == 1
    latest = passes.latest_active_balance().first()["block_height"]
    for synced in (latest, latest + 1):
        asked = PassService(passes.history, passes.passes, snapshots=passes.snapshots, synced=synced)
        if synced == latest:
            assert asked.synced_active_balance().count() == 1
        else:
            with pytest.raises(RequestError, match="SNAPSHOT_NOT_SYNCED"):
                asked.synced_active_balance()
    assert passes.commit_at(6).first()["block_commit"] == "x"
