import random

import pytest

from heightline.operators import energy
from heightline.operators.validation import RequestError
from heightline.schema import U64_MAX


def model(rows):
    out, last = [], None
    for h, b, d in rows:
        if last is None:
            last = (h, b, h, 0)
        else:
            h0, b0, a, e = last
            grow = lambda n: 0 if b0 < 100_000 else min(U64_MAX, b0 * 10_000 * n)
            e = min(U64_MAX, e + max(0, grow(h - a) - grow(h0 - a)))
            if d < 0:
                e, a = max(0, e - min(U64_MAX, -d * 43_200_000)), h
            last = (h, b, a, e)
        out.append((h, b, d, last[2], last[3]))
    return out


def test_fixture_timeline(spark):
    rows = [(1, 100, 200_000, 0), (1, 103, 210_000, 10_000), (1, 106, 190_000, -20_000), (1, 108, 220_000, 30_000)]
    df = spark.createDataFrame(rows, "key bigint, height bigint, balance bigint, delta bigint")
    assert {r.height: int(r.energy) for r in energy.records(df).collect()} == {100: 0, 103: 6_000_000_000, 106: 0, 108: 3_800_000_000}
    assert int(energy.projected(energy.records(df), 110).first().projected) == 8_200_000_000


def test_records_equal_the_model_also_where_they_saturate(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for key in range(40):
        scale = 10 ** rng.choice((5, 6, 9, 12))
        heights = sorted(rng.sample(range(60_000), 12))
        one, balance = [], rng.randint(0, scale)
        for i, h in enumerate(heights):
            new = rng.randint(0, scale)
            one.append((h, new, 0 if i == 0 else new - balance))
            balance = new
        rows += [(key, *r) for r in one]
        want[key] = model(one)
    df = spark.createDataFrame(rows, "key bigint, height bigint, balance bigint, delta bigint")
    got = {}
    for r in energy.records(df).orderBy("key", "height").collect():
        got.setdefault(r.key, []).append((r.height, r.balance, r.delta, r.active_height, int(r.energy)))
    assert got == want
    assert any(e == U64_MAX for v in want.values() for *_, e in v)


def test_leaderboard_order_and_winner(spark):
    df = spark.createDataFrame([("b", 5, 1), ("a", 5, 1), ("c", 5, 2), ("d", 9, 0)], "key string, energy bigint, record_height bigint")
    assert [r.key for r in energy.leaderboard(df, 3).collect()] == ["d", "c", "a"]
    assert [r.key for r in energy.leaderboard(df, 3, 1, 5).collect()] == ["c", "a"]
    assert energy.winner(df).first().key == "d"


def test_last_write_wins(spark):
    df = spark.createDataFrame([("a", 1, 0, 5), ("a", 1, 1, 7)], "key string, height bigint, sequence int, energy bigint")
    assert energy.last_write(df).first().energy == 7


def test_energy_records_follow_the_passes(spark):
    rows = spark.createDataFrame([(h,) for h in (1, 5, 6, 7, None)], "block_height bigint")
    kept = lambda *a: sorted(r[0] for r in energy.reconciled(rows, *a)[0].collect())
    assert kept(6, 7) == [1, 5, 6] and kept(6, 6, 6) == [1, 5] and kept(9, 9) == [1, 5, 6, 7] and kept(5, 7, 7) == [1, 5] and kept(5, None) == [1, 5]
    assert energy.reconciled(rows, 6, 9)[1] == 6
    with pytest.raises(RequestError, match="ENERGY_BEHIND_PASSES"):
        energy.reconciled(rows, 5, 4)
