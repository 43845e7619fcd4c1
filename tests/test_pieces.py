import random

from pyspark.sql import functions as F

from heightline.plans import catalog
from tests.oracle import same
from heightline.operators import clamp, derived, pieces, temporal
from heightline.schema import U64_MAX


def test_nearest_looks_both_ways_over_pieces(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), rng.randrange(6000), i, rng.choice([None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, height bigint, i int, v int").repartition(3)
    for back in (True, False):
        got = {r["i"]: r["_v"] for r in pieces.nearest(df, ["k"], ["height", "i"], {"_v": F.col("v")}, piece=64, back=back).collect()}
        last = {}
        for k, h, i, v in sorted(rows, key=lambda r: (r[1], r[2]), reverse=not back):
            assert got[i] == last.get(k)
            if v is not None:
                last[k] = v


def test_as_of_of_an_account_with_most_rows(spark):
    """Several rows for one height, points before the first row, pieces without a ledger row."""
    rng = random.Random(6)
    ledger = {(1 if rng.random() < 0.6 else rng.randrange(2, 9), rng.randrange(40_000)) for _ in range(900)}
    rows = [(a, h, h % 7, h % 11) for a, h in ledger]
    points = [(rng.choice([1, 1, 1, 2, 3, 77]), rng.choice([5, 30_000, rng.randrange(60_000)]), i) for i in range(900)] + [(None, 4, 900), (1, None, 901)]
    found = temporal.as_of_many(spark.createDataFrame(rows, "account bigint, height bigint, delta bigint, balance bigint"), spark.createDataFrame(points, "account bigint, at bigint, i int"))
    got = {r["i"]: (r["height"], r["delta"], r["balance"]) for r in found.collect()}
    assert len(got) == found.count() == len(points)
    for a, at, i in points:
        below = [h for b, h in ledger if a is not None and at is not None and b == a and h <= at]
        assert got[i] == ((max(below), max(below) % 7, max(below) % 11) if below else (0, 0, 0))


def test_prices_of_very_many_changes(spark):
    policy = spark.range(20_000).select((F.col("id") * 3 + 10).alias("start"), (F.col("id") % 1000 + 1).alias("price"))
    heights = [(0,), (9,), (10,), (12,), (13,), (30_001,), (10**6,), (13,)]
    found = [tuple(r) for r in derived.price_at(spark.createDataFrame(heights, "height bigint"), policy).collect()]
    want = [(h, None if h < 10 else min((h - 10) // 3, 19_999) % 1000 + 1) for (h,) in heights]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_paging_candidates_equals_one_sort(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([0, 5, 5, 5, 10**30, rng.randrange(100)])) for k in range(120)]
    df = spark.createDataFrame([(k, str(e)) for k, e in rows], "key bigint, effective_energy string").withColumn("effective_energy", F.col("effective_energy").cast("decimal(38,0)"))
    seen, after = [], None
    while page := derived.candidate_page(df, 17, after).collect():
        page.sort(key=lambda r: (-r[1], r[0]))
        seen += [r[0] for r in page]
        after = (page[-1][1], page[-1][0])
    assert seen == [k for k, e in sorted(rows, key=lambda r: (-r[1], r[0])) if e > 0]


def test_raw_energy_over_spans_equals_one_fold(spark):
    rng = random.Random(5)
    rows = [(k, h, rng.randrange(10**7)) for k in range(12) for h in rng.sample(range(900), rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "key bigint, height bigint, balance bigint")
    want = {}
    for k in range(12):
        h0 = units = age = energy = None
        for _, h, b in sorted(r for r in rows if r[0] == k):
            n = b // 100_000
            if h0 is None:
                age = energy = 0
            else:
                age += h - h0
                energy = max(0, energy + units * (h - h0) - max(units - n, 0) * age * 3 // 2)
                age = age * n // units if n < units else age
            h0, units = h, n
        want[k] = (h0, units, age, energy)
    for span in (50, 65_536):
        assert {r["key"]: (r["height"], int(r["units"]), int(r["age"]), int(r["energy"])) for r in derived.raw_energy_v2(df, span).collect()} == want


def test_clamped_steps_of_any_size(spark):
    """Pieces whose sums pass the limit several times are folded; all others follow from running sums."""
    rng = random.Random(9)
    rows = []
    for k in range(30):
        size = rng.choice([10**6, U64_MAX // 3, U64_MAX])
        for h in sorted(rng.sample(range(3000), 30)):
            rows.append((k, h, rng.randrange(size), rng.choice([0, rng.randrange(size)])))
    wide = [F.col(c).cast("decimal(38,0)").alias(c) for c in ("up", "down")]
    df = spark.createDataFrame([(k, h, str(u), str(d)) for k, h, u, d in rows], "key bigint, height bigint, up string, down string").select("key", "height", *wide)
    for start in (0, 10**5, U64_MAX):
        made = clamp.prefixes(df, ["key"], ["height"], piece=256)
        got = {(r["key"], r["height"]): int(r["e"]) for r in made.select("key", "height", clamp.applied(F.col("f"), clamp.wide(start)).alias("e")).collect()}
        last = {}
        for k, h, up, down in rows:
            last[k] = max(min(last.get(k, start) + up, U64_MAX) - down, 0)
            assert got[k, h] == last[k]


def test_blocks_are_made_once(spark, sf_dir, monkeypatch):
    """What reads inputs and outputs of blocks reads them from one staged table."""
    made, kept = [], catalog.staged
    monkeypatch.setattr(catalog, "staged", lambda df, name: (made.append(name), kept(df, name))[1])
    for name in ("pass_moves", "decoded_ledger"):
        made.clear()
        same(catalog.queries()[name](spark, sf_dir), catalog.oracle_sql()[name], sf_dir)
        assert made.count("blocks") == 1 and made.count("outputs") == 1
