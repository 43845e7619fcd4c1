import random

from heightline.operators import chain, ledger, series, temporal

ROWS = [(1, 10, 100, 100), (1, 12, -40, 60), (1, 18, 90, 150)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "account bigint, height bigint, delta bigint, balance bigint")


def test_summary_of_the_fixture(spark):
    r = series.summary(frame(spark), 9, 20).first()
    assert (r.start_balance, r.end_balance, r.change_count, r.inflow, r.outflow, r.net_delta, r.first_height, r.latest_height) == (0, 150, 3, 190, 40, 150, 10, 18)
    assert (r.peak_balance, r.peak_height, r.low_balance, r.low_height) == (150, 18, 0, 9)


def test_series_and_flows_of_the_fixture(spark):
    accounts = spark.createDataFrame([(1,)], "account bigint")
    got = [tuple(r)[1:] for r in series.timeseries(frame(spark), accounts, 9, 20, 5).orderBy("bucket_start").collect()]
    assert got == [(9, 14, 60, 60, 2, 12), (14, 19, 150, 90, 1, 18), (19, 20, 150, 0, 0, None)]
    got = [tuple(r)[3:] for r in series.flows(frame(spark), accounts, 9, 20, 5).orderBy("bucket_start").collect()]
    assert got == [(100, 40, 60, 2), (90, 0, 90, 1), (0, 0, 0, 0)]


def test_peak_keeps_the_earliest_of_equals(spark):
    rows = [(1, 10, 5, 5), (1, 11, -5, 0), (1, 12, 5, 5)]
    r = series.summary(frame(spark, rows), 0, 20).first()
    assert (r.peak_height, r.low_height) == (10, 0)


def test_as_of_misses_are_zero_and_repeats_stay(spark):
    keys = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "pos int, account bigint")
    got = [tuple(r) for r in temporal.as_of_keys(frame(spark), keys, 12).orderBy("pos").collect()]
    assert got == [(0, 1, 12, -40, 60), (1, 2, 0, 0, 0), (2, 1, 12, -40, 60)]
    assert temporal.exact(frame(spark), 1, 11).count() == 0


def test_holders_drop_zero_after_the_choice_of_the_row(spark):
    rows = [(1, 1, 5, 5), (1, 2, -5, 0)]
    assert temporal.holders_at(frame(spark, rows), 2).count() == 0
    assert temporal.latest(frame(spark, rows)).count() == 1


def test_running_balance_in_pieces_equals_a_fold(spark):
    rng = random.Random(1)
    rows, want = [], []
    for account in range(5):
        balance = 0
        for height in sorted(rng.sample(range(5000), 200)):
            delta = rng.randint(-50, 60)
            balance += delta
            rows.append((account, height, delta))
            want.append((account, height, delta, balance))
    df = spark.createDataFrame(rows, "account bigint, height bigint, delta bigint")
    got = sorted(map(tuple, ledger.running_balance(df, piece=64).collect()))
    assert got == sorted(want)
    opening = spark.createDataFrame([(0, 1000)], "account bigint, balance bigint")
    assert {r.balance - w[3] for r, w in zip(ledger.running_balance(df, opening).where("account = 0").orderBy("height").collect(), want)} == {1000}


def test_chain_fixture_and_reorg(spark):
    kind = "txid string, vout int, account string, height bigint, value bigint"
    outs = [("c1", 0, "A", 1, 100), ("c2", 0, "M", 2, 50), ("t1", 0, "B", 2, 40), ("t1", 1, "C", 2, 60), ("t2", 0, "D", 2, 25), ("t2", 1, "A", 2, 15), ("c3", 0, "M2", 3, 50), ("t3", 0, "E", 3, 80), ("t3", 1, "A", 3, 5)]
    spent = [("c1", 0, "A", 2, 100), ("t1", 0, "B", 2, 40), ("t1", 1, "C", 3, 60), ("t2", 0, "D", 3, 25)]
    o, s = spark.createDataFrame(outs, kind), spark.createDataFrame(spent, kind)
    rows = {(r.account, r.height): (r.delta, r.balance) for r in ledger.running_balance(ledger.deltas(ledger.signed_rows(o, s))).collect()}
    assert rows["A", 2] == (-85, 15) and rows["A", 3] == (5, 20) and rows["B", 2] == (0, 0) and rows["C", 3] == (-60, 0) and rows["E", 3] == (80, 80)
    live = {(r.txid, r.vout) for r in ledger.live_outputs(o, s, ["txid", "vout"]).collect()}
    assert ("t3", 0) in live and ("t1", 1) not in live
    made, gone = ledger.created_and_removed(o, s, ["txid", "vout"], 2, 2)
    assert ("t1", 0) not in {(r.txid, r.vout) for r in made.collect()} and [(r.txid, r.vout) for r in gone.collect()] == [("c1", 0)]
    assert ledger.double_spends(s.union(s.limit(1)), ["txid", "vout"]).count() == 1


def test_linearize_follows_the_chain_and_prefers_canonical_forks(spark):
    z = chain.ZERO_HASH
    headers = spark.createDataFrame([("a", z), ("b", "a"), ("b2", "a"), ("c", "b"), ("x", "lost")], "block_hash string, prev_hash string")
    canonical = spark.createDataFrame([(1, "b")], "height bigint, block_hash string")
    assert sorted(map(tuple, chain.linearize(headers, canonical).collect())) == [(0, "a"), (1, "b"), (2, "c")]


def test_broken_links(spark):
    rows = spark.createDataFrame([(5, "e", "d"), (6, "f", "e"), (7, "g", "q"), (9, "i", "h")], "height bigint, block_hash string, prev_hash string")
    assert [r.height for r in chain.broken_links(rows).orderBy("height").collect()] == [7, 9]


def test_sat_position_past_the_outputs_is_a_fee(spark):
    i = spark.createDataFrame([("t", 0, 10), ("t", 1, 10)], "txid string, input_index int, value bigint")
    o = spark.createDataFrame([("t", 0, 12)], "txid string, vout int, value bigint")
    s = spark.createDataFrame([("t", 1, 1, "p"), ("t", 1, 5, "q")], "txid string, input_index int, offset bigint, name string")
    got = {r["name"]: (r.vout, r.new_offset) for r in chain.sat_positions(i, o, s).collect()}
    assert got == {"p": (0, 11), "q": (None, None)}


def test_passes_move_several_times_within_a_block(spark):
    i = spark.createDataFrame(
        [(7, 1, "b", 0, "a", 0, 10), (7, 2, "c", 0, "z", 0, 4), (7, 2, "c", 1, "b", 1, 6), (8, 0, "d", 0, "c", 0, 8), (8, 1, "e", 0, "q", 3, 5)],
        "height bigint, tx_index int, txid string, input_index int, prev_txid string, prev_vout bigint, value bigint",
    )
    o = spark.createDataFrame([("b", 0, 4, "bob"), ("b", 1, 6, "ann"), ("c", 0, 8, "bob"), ("d", 0, 3, "eve"), ("d", 1, 2, None), ("e", 0, 5, "ann")], "txid string, vout bigint, value bigint, owner string")
    held = [("p", "ann", "a", 0, 5), ("p", "ann", "a", 0, 5), ("r", "ann", "a", 0, 9), ("s", "eve", "z", 0, 3), ("u", "ann", "a", 0, 4), ("stays", "bob", "k", 1, 0), ("odd", "bob", None, None, None)]
    tracked = spark.createDataFrame(held, "inscription_id string, owner string, txid string, vout bigint, offset bigint")
    moves = chain.tracked_moves(i, o, tracked)
    got = {(r.inscription_id, r.hop): (r.height, r.txid, r.vout, r.offset, r.kind, r.new_owner, r.same_owner) for r in moves.collect()}
    assert len(got) == moves.count()
    assert got == {
        ("p", 1): (7, "b", 1, 1, "transfer", "ann", True), ("p", 2): (7, "c", 0, 5, "transfer", "bob", False), ("p", 3): (8, "d", None, None, "fee", None, False),
        ("r", 1): (7, "b", 1, 5, "transfer", "ann", True), ("r", 2): (7, "c", None, None, "fee", None, False),
        ("u", 1): (7, "b", 1, 0, "transfer", "ann", True), ("u", 2): (7, "c", 0, 4, "transfer", "bob", False), ("u", 3): (8, "d", 1, 1, "burn", None, False),
        ("s", 1): (7, "c", 0, 3, "transfer", "bob", False), ("s", 2): (8, "d", 1, 0, "burn", None, False),
    }
    assert sorted(r.inscription_id for r in chain.tracked_after(tracked, moves).collect()) == ["odd", "stays"]
    assert chain.tracked_moves(i, o, tracked.limit(0)).count() == 0


def test_upstream_drift(spark):
    ddl = "height bigint, block_hash string, commit string"

    def judged(ours, theirs, genesis=1):
        r = chain.upstream_drift(spark.createDataFrame(ours, ddl), spark.createDataFrame(theirs, ddl), genesis).first()
        return r.reasons, r.rollback_to

    ours = [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]
    assert judged(ours, ours) == ([], None)
    assert judged(ours, [*ours, (4, "d", "w")]) == ([], None)
    assert judged(ours, ours[:2]) == (["height_regressed", "commit_missing"], 2)
    assert judged(ours, [*ours[:2], (3, "q", "z")]) == (["anchor_drifted"], 2)
    assert judged(ours, [ours[0], (2, "b", "n"), (3, "c", "n")]) == (["commit_drifted"], 1)
    assert judged(ours, [(h, "q", "q") for h in (1, 2, 3, 4)]) == (["commit_drifted"], 0)
    assert judged([ours[0], ours[2]], [ours[0], ours[1], (3, "q", "z")]) == (["anchor_drifted"], 0)
    assert judged(ours, []) == (["height_regressed", "commit_missing"], 0)
    assert judged([], ours) == ([], None)
