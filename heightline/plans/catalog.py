"""Registry of the engine's queries and their DuckDB twins. The comment at each names its operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heightline import service
from heightline.functions import address, mint
from heightline.functions import binary as B
from heightline.operators import asserts, chain, commit, derived, energy, events, ledger, series, temporal
from heightline.plans import blockfile_ledger, lifecycle
from heightline.sources import blockfiles, envelopes
from heightline.sources import testdata as T
from heightline.staging import shared_dir, staged
from heightline.streaming.store import Store

H, H2 = 1000, 400
START, END, SIZE = 200, 1000, 100
EVENT_H = 300
ACCOUNT = 7

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracle: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: str | None = None):
    def keep(f):
        _queries[name] = f
        if sql is not None:
            parts = {"ledger": T.SQL_LEDGER, "history": T.SQL_HISTORY, None: ""}[base]
            head, _, body = sql.strip().partition("SELECT") if not sql.strip().startswith(",") else (None, None, sql.strip())
            _oracle[name] = (f"WITH {parts}{body}" if head is None else f"WITH {parts} SELECT{body}") if parts else sql.strip()
        return f

    return keep


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger.running_balance(ledger.deltas(T.signed_rows(spark, d)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance of every account over buckets of heights, carried forward."""
    return series.timeseries(_ledger(spark, sf_dir), None, START, END, SIZE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)


# --- ledger


@query("ledger_delta", "SELECT * FROM deltas", "ledger")  # U1, A1
def _(s, d):
    return ledger.deltas(ledger.signed_rows(T.outputs(s, d), T.spends(s, d)))


@query("ledger_running_balance", "SELECT * FROM ledger", "ledger")  # W1
def _(s, d):
    return _ledger(s, d)


@query("ledger_asof_height", f", {T.sql_as_of(H)} SELECT * FROM upto", "ledger")  # J4
def _(s, d):
    return temporal.as_of(_ledger(s, d), H)


@query("ledger_asof_zero_default", f", {T.sql_as_of(H2)} SELECT c_custkey AS account, coalesce(height, 0) AS height, coalesce(delta, 0) AS delta, coalesce(balance, 0) AS balance FROM customer LEFT JOIN upto ON account = c_custkey", "ledger")  # J4, Z1
def _(s, d):
    return temporal.as_of_keys(_ledger(s, d), T.table(s, d, "customer").select(F.col("c_custkey").alias("account")), H2)


@query("ledger_asof_many", """, points AS (SELECT o_custkey AS account, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::BIGINT - 30 AS at, o_orderkey AS point FROM orders)
SELECT p.account, p.at, p.point, coalesce(l.height, 0) AS height, coalesce(l.delta, 0) AS delta, coalesce(l.balance, 0) AS balance FROM points p ASOF LEFT JOIN ledger l ON p.account = l.account AND p.at >= l.height""", "ledger")  # J7
def _(s, d):
    points = T.outputs(s, d).select("account", (F.col("height") - 30).alias("at"), F.col("outpoint").alias("point"))
    return temporal.as_of_many(_ledger(s, d), points)


@query("ledger_range", f"SELECT * FROM ledger WHERE account = {ACCOUNT} AND height >= {START} AND height < {END}", "ledger")  # Z2
def _(s, d):
    return temporal.in_range(_ledger(s, d), ACCOUNT, START, END)


@query("ledger_full_history", f"SELECT * FROM ledger WHERE account = {ACCOUNT}", "ledger")  # Z4
def _(s, d):
    return temporal.in_range(_ledger(s, d), ACCOUNT, 0, 4294967295)


@query("ledger_exact_delta", "SELECT * FROM ledger WHERE height = 500", "ledger")  # S12, Z3
def _(s, d):
    return _ledger(s, d).where("height = 500")


@query("ledger_latest", f", {T.sql_as_of(10**9)} SELECT * FROM upto", "ledger")  # S14
def _(s, d):
    return temporal.latest(_ledger(s, d))


@query("ledger_latest_from", f", {T.sql_as_of(10**9)} SELECT * FROM upto WHERE account <= 60", "ledger")  # S14
def _(s, d):
    return temporal.latest(_ledger(s, d), 60)


@query("ledger_traverse_at_height", f", {T.sql_as_of(H)} SELECT * FROM upto WHERE balance > 0", "ledger")  # S15
def _(s, d):
    return temporal.holders_at(_ledger(s, d), H)


@query("ledger_batch_ordered", f", {T.sql_as_of(H)}, keys(pos, account) AS (VALUES (0, 9), (1, 3), (2, -5), (3, 9), (4, 12)) SELECT pos, keys.account::BIGINT AS account, coalesce(height, 0) AS height, coalesce(delta, 0) AS delta, coalesce(balance, 0) AS balance FROM keys LEFT JOIN upto ON upto.account = keys.account", "ledger")  # J5, B2
def _(s, d):
    keys = s.createDataFrame([(0, 9), (1, 3), (2, -5), (3, 9), (4, 12)], "pos int, account bigint")
    return temporal.as_of_keys(_ledger(s, d), keys, H)


@query("ledger_keyset_page", f", {T.sql_as_of(H)} SELECT * FROM upto WHERE balance > 0 AND account > 40 ORDER BY account LIMIT 25", "ledger")  # S16
def _(s, d):
    return temporal.keyset_page(temporal.holders_at(_ledger(s, d), H), "account", 40, 25)


@query("ledger_offset_page", f", {T.sql_as_of(H)} SELECT * FROM upto WHERE balance > 0 ORDER BY account LIMIT 25 OFFSET 30", "ledger")  # S16
def _(s, d):
    return temporal.offset_page(temporal.holders_at(_ledger(s, d), H), ["account"], 30, 25)


@query("ledger_counts", "SELECT (SELECT count(*) FROM ledger) AS ledger_rows, (SELECT count(*) FROM outs) AS outputs, (SELECT count(*) FROM spends) AS spends", "ledger")  # S17
def _(s, d):
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(_ledger(s, d), "ledger_rows").join(count(T.outputs(s, d), "outputs")).join(count(T.spends(s, d), "spends"))


@query("ledger_negative_rows", """, bad AS (SELECT account, height, sum(delta)::BIGINT AS delta FROM (SELECT account, height, value AS delta FROM outs WHERE outpoint % 40 <> 0 UNION ALL SELECT account, height, -value FROM spends) GROUP BY account, height),
summed AS (SELECT account, height, delta, (sum(delta) OVER (PARTITION BY account ORDER BY height ROWS UNBOUNDED PRECEDING))::BIGINT AS balance FROM bad) SELECT * FROM summed WHERE balance < 0""", "ledger")  # W1 assertion
def _(s, d):
    """Over a ledger that lacks one output in forty, the faults planted for the check."""
    lacking = ledger.signed_rows(T.outputs(s, d).where("outpoint % 40 <> 0"), T.spends(s, d))
    return ledger.negative_balances(ledger.running_balance(ledger.deltas(lacking)))


@query("ledger_verify", """, other AS (SELECT account, height, sum(x)::BIGINT AS delta FROM (SELECT account, height, value + CASE WHEN outpoint % 97 = 0 THEN 1 ELSE 0 END AS x FROM outs UNION ALL SELECT account, height, -value FROM spends WHERE outpoint % 89 <> 0) GROUP BY account, height)
SELECT coalesce(l.account, o.account) AS account, coalesce(l.height, o.height) AS height, CASE WHEN o.account IS NULL THEN 'left_only' WHEN l.account IS NULL THEN 'right_only' ELSE 'mismatch' END AS difference
FROM ledger l FULL JOIN other o ON l.account = o.account AND l.height = o.height WHERE l.account IS NULL OR o.account IS NULL OR l.delta <> o.delta""", "ledger")  # S18, Z18
def _(s, d):
    """Against a second history with wrong values and missing spends, the faults planted for the check."""
    wrong = F.col("value") + F.when(F.col("outpoint") % 97 == 0, 1).otherwise(0)
    again = T.outputs(s, d).select("account", "height", wrong.alias("x")).unionByName(T.spends(s, d).where("outpoint % 89 <> 0").select("account", "height", (-F.col("value")).alias("x"))).groupBy("account", "height").agg(F.sum("x").alias("delta"))
    return ledger.ledger_difference(_ledger(s, d), again, ["account", "height"], ["delta"])


@query("utxo_live_set", "SELECT outs.* FROM outs WHERE outpoint NOT IN (SELECT outpoint FROM spends)", "ledger")  # J3
def _(s, d):
    return ledger.live_outputs(T.outputs(s, d), T.spends(s, d), ["outpoint"])


@query("utxo_batch_created", f"SELECT outs.* FROM outs WHERE height BETWEEN {START} AND {END} AND outpoint NOT IN (SELECT outpoint FROM spends WHERE height BETWEEN {START} AND {END})", "ledger")  # J3
def _(s, d):
    return ledger.created_and_removed(T.outputs(s, d), T.spends(s, d), ["outpoint"], START, END)[0]


@query("utxo_batch_removed", f"SELECT spends.* FROM spends WHERE height BETWEEN {START} AND {END} AND outpoint NOT IN (SELECT outpoint FROM outs WHERE height BETWEEN {START} AND {END})", "ledger")  # J3, Z5
def _(s, d):
    return ledger.created_and_removed(T.outputs(s, d), T.spends(s, d), ["outpoint"], START, END)[1]


@query("utxo_resolved_inputs", "SELECT outpoint, spends.height AS spent_height, outs.account, outs.value FROM spends JOIN outs USING (outpoint)", "ledger")  # J1, S8
def _(s, d):
    return ledger.resolved_inputs(T.spends(s, d).select("outpoint", F.col("height").alias("spent_height")), T.outputs(s, d), ["outpoint"])


@query("utxo_resolved_fallback", "SELECT outpoint, spends.height AS spent_height, outs.account, outs.value, CASE WHEN outpoint % 3 <> 0 THEN 'first' ELSE 'second' END AS source FROM spends JOIN outs USING (outpoint)", "ledger")  # S8
def _(s, d):
    """The first source lacks every third output, which the second one has."""
    outs = T.outputs(s, d).select("outpoint", "account", "value")
    return asserts.resolved_inputs(T.spends(s, d).select("outpoint", F.col("height").alias("spent_height")), outs.where("outpoint % 3 <> 0"), outs.where("outpoint % 2 = 0 or outpoint % 3 = 0"), ["outpoint"])


@query("utxo_touched_accounts", f"SELECT account FROM outs WHERE height BETWEEN {START} AND {START + 5} UNION SELECT account FROM spends WHERE height BETWEEN {START} AND {START + 5}", "ledger")  # U2, U3
def _(s, d):
    return ledger.touched_accounts(T.outputs(s, d), T.spends(s, d), START, START + 5)


@query("double_spend_check", "SELECT outpoint, count(*) AS n FROM (SELECT outpoint FROM spends UNION ALL SELECT outpoint FROM spends WHERE outpoint % 50 = 0) GROUP BY outpoint HAVING count(*) > 1", "ledger")  # J2
def _(s, d):
    """Over spends of which one in fifty comes twice, the faults planted for the check."""
    spends = T.spends(s, d)
    return ledger.double_spends(spends.unionByName(spends.where("outpoint % 50 = 0")), ["outpoint"])


@query("addr_summary", f""", {T.sql_as_of(START - 1, "before")}, inside AS (SELECT * FROM ledger WHERE height >= {START} AND height < {END}),
accounts AS (SELECT account FROM before UNION SELECT account FROM inside),
rows_ AS (SELECT a.account, {START}::BIGINT AS height, NULL::BIGINT AS delta, coalesce(balance, 0) AS balance, 0 AS o FROM accounts a LEFT JOIN before USING (account) UNION ALL SELECT account, height, delta, balance, 1 FROM inside),
agg AS (SELECT account, arg_min(balance, height * 2 + o) AS start_balance, arg_max(balance, height * 2 + o) AS end_balance, count(delta) AS change_count,
  coalesce(sum(delta) FILTER (WHERE delta >= 0), 0)::BIGINT AS inflow, coalesce(-sum(delta) FILTER (WHERE delta < 0), 0)::BIGINT AS outflow, coalesce(sum(delta), 0)::BIGINT AS net_delta,
  min(height) FILTER (WHERE o = 1) AS first_height, max(height) FILTER (WHERE o = 1) AS latest_height, max(balance) AS peak_balance, min(balance) AS low_balance FROM rows_ GROUP BY account)
SELECT agg.*, (SELECT min(height) FROM rows_ r WHERE r.account = agg.account AND r.balance = peak_balance) AS peak_height, (SELECT min(height) FROM rows_ r WHERE r.account = agg.account AND r.balance = low_balance) AS low_height FROM agg""", "ledger")  # A3
def _(s, d):
    return series.summary(_ledger(s, d), START, END)


_SPINE = f"""spine AS (SELECT account, b AS bucket_start, least(b + {SIZE}, {END})::BIGINT AS bucket_end FROM (SELECT DISTINCT account FROM ledger), (SELECT unnest(generate_series({START}, {END - 1}, {SIZE}))::BIGINT AS b)),
inside AS (SELECT *, ({START} + ((height - {START}) // {SIZE}) * {SIZE})::BIGINT AS bucket_start FROM ledger WHERE height >= {START} AND height < {END})"""


@query("addr_timeseries", f""", {_SPINE}, {T.sql_as_of(START - 1, "before")},
m AS (SELECT account, bucket_start, arg_max(balance, height) AS b, sum(delta)::BIGINT AS net_delta, count(*) AS change_count, max(height) AS latest_height FROM inside GROUP BY 1, 2)
SELECT account, bucket_start, bucket_end, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY account ORDER BY bucket_start ROWS UNBOUNDED PRECEDING), before.balance, 0) AS balance, coalesce(net_delta, 0) AS net_delta, coalesce(change_count, 0) AS change_count, latest_height
FROM spine LEFT JOIN m USING (account, bucket_start) LEFT JOIN before USING (account)""", "ledger")  # A4, W3
def _(s, d):
    return series.timeseries(_ledger(s, d), None, START, END, SIZE)


@query("addr_flow_buckets", f""", {_SPINE}, m AS (SELECT account, bucket_start, coalesce(sum(delta) FILTER (WHERE delta >= 0), 0)::BIGINT AS i, coalesce(-sum(delta) FILTER (WHERE delta < 0), 0)::BIGINT AS o, sum(delta)::BIGINT AS n, count(*) AS c FROM inside GROUP BY 1, 2)
SELECT account, bucket_start, bucket_end, coalesce(i, 0) AS inflow, coalesce(o, 0) AS outflow, coalesce(n, 0) AS net_delta, coalesce(c, 0) AS change_count FROM spine LEFT JOIN m USING (account, bucket_start)""", "ledger")  # A5
def _(s, d):
    return series.flows(_ledger(s, d), None, START, END, SIZE)


@query("batch_totals_rollup", "SELECT account, count(*) AS records, max(height) AS latest_height, sum(delta)::BIGINT AS total_delta FROM ledger GROUP BY ROLLUP (account)", "ledger")  # A16
def _(s, d):
    return series.batch_totals(_ledger(s, d))


@query("client_summary", "SELECT account, (arg_min(balance, height) - arg_min(delta, height))::BIGINT AS start_balance, arg_max(balance, height) AS end_balance, max(balance) AS peak_balance, min(balance) AS low_balance, count(*) AS change_count, sum(delta)::BIGINT AS net_delta FROM ledger GROUP BY account", "ledger")  # Z23
def _(s, d):
    return series.client_summary(_ledger(s, d))


@query("undo_window", "SELECT * FROM ledger WHERE height >= greatest(0, 2000 - 63)", "ledger")  # W9
def _(s, d):
    return temporal.undo_window(_ledger(s, d), 2000)


@query("height_gap_backfill", "SELECT unnest(generate_series(0, 2600))::BIGINT AS height EXCEPT SELECT height FROM ledger", "ledger")  # R12, Z11
def _(s, d):
    return temporal.missing_heights(_ledger(s, d).select("height").distinct(), 0, 2600)


@query("first_missing_height", "SELECT min(height) AS height FROM (SELECT unnest(generate_series(0, 2600))::BIGINT AS height EXCEPT SELECT height FROM ledger)", "ledger")  # Z11
def _(s, d):
    return temporal.first_missing(_ledger(s, d).select("height").distinct(), 0, 2600)


def _store(s: SparkSession, name: str) -> Store:
    return Store(s, f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}", retention=10**9)


@query("rollback_replay_equality", "SELECT * FROM ledger", "ledger")  # R4, K1
def _(s, d):
    """The ledger of a store after three batches, a rollback into the second one, and the replay of what came behind."""
    rows = staged(T.signed_rows(s, d).withColumn("account", F.col("account").cast("string")), "signed")
    store = _store(s, "replay")
    for low, high in ((-1, H2), (H2, H), (H, 10**6)):
        store.commit(high, {"ledger": rows.where((F.col("height") > low) & (F.col("height") <= high))})
    store.rollback(H - 200)
    store.commit(10**6, {"ledger": rows.where(F.col("height") > H - 200)})
    return ledger.running_balance(ledger.deltas(store.read("ledger").withColumn("account", F.col("account").cast("bigint"))))


_BLOCKS = "blocks AS (SELECT DISTINCT height, sha256('a' || height) AS block_hash FROM ledger), forks AS (SELECT height, CASE WHEN height > 1234 THEN sha256('b' || height) ELSE block_hash END AS block_hash FROM blocks)"


@query("reorg_common_ancestor", f", {_BLOCKS} SELECT coalesce(max(b.height), 0)::BIGINT AS ancestor_height FROM blocks b JOIN forks f ON b.height = f.height AND b.block_hash = f.block_hash", "ledger")  # J16
def _(s, d):
    ours = _ledger(s, d).select("height").distinct().withColumn("block_hash", F.sha2(F.concat(F.lit("a"), F.col("height").cast("string")), 256))
    theirs = ours.withColumn("block_hash", F.when(F.col("height") > 1234, F.sha2(F.concat(F.lit("b"), F.col("height").cast("string")), 256)).otherwise(F.col("block_hash")))
    return chain.common_ancestor(ours, theirs)


def _chain(s, d):
    """A block for each height of the ledger, numbered from 0; each names the one below it."""
    hashed = lambda c: F.sha2(c.cast("string"), 256)
    placed = derived.numbered(T.signed_rows(s, d).select("height").distinct()).select(F.col("_i").cast("bigint").alias("height"))
    return placed.select("height", hashed(F.col("height")).alias("block_hash"), F.when(F.col("height") == 0, chain.ZERO_HASH).otherwise(hashed(F.col("height") - 1)).alias("prev_hash"))


@query("linearized_chain", ", n AS (SELECT count(DISTINCT height) AS n FROM deltas) SELECT i AS height, sha256(i::VARCHAR) AS block_hash FROM (SELECT unnest(range(n)) AS i FROM n)", "ledger")  # S4
def _(s, d):
    return chain.linearize(_chain(s, d).select("block_hash", "prev_hash"))


@query("block_index_verdicts", """, n AS (SELECT count(DISTINCT height) AS n FROM deltas)
SELECT 'whole' AS name, 'reuse' AS outcome, NULL AS reason, n - 1 AS high, n - 1 AS tip FROM n
UNION ALL SELECT 'half', 'extend', NULL, n // 2 - 1, n - 1 FROM n
UNION ALL SELECT 'holes', 'rebuild', 'gap', n - CASE WHEN n % 500 = 251 THEN 2 ELSE 1 END, n - 1 FROM n""", "ledger")  # S5
def _(s, d):
    """A restored index that ends at the tip, one that ends half-way, and one that lacks some heights."""
    whole = staged(_chain(s, d), "chain")
    tip = whole.agg(F.max_by(F.struct("height", "block_hash"), "height").alias("t")).select("t.*")
    half = whole.join(F.broadcast(tip.select(F.col("height").alias("_tip")))).where("height < (_tip + 1) div 2").drop("_tip")  # one row
    kinds = {"whole": whole, "half": half, "holes": whole.where("height % 500 <> 250")}
    return reduce(DataFrame.unionByName, [blockfiles.index_verdict(rows, tip).select(F.lit(name).alias("name"), "outcome", "reason", "high", "tip") for name, rows in kinds.items()])


# --- event log


@query("pass_snapshot_at", f", {T.sql_snapshot(EVENT_H)} SELECT * FROM snap JOIN passes USING (inscription_id)", "history")  # J8, J9, W2, P2
def _(s, d):
    return events.with_attributes(events.snapshot(T.history(s, d), EVENT_H), T.passes(s, d))


@query("pass_stats_at", f", {T.sql_snapshot(EVENT_H)} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE new_state = '{x}') AS {x}" for x in ("active", "dormant", "consumed", "burned", "invalid")) + " FROM snap", "history")  # A6, P3
def _(s, d):
    return events.state_counts(T.history(s, d), EVENT_H)


@query("pass_count_by_states", f", {T.sql_snapshot(EVENT_H)} SELECT count(*) AS n FROM snap WHERE new_state IN ('active', 'dormant')", "history")  # A7, A8, F9
def _(s, d):
    return events.in_states(events.snapshot(T.history(s, d), EVENT_H), ["active", "dormant"]).agg(F.count("*").alias("n"))


@query("active_passes_page", f", {T.sql_snapshot(EVENT_H)} SELECT * FROM snap WHERE new_state = 'active' ORDER BY block_height DESC, id DESC LIMIT 20 OFFSET 10", "history")  # P1, T2
def _(s, d):
    return temporal.offset_page(events.in_states(events.snapshot(T.history(s, d), EVENT_H), ["active"]), events.by_latest_event(), 10, 20)


@query("owner_passes_page", f", {T.sql_snapshot(EVENT_H)} SELECT * FROM snap JOIN passes USING (inscription_id) WHERE new_owner = 'o14' ORDER BY block_height DESC, id DESC LIMIT 20", "history")  # P4, T3
def _(s, d):
    found = events.with_attributes(events.snapshot(T.history(s, d), EVENT_H).where("new_owner = 'o14'"), T.passes(s, d))
    return temporal.offset_page(found, events.by_latest_event(), 0, 20)


@query("recent_passes_page", f", {T.sql_snapshot(EVENT_H)} SELECT * FROM snap JOIN passes USING (inscription_id) ORDER BY mint_block_height DESC, inscription_number DESC, id DESC LIMIT 25", "history")  # P5, T4
def _(s, d):
    return temporal.offset_page(events.with_attributes(events.snapshot(T.history(s, d), EVENT_H), T.passes(s, d)), events.by_mint(), 0, 25)


@query("owner_active_pass", f", {T.sql_snapshot(EVENT_H)} SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY new_owner ORDER BY block_height DESC, id DESC) AS n FROM snap WHERE new_state = 'active') WHERE n = 1", "history")  # P6, Z14
def _(s, d):
    return events.last_active_pass(events.snapshot(T.history(s, d), EVENT_H))


@query("pass_history_range", "SELECT * FROM history WHERE inscription_id = '17' AND block_height BETWEEN 10 AND 700", "history")  # P7, T6
def _(s, d):
    return events.history_range(T.history(s, d), "17", 10, 700)


@query("invalid_passes_page", f", {T.sql_snapshot(10**9)} SELECT * FROM snap JOIN passes USING (inscription_id) WHERE new_state = 'invalid' AND mint_block_height BETWEEN 0 AND 500 ORDER BY mint_block_height DESC, inscription_number DESC, inscription_id LIMIT 30", "history")  # P11, T5
def _(s, d):
    found = events.with_attributes(events.snapshot(T.history(s, d), 10**9), T.passes(s, d)).where("new_state = 'invalid' and mint_block_height between 0 and 500")
    return temporal.offset_page(found, [F.desc("mint_block_height"), F.desc("inscription_number"), F.asc("inscription_id")], 0, 30)


@query("duplicate_active_owner", f", {T.sql_snapshot(EVENT_H)} SELECT 'o' || (inscription_id::BIGINT % 3) AS new_owner, count(*) AS n FROM snap WHERE new_state = 'active' GROUP BY 1 HAVING count(*) > 1", "history")  # A12
def _(s, d):
    """Over passes dealt to three owners, so that some have several."""
    few = F.concat(F.lit("o"), (F.col("inscription_id").cast("bigint") % 3).cast("string"))
    return events.duplicate_owners(events.snapshot(T.history(s, d), EVENT_H).withColumn("new_owner", few))


@query("event_order", "SELECT *, row_number() OVER (PARTITION BY block_height ORDER BY new_owner, CASE WHEN new_state = 'active' THEN 1 ELSE 0 END, id, id, inscription_id)::INT AS event_order FROM history", "history")  # W6
def _(s, d):
    rows = T.history(s, d).withColumns({"height": F.col("block_height"), "tx_position": F.col("new_owner"), "priority": F.when(F.col("new_state") == "active", 1).otherwise(0), "input_index": F.col("id"), "inscription_index": F.col("id")})
    return events.canonical_order(rows).drop("height", "tx_position", "priority", "input_index", "inscription_index")


@query("ambiguous_groups", "SELECT height, commit_outpoint, id FROM (SELECT id, block_height AS height, id % 3 AS commit_outpoint, count(*) OVER (PARTITION BY block_height, id % 3) AS n FROM history) WHERE n > 1", "history")  # A11
def _(s, d):
    rows = T.history(s, d).select("id", F.col("block_height").alias("height"), (F.col("id") % 3).alias("commit_outpoint"))
    return events.ambiguous_reveals(rows).select("height", "commit_outpoint", "id")


@query("source_diff", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_primary' WHEN a.id IS NULL THEN 'only_shadow' ELSE 'content_mismatch' END AS difference FROM (SELECT * FROM history WHERE id % 7 <> 0) a FULL JOIN (SELECT id, CASE WHEN id % 11 = 0 THEN 'x' ELSE new_state END AS new_state, new_owner FROM history WHERE id % 5 <> 0) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.new_state <> b.new_state OR a.new_owner <> b.new_owner", "history")  # J15
def _(s, d):
    rows = T.history(s, d)
    shadow = rows.where("id % 5 <> 0").withColumn("new_state", F.when(F.col("id") % 11 == 0, "x").otherwise(F.col("new_state")))
    return chain.source_difference(rows.where("id % 7 <> 0"), shadow, "id", ["new_state", "new_owner"])


@query("source_missing_ids", "SELECT id FROM history WHERE id % 7 <> 0 EXCEPT ALL SELECT id FROM history WHERE id % 5 <> 0", "history")  # U4
def _(s, d):
    rows = T.history(s, d)
    return chain.missing_ids(rows.where("id % 7 <> 0"), rows.where("id % 5 <> 0"), "id")


@query("source_ids_apart", "SELECT id, 'primary' AS only FROM (SELECT id FROM history WHERE id % 7 <> 0 EXCEPT ALL SELECT id FROM history WHERE id % 5 <> 0) UNION ALL SELECT id, 'shadow' FROM (SELECT id FROM history WHERE id % 5 <> 0 EXCEPT ALL SELECT id FROM history WHERE id % 7 <> 0)", "history")  # U4
def _(s, d):
    rows = T.history(s, d)
    return chain.ids_apart(rows.where("id % 7 <> 0"), rows.where("id % 5 <> 0"), "id")


@query("state_codes", "SELECT id, CASE new_state WHEN 'active' THEN 0 WHEN 'dormant' THEN 1 WHEN 'consumed' THEN 2 WHEN 'burned' THEN 3 WHEN 'invalid' THEN 4 END::INT AS code, new_state AS state FROM history", "history")  # X14
def _(s, d):
    return T.history(s, d).select("id", events.state_code(F.upper("new_state")).alias("code")).withColumn("state", events.state_name(F.col("code")))


@query("prev_texts", f", {T.sql_snapshot(EVENT_H)} SELECT inscription_id, CASE WHEN inscription_id::BIGINT % 5 = 0 THEN '' ELSE 'a' || inscription_id || ',b' || inscription_id END AS prev, CASE WHEN inscription_id::BIGINT % 5 = 0 THEN 0 ELSE 2 END::INT AS n FROM snap", "history")  # X13
def _(s, d):
    name = F.col("inscription_id")
    prev = F.when(name.cast("bigint") % 5 != 0, F.array(F.concat(F.lit("a"), name), F.concat(F.lit("b"), name)))
    rows = events.snapshot(T.history(s, d), EVENT_H).select("inscription_id", events.prev_text(prev).alias("prev"))
    return rows.withColumn("n", F.size(events.prev_list(F.col("prev"))))


@query("state_updates", f""", {T.sql_snapshot(EVENT_H)}, asked AS (SELECT inscription_id FROM passes)
SELECT a.inscription_id, CASE WHEN new_state = 'active' THEN 'dormant' ELSE new_state END AS new_state, CASE WHEN new_state IS NULL THEN 'missing' WHEN new_state = 'active' THEN 'applied' ELSE 'stale' END AS outcome
FROM asked a LEFT JOIN snap USING (inscription_id)""", "history")  # Z16
def _(s, d):
    asked = T.passes(s, d).select("inscription_id", F.lit("active").alias("expected"), F.lit("dormant").alias("value"))
    return events.compare_and_set(events.snapshot(T.history(s, d), EVENT_H), asked, "inscription_id", "new_state")


@query("future_rows", f"SELECT 'history' AS table_name, count(*) AS n FROM history WHERE block_height > {EVENT_H}", "history")  # F14
def _(s, d):
    return events.future_rows({"history": T.history(s, d)}, EVENT_H)


@query("rollback_history", f"SELECT * FROM history WHERE block_height <= {EVENT_H}", "history")  # U6, Z13
def _(s, d):
    return chain.rolled_back(T.history(s, d), EVENT_H, "block_height")


@query("rollback_current_rows", f", {T.sql_snapshot(EVENT_H)} SELECT inscription_id, block_height, id, new_state AS state, new_owner AS owner FROM snap", "history")  # U6, K8
def _(s, d):
    """Current rows of a store's passes after a rollback between two batches of the log."""
    log, store = T.history(s, d), _store(s, "current")
    store.commit(EVENT_H // 2, {"log": log.where(F.col("block_height") <= EVENT_H // 2)})
    store.commit(10**6, {"log": log.where(F.col("block_height") > EVENT_H // 2)})
    store.rollback(EVENT_H)
    return store.read("passes").drop("satpoint")


@query("event_positions", "SELECT id, block_height, id % 7 AS tx_position, id % 3 AS input_index FROM history", "history")  # J13
def _(s, d):
    rows = T.history(s, d).select("id", "block_height")
    places = rows.select("id", "block_height", (F.col("id") % 7).alias("tx_position"), (F.col("id") % 3).alias("input_index"))
    return asserts.event_positions(rows, places, ["block_height", "id"])


@query("runs_summary", "SELECT event_type, new_state, count(*) AS runs, count(*) FILTER (WHERE id % 3 = 0) AS failures, min(block_height) AS min_seconds, (sum(block_height)::DOUBLE / count(*)) AS avg_seconds, max(block_height) AS max_seconds FROM history GROUP BY ALL", "history")  # A15
def _(s, d):
    rows = T.history(s, d).select("event_type", "new_state", (F.col("id") % 3 != 0).alias("ok"), F.col("block_height").alias("seconds"))
    return series.runs_summary(rows, ["event_type", "new_state"])


# --- energy

_ENERGY = """, keyed AS (SELECT account AS key, height, balance, delta, lag(height) OVER w AS h0, lag(balance) OVER w AS b0 FROM ledger WINDOW w AS (PARTITION BY account ORDER BY height)),
steps AS (SELECT *, CASE WHEN h0 IS NULL THEN 0 ELSE (CASE WHEN b0 < 100000 THEN 0 ELSE b0::HUGEINT * 10000 * (height - h0) END) - (CASE WHEN delta >= 0 THEN 0 ELSE (-delta)::HUGEINT * 43200000 END) END AS st FROM keyed),
sums AS (SELECT *, sum(st) OVER w AS sn FROM steps WINDOW w AS (PARTITION BY key ORDER BY height ROWS UNBOUNDED PRECEDING)),
energy AS (SELECT key, height, balance, delta, coalesce(last_value(CASE WHEN delta < 0 THEN height END IGNORE NULLS) OVER w, first_value(height) OVER w) AS active_height, (sn - least(min(sn) OVER w, 0))::BIGINT AS energy FROM sums WINDOW w AS (PARTITION BY key ORDER BY height ROWS UNBOUNDED PRECEDING))"""
_ENERGY_AT = f", known AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY height DESC) AS n FROM energy WHERE height <= {H}) WHERE n = 1), projected AS (SELECT *, (energy + CASE WHEN balance < 100000 THEN 0 ELSE balance::HUGEINT * 10000 * ({H} - height) END)::BIGINT AS projected FROM known)"


def _energy(s, d, account: int | None = None):
    """Energy records of all accounts, or of one."""
    signed = T.signed_rows(s, d)
    own = signed if account is None else signed.where(F.col("account") == account)
    rows = ledger.running_balance(ledger.deltas(own)).select(F.col("account").alias("key"), "height", "balance", "delta")
    return energy.records(rows).withColumn("energy", F.col("energy").cast("bigint"))


def _projected(s, d):
    return energy.projected(_energy(s, d), H).withColumn("projected", F.col("projected").cast("bigint"))


@query("energy_records", f"{_ENERGY} SELECT * FROM energy", "ledger")  # W4
def _(s, d):
    return _energy(s, d)


@query("energy_asof_projected", f"{_ENERGY}{_ENERGY_AT} SELECT * FROM projected", "ledger")  # J6, W5, P8
def _(s, d):
    return _projected(s, d)


@query("energy_range", f"{_ENERGY} SELECT * FROM energy WHERE key = {ACCOUNT} AND height BETWEEN {START} AND {END}", "ledger")  # P10, T7
def _(s, d):
    return _energy(s, d, ACCOUNT).where(F.col("height").between(START, END))


@query("energy_max_height", f"{_ENERGY} SELECT max(height) AS height FROM energy", "ledger")  # A14
def _(s, d):
    return _energy(s, d).agg(F.max("height").alias("height"))


@query("energy_leaderboard", f"{_ENERGY}{_ENERGY_AT} SELECT key, projected AS energy, height AS record_height FROM projected ORDER BY projected DESC, height DESC, key LIMIT 100", "ledger")  # T1, P9
def _(s, d):
    return energy.leaderboard(_projected(s, d).select("key", F.col("projected").alias("energy"), F.col("height").alias("record_height")), 100)


@query("cross_checked_leaderboard", f"{_ENERGY}{_ENERGY_AT} SELECT key, projected AS energy FROM projected ORDER BY projected DESC, height DESC, key LIMIT 100", "ledger")  # J17
def _(s, d):
    """The leaderboard, once it agrees with the records, and the owners' balances with what was settled at the height."""
    found = staged(_projected(s, d).select("key", F.col("projected").alias("energy"), F.col("height").alias("record_height"), "balance"), "projected")
    active = found.select(F.col("key").alias("owner"), "balance")
    rows = found.select(F.col("key").alias("account"), "balance", F.col("record_height").alias("height"))
    settled = events.settlement(active.select("owner"), rows, H)
    return asserts.cross_checked(energy.leaderboard(found, 100).select("key", "energy"), found.select("key", "energy"), active, settled)


@query("candidate_winner", f"{_ENERGY}{_ENERGY_AT} SELECT key, projected AS energy FROM projected ORDER BY projected DESC, key LIMIT 1", "ledger")  # T8
def _(s, d):
    return energy.winner(_projected(s, d).select("key", F.col("projected").alias("energy")))


@query("active_balance_settlement", f", {T.sql_as_of(H)} SELECT {H}::BIGINT AS block_height, least(coalesce(sum(balance), 0), 18446744073709551615)::BIGINT AS total_balance, count(*) AS active_address_count FROM upto JOIN customer ON c_custkey = account WHERE c_mktsegment = 'BUILDING'", "ledger")  # J10, A9
def _(s, d):
    rows = temporal.as_of(_ledger(s, d), H)
    active = T.table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("owner"))
    return events.settlement(active.join(rows.select(F.col("account").alias("owner")), "owner", "left_semi"), rows, H).withColumn("total_balance", F.col("total_balance").cast("bigint"))


@query("settlement_faults", f", {T.sql_as_of(H)} SELECT c_custkey AS owner, 'missing' AS fault FROM customer LEFT JOIN upto ON c_custkey = account WHERE account IS NULL", "ledger")  # J10
def _(s, d):
    active = T.table(s, d, "customer").select(F.col("c_custkey").alias("owner"))
    return events.settlement_faults(active, temporal.as_of(_ledger(s, d), H), H)


@query("settled_deltas", f", {T.sql_as_of(H)} SELECT account, height, CASE WHEN height < {H} THEN 0 ELSE delta END AS delta, balance FROM upto", "ledger")  # W3
def _(s, d):
    return events.settled_deltas(temporal.as_of(_ledger(s, d), H), H)


# --- positions, hashes, contents, derived


@query("sat_position_range_join", """
WITH i AS (SELECT DISTINCT l_orderkey AS txid, l_linenumber AS input_index FROM lineitem), v AS (SELECT txid, input_index, 100 + (txid * 7 + input_index * 13) % 50 AS value FROM i),
s AS (SELECT txid, input_index, coalesce(sum(value) OVER (PARTITION BY txid ORDER BY input_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 5 AS position FROM v),
o AS (SELECT txid, input_index AS vout, 90 + (txid * 3 + input_index * 5) % 40 AS value FROM i), p AS (SELECT txid, vout, sum(value) OVER (PARTITION BY txid ORDER BY vout ROWS UNBOUNDED PRECEDING) AS t, value FROM o)
SELECT s.txid, s.input_index, 5 AS "offset", position::BIGINT AS position, vout, (position - (t - value))::BIGINT AS new_offset FROM s LEFT JOIN p ON s.txid = p.txid AND position >= t - value AND position < t""")  # W7, J12, Z21
def _(s, d):
    i = T.table(s, d, "lineitem").select(F.col("l_orderkey").alias("txid"), F.col("l_linenumber").alias("input_index")).distinct()
    inputs = i.withColumn("value", 100 + (F.col("txid") * 7 + F.col("input_index") * 13) % 50)
    outputs = i.select("txid", F.col("input_index").alias("vout"), (90 + (F.col("txid") * 3 + F.col("input_index") * 5) % 40).alias("value"))
    return chain.sat_positions(inputs, outputs, i.withColumn("offset", F.lit(5)))


@query("script_hash_reverse", "SELECT event_id, lower(array_to_string([substr(sha256(props), CAST(2 * k - 1 AS INT), 2) for k in range(32, 0, -1)], '')) AS script_hash FROM events")  # X1
def _(s, d):
    return T.table(s, d, "events").select("event_id", B.script_hash(B.utf8(F.col("props"))).alias("script_hash"))


_CONTENTS = """contents AS (
  SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'image/png' WHEN event_id % 2 = 0 THEN 'application/json' END AS content_type,
    CASE event_id % 12
      WHEN 0 THEN props WHEN 1 THEN head || '"eth_main":"' || addr || '","prev":[]}'
      WHEN 2 THEN head || '"eth_main":"' || addr || '","eth_collab":"' || addr || '","prev":["' || pass || 'i' || event_id || '"]}'
      WHEN 3 THEN head || '"prev":[]}' WHEN 4 THEN head || '"eth_main":"0x12","prev":[]}'
      WHEN 5 THEN head || '"eth_main":"' || addr || '","eth_collab":"nobody","prev":[]}'
      WHEN 6 THEN head || '"eth_main":"' || addr || '","prev":["nothing"]}'
      WHEN 7 THEN head || '"eth_main":"' || addr || '","prev":["' || pass || 'i4294967296"]}'
      WHEN 8 THEN head || '"eth_main":"' || addr || '","prev":[1]}'
      WHEN 9 THEN replace(head, 'usdb', 'USDB') || '"eth_main":"' || addr || '","prev":[]}'
      WHEN 10 THEN head || 'not closed' ELSE head || '"eth_main":"' || addr || '","eth_collab":7,"prev":[]}' END AS content
  FROM (SELECT event_id, props, '{"p":"usdb","op":"mint",' AS head, '0x' || substr(sha256(event_id::VARCHAR), 1, 40) AS addr, sha256('p' || event_id) AS pass FROM events)
)"""


def _contents(s, d):
    """Contents of every kind, one for each event: no mint, valid, and invalid by each code."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    number = F.col("event_id").cast("string")
    head, addr, name = F.lit('{"p":"usdb","op":"mint",'), F.concat(F.lit("0x"), F.substring(F.sha2(number, 256), 1, 40)), F.sha2(F.concat(F.lit("p"), number), 256)
    main = text(head, '"eth_main":"', addr, '"')
    kinds = [
        F.col("props"), text(main, ',"prev":[]}'), text(main, ',"eth_collab":"', addr, '","prev":["', name, "i", number, '"]}'), text(head, '"prev":[]}'), text(head, '"eth_main":"0x12","prev":[]}'),
        text(main, ',"eth_collab":"nobody","prev":[]}'), text(main, ',"prev":["nothing"]}'), text(main, ',"prev":["', name, 'i4294967296"]}'), text(main, ',"prev":[1]}'),
        text(F.replace(head, F.lit("usdb"), F.lit("USDB")), '"eth_main":"', addr, '","prev":[]}'), text(head, "not closed"), text(main, ',"eth_collab":7,"prev":[]}'),
    ]
    content = F.get(F.array(*kinds), (F.col("event_id") % 12).cast("int"))
    kind = F.when(F.col("event_id") % 13 == 0, "image/png").when(F.col("event_id") % 2 == 0, "application/json")
    return T.table(s, d, "events").select("event_id", kind.alias("content_type"), content.alias("content"))


@query("mint_classify", f"""WITH {_CONTENTS}, j AS (
  SELECT event_id, CASE WHEN json_valid(content) AND (content_type IS NULL OR lower(content_type) IN ('text/plain;charset=utf-8', 'text/plain' || chr(39), 'application/json')) THEN content::JSON END AS c FROM contents
), m AS (
  SELECT event_id, c, coalesce(json_type(c) = 'OBJECT' AND json_type(c, '$.p') = 'VARCHAR' AND c->>'$.p' = 'usdb' AND json_type(c, '$.op') = 'VARCHAR' AND c->>'$.op' = 'mint', false) AS mint FROM j
), k AS (
  SELECT event_id, mint, CASE
    WHEN NOT mint THEN NULL
    WHEN coalesce(json_type(c, '$.eth_main'), '') <> 'VARCHAR' OR coalesce(json_type(c, '$.eth_collab'), 'NULL') NOT IN ('VARCHAR', 'NULL') OR coalesce(json_type(c, '$.prev'), '') <> 'ARRAY' OR len(list_filter(json_extract(c, '$.prev[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'INVALID_SCHEMA'
    WHEN NOT regexp_full_match(c->>'$.eth_main', '0x[0-9a-fA-F]{{40}}') THEN 'INVALID_ETH_MAIN'
    WHEN json_type(c, '$.eth_collab') = 'VARCHAR' AND NOT regexp_full_match(c->>'$.eth_collab', '0x[0-9a-fA-F]{{40}}') THEN 'INVALID_ETH_COLLAB'
    WHEN len(list_filter(json_extract_string(c, '$.prev[*]'), lambda x: NOT regexp_full_match(x, '[0-9a-fA-F]{{64}}i(0|[1-9][0-9]*)') OR coalesce(try_cast(split_part(x, 'i', 2) AS HUGEINT) > 4294967295, true))) > 0 THEN 'INVALID_PREV_ID' END AS code
  FROM m
) SELECT event_id, CASE WHEN NOT mint THEN 'not_mint' WHEN code IS NULL THEN 'valid' ELSE 'invalid' END AS kind, code FROM k""")  # X8-X12, F12
def _(s, d):
    return _contents(s, d).select("event_id", mint.classify(F.col("content"), F.col("content_type")).alias("m")).select("event_id", "m.kind", "m.code")


def _reversed(h: str) -> str:
    return f"array_to_string([substr({h}, CAST(2 * k - 1 AS INT), 2) for k in range(32, 0, -1)], '')"


def _prefixed(x: str) -> str:
    return f"(printf('%08x', strlen({x})::INT) || hex({x}))"


_HEX64 = "lpad(hex({}::BIGINT), 16, '0')"


@query("delta_root_chain", f"""WITH RECURSIVE {T.SQL_LEDGER}, entries AS (
  SELECT height, string_agg(h || printf('%08x', height) || {_HEX64.format("delta")} || {_HEX64.format("balance")}, '' ORDER BY h) AS e FROM (SELECT *, sha256(account::VARCHAR) AS h FROM ledger) GROUP BY height
), roots AS (
  SELECT height, sha256(height::VARCHAR) AS block_hash, e FROM entries
), b AS (
  SELECT height, block_hash, {_reversed("block_hash")} AS shown, sha256(unhex('{commit.ROOT_TAG.encode().hex()}' || printf('%08x', height) || {_reversed("block_hash")} || e)) AS root, row_number() OVER (ORDER BY height) AS n FROM roots
), c AS (
  SELECT n, height, block_hash, root, sha256(unhex('{commit.COMMIT_TAG.encode().hex()}' || printf('%08x', height) || shown || root || repeat('0', 64))) AS block_commit FROM b WHERE n = 1
  UNION ALL
  SELECT b.n, b.height, b.block_hash, b.root, sha256(unhex('{commit.COMMIT_TAG.encode().hex()}' || printf('%08x', b.height) || b.shown || b.root || c.block_commit)) FROM c JOIN b ON b.n = c.n + 1
) SELECT height, block_hash, root AS balance_delta_root, block_commit FROM c""")  # A13, W8, H1, H2
def _(s, d):
    rows = _ledger(s, d).select(F.sha2(F.col("account").cast("string"), 256).alias("script_hash"), "height", "delta", "balance")
    blocks = rows.select("height").distinct().withColumn("block_hash", F.sha2(F.col("height").cast("string"), 256))
    return commit.block_commits(commit.delta_roots(blocks, rows))


_ONE, _ZERO32 = _prefixed("'1'"), "00000000"


@query("state_ids", f"""WITH r AS (SELECT event_id AS height, sha256(props) AS hash FROM events), one AS (
  SELECT height, sha256(unhex({_prefixed("'v1'")} || {_prefixed("'btc'")} || {_prefixed("'regtest'")} || printf('%08x', height) || {_prefixed("hash")} || '{_ZERO32}' || {_ONE} || {_ONE} || {_ONE} || {_ONE})) AS snapshot_id FROM r
), two AS (
  SELECT height, snapshot_id, sha256(unhex({_prefixed("'v1'")} || {_prefixed("snapshot_id")} || printf('%08x', height) || '00' || '01' || printf('%08x', height) || printf('%016x', 5) || printf('%08x', 1) || {_ONE})) AS local_state_commit FROM one
) SELECT *, sha256(unhex({_prefixed("'v1'")} || {_prefixed("snapshot_id")} || {_prefixed("local_state_commit")})) AS system_state_id FROM two""")  # H5, H6, H7
def _(s, d):
    rows = T.table(s, d, "events").select(F.col("event_id").alias("height"), F.sha2(F.col("props"), 256).alias("hash"))
    lit = F.lit
    c = {"source_chain": lit("btc"), "network": lit("regtest"), "stable_height": F.col("height"), "stable_block_hash": F.col("hash"), "stable_lag": lit(0), "api_version": lit("1"), "semantics_version": lit("1"), "index_formula_version": lit("1"), "index_protocol_version": lit("1")}
    one = rows.withColumn("snapshot_id", commit.snapshot_id("v1", c))
    nothing = lit(None)
    parts = {"snapshot_id": F.col("snapshot_id"), "height": F.col("height"), "protocol_version": lit("1"), "pass_commit": nothing.cast("struct<block_height:bigint,block_commit:string,commit_protocol_version:string,commit_hash_algo:string>"), "balance_snapshot": F.struct(F.col("height").alias("block_height"), F.lit(5).alias("total_balance"), F.lit(1).alias("active_address_count"))}
    two = one.withColumn("local_state_commit", commit.local_state_commit("v1", parts))
    return two.select("height", "snapshot_id", "local_state_commit", commit.system_state_id("v1", F.col("snapshot_id"), F.col("local_state_commit")).alias("system_state_id"))


@query("level_from_energy", f"{_ENERGY}{_ENERGY_AT}, t(level, least) AS (VALUES {', '.join(f'({a}, {b}::HUGEINT)' for a, b in derived.level_table())}) SELECT key, max(level)::INT AS level, (10000 - least(max(level) * 100, 5000))::INT AS factor FROM projected JOIN t ON projected // 100000 >= t.least GROUP BY key", "ledger")  # D5
def _(s, d):
    thresholds = s.createDataFrame(derived.level_table(), "level int, least bigint")
    rows = _projected(s, d).select("key", (F.col("projected") / 100_000).cast("bigint").alias("projected"))
    return derived.levels(rows, "projected", thresholds).select("key", "level", derived.difficulty_factor(F.col("level")).alias("factor"))


@query("k_window", ", r AS (SELECT height, sum(delta) FILTER (WHERE delta > 0)::BIGINT AS v FROM ledger GROUP BY height) SELECT height, coalesce(sum(coalesce(v, 0)) OVER (ORDER BY height ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS previous FROM r", "ledger")  # W10
def _(s, d):
    rows = _ledger(s, d).groupBy("height").agg(F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("delta"))), F.lit(0)).cast("bigint").alias("v"))
    return derived.rolling_before(rows, "v", 50).select("height", F.col("previous").cast("bigint").alias("previous"))


@query("k_coefficient", ", r AS (SELECT height, coalesce(sum(delta) FILTER (WHERE delta > 0), 0)::BIGINT AS v FROM ledger GROUP BY height), w AS (SELECT height, v, coalesce(sum(v) OVER o, 0)::HUGEINT AS s, count(*) OVER o AS n FROM r WINDOW o AS (ORDER BY height ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)), a AS (SELECT height, v::HUGEINT AS ce, CASE WHEN n = 0 THEN 0::HUGEINT ELSE s // n END AS ae FROM w) SELECT height, CASE WHEN ae = 0 THEN 10000 WHEN ce < ae THEN greatest(8001, 20000 - (60000 * ae + ce + 5 * ae - 1) // (ce + 5 * ae)) ELSE least(20000, 10000 * ce // ae) END::INT AS k FROM a", "ledger")  # D9
def _(s, d):
    rows = _ledger(s, d).groupBy("height").agg(F.coalesce(F.sum(F.when(F.col("delta") > 0, F.col("delta"))), F.lit(0)).cast("bigint").alias("v"))
    found = derived.rolling_before(rows, "v", 50)
    average = F.when(F.col("samples") == 0, 0).otherwise(F.floor(F.col("previous") / F.greatest("samples", F.lit(1))))
    return found.select("height", derived.efficiency(F.col("v"), average).alias("k"))


@query("page_totals", f""", {T.sql_snapshot(EVENT_H)} SELECT 'active' AS page, count(*) AS n FROM snap WHERE new_state = 'active' UNION ALL SELECT 'owner', count(*) FROM snap WHERE new_owner = 'o14' UNION ALL SELECT 'recent', count(*) FROM snap
UNION ALL SELECT 'invalid', count(*) FROM ({T.sql_snapshot(10**9).removeprefix("snap AS (").removesuffix(")")}) JOIN passes USING (inscription_id) WHERE new_state = 'invalid' AND mint_block_height BETWEEN 0 AND 500
UNION ALL SELECT 'history', count(*) FROM history WHERE inscription_id = '17' AND block_height BETWEEN 10 AND {EVENT_H}""", "history")  # A8
def _(s, d):
    asked = service.PassService(T.history(s, d), T.passes(s, d))
    pages = {"active": asked.active_total(EVENT_H), "owner": asked.of_owner_total("o14", EVENT_H), "recent": asked.recent_total(EVENT_H), "invalid": asked.invalid_total(0, 500), "history": asked.events_total("17", 10, EVENT_H)}
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("page"), "n") for name, rows in pages.items()])


@query("energy_page_total", f"{_ENERGY} SELECT count(*) AS n FROM energy WHERE key = {ACCOUNT} AND height BETWEEN {START} AND {END}", "ledger")  # A8
def _(s, d):
    return service.PassService(T.history(s, d), T.passes(s, d), _energy(s, d, ACCOUNT), synced=10**9).energy_range_total(ACCOUNT, START, END)


@query("active_owners", f", {T.sql_snapshot(EVENT_H)} SELECT DISTINCT new_owner AS owner FROM snap WHERE new_state = 'active'", "history")  # T9
def _(s, d):
    return events.owners(events.snapshot(T.history(s, d), EVENT_H))


# --- blocks decoded to a ledger, and the life of passes


def _transactions(s, d):
    """Orders as transactions whose lines are outputs, a row each (height, tx_index, tx); one spends the second output of its customer's order before it.

    Scripts are made behind the shuffle of lines. They are staged, for inputs and outputs both read them, and not gathered in
    blocks, for a day grows with the table.
    """
    script = lambda o: F.when(o["l_linenumber"] == 1, F.unhex(F.lit("6a01ff"))).otherwise(F.concat(F.unhex(F.lit("0014")), F.unhex(F.substring(F.sha2(o["part"].cast("string"), 256), 1, 40))))
    lines = T.table(s, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("value"), (F.col("l_partkey") % 50).alias("part")).alias("o"))
    whole = F.transform(F.collect_list("o"), lambda o: F.struct(o["l_linenumber"].alias("l_linenumber"), o["value"].alias("value"), script(o).alias("script")))
    outs = lines.groupBy("l_orderkey").agg(F.transform(F.sort_array(whole), lambda o: F.struct(o["value"].alias("value"), o["script"].alias("script"))).alias("vout"))
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = T.table(s, d, "orders").select("o_orderkey", "o_orderdate", before.alias("_b")).join(outs, F.col("o_orderkey") == F.col("l_orderkey"))
    vin = F.array(F.struct(F.concat(F.lit("t"), F.col("_b").cast("string")).alias("txid"), F.when(F.col("_b").isNotNull(), F.lit(1)).cast("bigint").alias("vout")))
    tx = F.struct(F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("txid"), vin.alias("vin"), "vout")
    rows = staged(orders.select(T.day("o_orderdate").alias("height"), "o_orderkey", tx.alias("tx")), "transactions")
    return rows.select("height", (F.row_number().over(Window.partitionBy("height").orderBy("o_orderkey")) - 1).alias("tx_index"), "tx")


_DECODED = f"""WITH lines AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, value, script) - 1 AS vout, value, script
  FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS value, CASE WHEN l_linenumber = 1 THEN '6A01FF' ELSE '0014' || upper(substr(sha256((l_partkey % 50)::VARCHAR), 1, 40)) END AS script FROM lineitem)
), txs AS (
  SELECT o_orderkey, date_diff('day', DATE '{T.EPOCH}', CAST(o_orderdate AS DATE))::BIGINT AS height, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders
), outputs AS (
  SELECT o_orderkey, vout, height, value, script, {_reversed("sha256(unhex(script))")} AS account FROM lines JOIN txs ON l_orderkey = o_orderkey WHERE script NOT LIKE '6A%'
)"""


@query("decoded_ledger", f"""{_DECODED}, moved AS (
  SELECT account, height, value AS delta FROM outputs UNION ALL
  SELECT o.account, t.height, -o.value FROM txs t JOIN outputs o ON o.o_orderkey = t.prev AND o.vout = 1 WHERE t.o_orderkey IN (SELECT l_orderkey FROM lineitem)
), summed AS (SELECT account, height, sum(delta)::BIGINT AS delta FROM moved GROUP BY account, height)
SELECT account, height, delta, (sum(delta) OVER (PARTITION BY account ORDER BY height ROWS UNBOUNDED PRECEDING))::BIGINT AS balance FROM summed""")  # S3, F1, F2, J1, A1
def _(s, d):
    vin, vout = blockfiles.decoded_transactions(_transactions(s, d))
    outs = vout.select(F.col("txid").alias("prev_txid"), F.col("vout").alias("prev_vout"), "height", "value", F.col("script_pubkey").alias("account"))
    spends = ledger.resolved_inputs(vin.select("height", "prev_txid", "prev_vout"), outs, ["prev_txid", "prev_vout"]).where("account is not null")
    return blockfile_ledger.of_scripts(outs, spends)


@query("block_file_ledger", blockfile_ledger.sql(_reversed("sha256(unhex(script))")))  # S1, S2, S3, S4
def _(s, d):
    """Orders written as serialised blocks in files, and the ledger of those files."""
    return blockfile_ledger.block_file_ledger(s, d)


@query("pass_moves", f"""WITH RECURSIVE {_DECODED.removeprefix("WITH ").replace("outputs AS (", "spans AS (SELECT l_orderkey AS tx, vout, value, script, sum(value) OVER (PARTITION BY l_orderkey ORDER BY vout) - value AS low FROM lines), outputs AS (")},
moves AS (
  SELECT tx AS pass, 0 AS hop, NULL::BIGINT AS height, 'transfer' AS kind, NULL::VARCHAR AS new_owner, tx, vout, (value * (tx % 97) // 97)::BIGINT AS pos FROM spans WHERE vout = 1
  UNION ALL
  SELECT m.pass, m.hop + 1, t.height, CASE WHEN s.tx IS NULL THEN 'fee' WHEN s.script LIKE '6A%' THEN 'burn' ELSE 'transfer' END, CASE WHEN s.script NOT LIKE '6A%' THEN s.script END, t.o_orderkey, s.vout, (m.pos - s.low)::BIGINT
  FROM moves m JOIN txs t ON t.prev = m.tx AND m.vout = 1 AND m.kind = 'transfer' AND t.o_orderkey IN (SELECT l_orderkey FROM lineitem)
  LEFT JOIN spans s ON s.tx = t.o_orderkey AND m.pos >= s.low AND m.pos < s.low + s.value
)
SELECT 'i' || pass AS inscription_id, hop, height, kind, CASE WHEN new_owner IS NOT NULL THEN {_reversed("sha256(unhex(new_owner))")} END AS new_owner, 't' || tx AS txid, vout, pos AS "offset" FROM moves WHERE hop > 0""")  # J11, R9
def _(s, d):
    """Every second output holds a pass, somewhere in it."""
    tx = _transactions(s, d)
    outs = tx.select(F.col("tx.txid").alias("txid"), F.posexplode("tx.vout").alias("vout", "o")).select("txid", F.col("vout").cast("bigint"), "o.value", F.when(~F.hex("o.script").startswith("6A"), B.script_hash(F.col("o.script"))).alias("owner"))
    outs = staged(outs, "outputs")
    made = outs.select(F.col("txid").alias("prev_txid"), F.col("vout").alias("prev_vout"), F.col("owner").alias("account"), "value")
    vin = staged(ledger.resolved_inputs(blockfiles.decoded_transactions(tx)[0], made, ["prev_txid", "prev_vout"]).drop("account"), "inputs")
    key = F.substring("txid", 2, 20).cast("bigint")
    held = outs.where("vout = 1").select(F.concat(F.lit("i"), key.cast("string")).alias("inscription_id"), "owner", "txid", "vout", F.expr("value * (cast(substring(txid, 2, 20) as bigint) % 97) div 97").alias("offset"))
    return chain.tracked_moves(vin, outs, held).select("inscription_id", "hop", "height", "kind", "new_owner", "txid", "vout", "offset")


@query("script_registry", f"{_DECODED} SELECT account AS script_hash, lower(min(script)) AS script_pubkey, count(DISTINCT script) AS conflicts FROM outputs GROUP BY account")  # A2
def _(s, d):
    vout = blockfiles.decoded_transactions(_transactions(s, d))[1]
    return ledger.script_registry(vout.select(B.script_hash(F.col("script_pubkey")).alias("script_hash"), "script_pubkey")).withColumn("script_pubkey", F.lower(F.hex("script_pubkey")))


@query("pass_lifecycle", lifecycle.sql())  # R7, R8, A10
def _(s, d):
    return lifecycle.lifecycle(s, d)


@query("pass_lifecycle_strict", lifecycle.sql(strict=True))  # D12
def _(s, d):
    """A mint that doesn't get its predecessor is invalid, and burned passes keep no energy."""
    return lifecycle.lifecycle(s, d, strict=True)


# --- derived values of the specifications


def _cents(column: str):
    return F.greatest(F.round(F.col(column) * 100), F.lit(0)).cast("bigint")


def _customers(s, d):
    """Customers as passes: every seventh one collaborates, every eleventh is inactive."""
    return T.table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("owner"), _cents("c_acctbal").alias("energy"), (F.col("c_custkey") % 11 != 0).alias("active"))


def _collabs(s, d):
    """A collaborator names its leader by pass id or, every other one, by owner; some names are of nobody."""
    rows = T.table(s, d, "customer").where("c_custkey % 7 = 3")
    by_id = F.col("c_custkey") % 2 == 0
    return rows.select(F.col("c_custkey").alias("key"), F.when(by_id, F.col("c_custkey") * 5 % 200).alias("leader_pass"), F.when(~by_id, F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") * 3 % 200).cast("string"), 9, "0"))).alias("leader_owner"))


_CUSTOMERS = """WITH passes AS (
  SELECT c_custkey AS key, c_name AS owner, CAST(greatest(round(c_acctbal * 100), 0) AS BIGINT) AS energy, c_custkey % 11 <> 0 AS active FROM customer
), collabs AS (
  SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 5 % 200 END AS leader_pass,
         CASE WHEN c_custkey % 2 <> 0 THEN 'Customer#' || lpad(CAST(c_custkey * 3 % 200 AS VARCHAR), 9, '0') END AS leader_owner
  FROM customer WHERE c_custkey % 7 = 3
), led AS (
  SELECT c.key, coalesce(a.key, b.key) AS leader FROM collabs c LEFT JOIN passes a ON a.key = c.leader_pass LEFT JOIN passes b ON b.owner = c.leader_owner
)"""


@query("derived_raw_energy", f"""WITH RECURSIVE {T.SQL_LEDGER}, r AS (
  SELECT account AS key, height, (balance // 100000)::HUGEINT AS units, row_number() OVER (PARTITION BY account ORDER BY height) AS n FROM ledger
), f AS (
  SELECT key, n, height, units, 0::HUGEINT AS age, 0::HUGEINT AS energy FROM r WHERE n = 1
  UNION ALL
  SELECT r.key, r.n, r.height, r.units,
         CASE WHEN r.units < f.units THEN (f.age + r.height - f.height) * r.units // f.units ELSE f.age + r.height - f.height END,
         greatest(f.energy + f.units * (r.height - f.height) - greatest(f.units - r.units, 0) * (f.age + r.height - f.height) * 3 // 2, 0)
  FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1
)
SELECT key, height, units::BIGINT AS units, age::BIGINT AS age, energy::BIGINT AS energy FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1""")  # D1
def _(s, d):
    rows = _ledger(s, d).select(F.col("account").alias("key"), "height", "balance")
    return derived.raw_energy_v2(rows).select("key", "height", *(F.col(c).cast("bigint").alias(c) for c in ("units", "age", "energy")))


@query("derived_inherited", _CUSTOMERS + " SELECT key % 40 AS heir, sum(energy * 9500 // 10000)::BIGINT AS inherited FROM passes GROUP BY 1")  # D2
def _(s, d):
    rows = _customers(s, d).select((F.col("key") % 40).alias("heir"), "energy")
    return derived.inherited(rows).select("heir", F.col("inherited").cast("bigint").alias("inherited"))


@query("derived_leaders", _CUSTOMERS + " SELECT * FROM led")  # D3
def _(s, d):
    return derived.leaders(_collabs(s, d), _customers(s, d))


_EFFECTIVE = _CUSTOMERS + """, shares AS (
  SELECT leader, sum(energy * 5000 // 10000) AS c FROM led JOIN passes USING (key) WHERE active GROUP BY leader
), effective AS (
  SELECT p.key, p.energy AS raw, CASE WHEN l.key IS NOT NULL OR NOT p.active THEN 0 ELSE p.energy + coalesce(s.c, 0) END::BIGINT AS effective_energy
  FROM passes p LEFT JOIN shares s ON s.leader = p.key LEFT JOIN led l ON l.key = p.key
)"""


@query("derived_effective_energy", _EFFECTIVE + " SELECT key, effective_energy FROM effective")  # D4
def _(s, d):
    passes = _customers(s, d)
    return _effective(passes, derived.leaders(_collabs(s, d), passes))


def _effective(passes: DataFrame, led: DataFrame) -> DataFrame:
    return derived.effective_energy(passes.select("key", "energy", "active"), led).select("key", F.col("effective_energy").cast("bigint").alias("effective_energy"))


@query("derived_candidates", _EFFECTIVE + " SELECT key, effective_energy, row_number() OVER (ORDER BY effective_energy DESC, key)::INT AS place FROM effective WHERE effective_energy > 0 ORDER BY effective_energy DESC, key LIMIT 100")  # D7
def _(s, d):
    passes = _customers(s, d)
    first = _effective(passes, derived.leaders(_collabs(s, d), passes)).where("effective_energy > 0").orderBy(F.desc("effective_energy"), "key").limit(100)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("effective_energy"), "key")))  # a page of 100 rows


@query("candidate_next_page", _EFFECTIVE + f""", seen AS (
  SELECT *, row_number() OVER (ORDER BY effective_energy DESC, key) AS place FROM effective WHERE effective_energy > 0
), page AS (SELECT key FROM seen WHERE place BETWEEN 31 AND 60)
SELECT key, key AS collaborator, energy::BIGINT AS energy, energy::BIGINT AS share FROM passes JOIN page USING (key)
UNION ALL SELECT led.leader, led.key, energy::BIGINT, (energy * 5000 // 10000)::BIGINT FROM led JOIN passes USING (key) JOIN page ON page.key = led.leader WHERE active""")  # D7
def _(s, d):
    """What the energies of the second page of thirty are made of."""
    raw = _customers(s, d)
    led = derived.leaders(_collabs(s, d), raw)
    effective = _effective(raw, led)
    last = derived.candidate_page(effective, 30).orderBy("effective_energy", F.desc("key")).first()
    page = derived.candidate_page(effective, 30, last and (last["effective_energy"], last["key"]))
    return derived.collaborators(page, raw, led).select("key", "collaborator", *(F.col(c).cast("bigint").alias(c) for c in ("energy", "share")))


@query("derived_difficulty", "SELECT p_partkey AS key, CAST(ceil(CAST(p_retailprice * 100 AS BIGINT) * (10000 - least(p_size * 100, 5000))::BIGINT / 10000.0) AS BIGINT) AS difficulty FROM part")  # D5, D6
def _(s, d):
    base = F.round(F.col("p_retailprice") * 100).cast("bigint")
    return T.table(s, d, "part").select(F.col("p_partkey").alias("key"), derived.real_difficulty(base, derived.difficulty_factor(F.col("p_size"))).cast("bigint").alias("difficulty"))


@query("derived_emission", """WITH r AS (
  SELECT o_orderkey AS key, CAST(round(o_totalprice * 100) AS HUGEINT) AS sats, (o_custkey % 90 + 10)::HUGEINT * 1000000 AS price, (o_orderkey % 5000)::HUGEINT AS issued, (o_custkey % 5000 + 5000)::HUGEINT AS k FROM orders
), t AS (SELECT *, greatest(sats * price // 100000000 - issued, 0) AS remaining FROM r
), e AS (SELECT key, least(remaining, remaining * k // (100 * 10000)) AS emission FROM t)
SELECT key, emission::BIGINT AS emission, (emission * 300 // 10000)::BIGINT AS fee, (emission - emission * 300 // 10000)::BIGINT AS rest FROM e""")  # D8
def _(s, d):
    o = T.table(s, d, "orders")
    made = derived.emission(_cents("o_totalprice"), (F.col("o_custkey") % 90 + 10) * 1_000_000, F.col("o_orderkey") % 5000, F.col("o_custkey") % 5000 + 5000, 100)
    parts = o.select(F.col("o_orderkey").alias("key"), made.alias("e")).withColumn("p", derived.split(F.col("e"), F.lit(300)))
    return parts.select("key", F.col("e").cast("bigint").alias("emission"), F.col("p.share").cast("bigint").alias("fee"), F.col("p.rest").cast("bigint").alias("rest"))


@query("derived_price_at", ", h AS (SELECT DISTINCT height FROM ledger), p AS (SELECT unnest(generate_series(0, 40)) * 60 + 100 AS start) SELECT h.height, max(p.start * 7 + 1)::BIGINT AS price FROM h LEFT JOIN p ON p.start <= h.height GROUP BY h.height", "ledger")  # D10
def _(s, d):
    policy = s.range(41).select((F.col("id") * 60 + 100).alias("start"), ((F.col("id") * 60 + 100) * 7 + 1).alias("price"))
    return derived.price_at(_ledger(s, d).select("height").distinct(), policy)


@query("derived_candidate_energy", "SELECT event_id AS id, CASE WHEN 60000 - CASE WHEN user_id % 4 <> 0 THEN event_id * 13 % 60000 END <= 50400 THEN user_id * 3 ELSE user_id END AS candidate FROM events")  # D11
def _(s, d):
    quote = F.when(F.col("user_id") % 4 != 0, F.col("event_id") * 13 % 60000)
    return T.table(s, d, "events").select(F.col("event_id").alias("id"), derived.candidate_energy(F.lit(60000), quote, F.col("user_id") * 3, F.col("user_id")).alias("candidate"))


# --- undo, minting and address texts


@query("upstream_drift", """, ours AS (SELECT r.height, 'h' || r.height AS block_hash, coalesce(sum(value), 0)::BIGINT::VARCHAR AS commit FROM (SELECT unnest(range(0, (SELECT max(height) + 1 FROM outs))) AS height) r LEFT JOIN outs USING (height) GROUP BY r.height),
theirs AS (SELECT height, CASE WHEN height % 400 = 399 THEN 'other' ELSE block_hash END AS block_hash, CASE WHEN height >= 1200 THEN commit || 'x' ELSE commit END AS commit FROM ours WHERE height <= (SELECT max(height) - 3 FROM ours)),
shared AS (SELECT max(height) AS last FROM ours JOIN theirs USING (height, block_hash, commit)),
tips AS (SELECT (SELECT max(height) FROM ours) AS tip, (SELECT max(height) FROM theirs) AS upstream_tip)
SELECT tip, upstream_tip, 'height_regressed,commit_missing' AS reasons, CASE WHEN (SELECT count(*) FROM ours WHERE height > last AND height <= upstream_tip) = upstream_tip - last THEN last ELSE -1 END::BIGINT AS rollback_to FROM tips, shared""", "ledger")  # R10
def _(s, d):
    """Against a source that ends three heights before and has other commits from height 1200 on."""
    outs = T.outputs(s, d)
    heights = outs.agg(F.max("height").alias("_m")).select(F.explode(F.sequence(F.lit(0).cast("bigint"), "_m")).alias("height"))
    sums = outs.groupBy("height").agg(F.sum("value").cast("bigint").alias("_v"))
    ours = heights.join(sums, "height", "left").select("height", F.concat(F.lit("h"), F.col("height").cast("string")).alias("block_hash"), F.coalesce("_v", F.lit(0)).cast("string").alias("commit"))
    hashed = F.when(F.col("height") % 400 == 399, "other").otherwise(F.col("block_hash")).alias("block_hash")
    committed = F.when(F.col("height") >= 1200, F.concat("commit", F.lit("x"))).otherwise(F.col("commit")).alias("commit")
    end = F.broadcast(ours.agg((F.max("height") - 3).alias("_end")))  # one row
    theirs = ours.join(end).where("height <= _end").select("height", hashed, committed)
    return chain.upstream_drift(ours, theirs, 0).withColumn("reasons", F.array_join("reasons", ","))


@query("envelope_inscriptions", f"""SELECT 't' || o_orderkey || 'i' || k AS inscription_id, k::INT AS inscription_number, 'text/plain' AS content_type, o_orderpriority || ' ' || k AS content_string
FROM orders, (SELECT unnest([0, 1]) AS k) WHERE o_orderkey % 3 > 0 AND k <= o_orderkey % 2""")  # S10
def _(s, d):
    """Every third order has a witness without an envelope, every second one of the others two envelopes."""
    hexed = lambda text: F.unhex(F.lit(text))

    def envelope(k):
        body = F.concat(F.col("o_orderpriority"), F.lit(f" {k}")).cast("binary")
        return F.concat(F.lit(envelopes.OPENING), hexed("01010A"), F.lit(b"text/plain"), hexed("00"), F.unhex(F.lpad(F.hex(F.length(body)), 2, "0")), body, hexed("68"))

    key = F.col("o_orderkey")
    script = F.when(key % 3 == 0, hexed("51AC")).when(key % 2 == 1, F.concat(envelope(0), envelope(1))).otherwise(envelope(0))
    witness = F.array(hexed("AA"), script, hexed("C0"))
    inputs = T.table(s, d, "orders").select(T.day("o_orderdate").alias("height"), F.lit(0).alias("tx_index"), F.concat(F.lit("t"), key.cast("string")).alias("txid"), F.lit(0).alias("input_index"), witness.alias("witness"))
    return envelopes.read_envelopes(inputs).drop("height", "tx_index")


@query("undo_bundle", f""", rows AS (
  SELECT height, account, outpoint AS created, NULL::BIGINT AS spent FROM outs WHERE height BETWEEN {H - 20} AND {H}
  UNION ALL SELECT height, account, NULL, outpoint FROM spends WHERE height BETWEEN {H - 20} AND {H}
)
SELECT height, coalesce(string_agg(created::VARCHAR, ',' ORDER BY created), '') AS created, coalesce(string_agg(spent::VARCHAR, ',' ORDER BY spent), '') AS spent,
       array_to_string(list_sort(list(DISTINCT account)), ',') AS touched FROM rows GROUP BY height""", "ledger")  # Z6, R4
def _(s, d):
    found = ledger.undo_bundle(T.outputs(s, d), T.spends(s, d), H - 20, H)
    return found.select("height", *(F.array_join(c, ",").alias(c) for c in ("created", "spent", "touched")))


@query("passes_minted_by", f""", {T.sql_snapshot(10**9)}
SELECT inscription_id, new_owner, mint_block_height FROM snap JOIN passes USING (inscription_id) WHERE new_state = 'active' AND mint_block_height <= {EVENT_H}
ORDER BY mint_block_height, inscription_number LIMIT 50""", "history")  # Z15
def _(s, d):
    history = T.history(s, d)
    rows = events.with_attributes(events.in_states(events.snapshot(history, 10**9), ["active"]), T.passes(s, d)).where(F.col("mint_block_height") <= EVENT_H)
    return temporal.offset_page(rows, ["mint_block_height", "inscription_number"], 0, 50).select("inscription_id", "new_owner", "mint_block_height")


@query("prev_resolution", f""", {T.sql_snapshot(EVENT_H)}, mints AS (
  SELECT inscription_id, new_owner AS owner, inscription_id::BIGINT AS u FROM snap
), named AS (
  SELECT inscription_id, owner, k, [(u * 3 % 700)::VARCHAR, ((u + 211) % 900)::VARCHAR, (u * 3 % 700)::VARCHAR, u::VARCHAR][k] AS prev_id FROM mints, (SELECT unnest([1, 2, 3, 4]) AS k)
), firsts AS (
  SELECT inscription_id, owner, prev_id, row_number() OVER (PARTITION BY inscription_id ORDER BY min(k)) - 1 AS position FROM named GROUP BY inscription_id, owner, prev_id
)
SELECT f.inscription_id, position::INT AS position, prev_id, CASE WHEN s.new_state IS NULL THEN 'missing' WHEN s.new_owner <> f.owner THEN 'other_owner' WHEN s.new_state <> 'dormant' THEN 'not_dormant' ELSE 'inherited' END AS outcome
FROM firsts f LEFT JOIN snap s ON s.inscription_id = prev_id""", "history")  # J14, U5
def _(s, d):
    found = events.snapshot(T.history(s, d), EVENT_H)
    u = F.col("inscription_id").cast("bigint")
    prev = F.array(*((c.cast("string")) for c in (u * 3 % 700, (u + 211) % 900, u * 3 % 700, u)))
    return events.prev_resolution(found.select("inscription_id", F.col("new_owner").alias("owner"), prev.alias("prev")), found)


@query("script_addresses")  # X2, X3, X4: no SQL form of the checksums
def _(s, d):
    program = F.unhex(F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 40))
    script = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.unhex(F.lit("0014")), program)).otherwise(F.concat(F.unhex(F.lit("76a914")), program, F.unhex(F.lit("88ac"))))
    rows = T.table(s, d, "customer").select("c_custkey", script.alias("script")).withColumn("address", address.script_address(F.col("script")))
    return rows.select("c_custkey", B.script_kind(F.col("script")).alias("kind"), "address", (address.account(F.col("address")) == B.script_hash(F.col("script"))).alias("round_trip"))
