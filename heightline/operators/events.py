"""Queries over an append-only event log of passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heightline.schema import STATES


def snapshot(history: DataFrame, height: int) -> DataFrame:
    """The latest event of each pass at or before a height, by the log's total order."""
    columns = [c for c in history.columns if c != "inscription_id"]
    return history.where(F.col("block_height") <= height).groupBy("inscription_id").agg(F.max_by(F.struct(*columns), "id").alias("r")).select("inscription_id", "r.*")


def state_counts(history: DataFrame, height: int) -> DataFrame:
    found = snapshot(history, height)
    return found.agg(F.count("*").alias("total"), *(F.count_if(F.col("new_state") == s).alias(s) for s in STATES))


def in_states(found: DataFrame, states: list[str], empty_is_all: bool = False) -> DataFrame:
    if not states:
        return found if empty_is_all else found.limit(0)
    return found.where(F.col("new_state").isin(states))


def total(rows: DataFrame) -> DataFrame:
    """What a page's rows are cut from."""
    return rows.agg(F.count("*").alias("n"))


def owners(found: DataFrame, state: str = "active") -> DataFrame:
    """Owners of the passes in a state, each once, in order."""
    return found.where(F.col("new_state") == state).select(F.col("new_owner").alias("owner")).distinct().orderBy("owner")


def by_latest_event(descending: bool = True) -> list:
    return [F.desc("block_height"), F.desc("id")] if descending else [F.asc("block_height"), F.asc("id")]


def by_mint(descending: bool = True) -> list:
    return [(F.desc if descending else F.asc)(c) for c in ("mint_block_height", "inscription_number", "id")]


def with_attributes(found: DataFrame, passes: DataFrame) -> DataFrame:
    return found.join(passes, "inscription_id")


def history_range(history: DataFrame, inscription: str, first: int, last: int) -> DataFrame:
    """Inclusive on both sides."""
    return history.where((F.col("inscription_id") == inscription) & F.col("block_height").between(first, last))


def duplicate_owners(found: DataFrame) -> DataFrame:
    active = found.where("new_state = 'active'")
    return active.groupBy("new_owner").agg(F.count("*").alias("n")).where("n > 1")


def last_active_pass(found: DataFrame) -> DataFrame:
    """Of each owner the active pass with the latest event."""
    order = Window.partitionBy("new_owner").orderBy(F.desc("block_height"), F.desc("id"))
    return found.where("new_state = 'active'").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def canonical_order(events: DataFrame) -> DataFrame:
    """Numbers the events of each block: transaction, transfers before mints, input, index, id."""
    order = Window.partitionBy("height").orderBy("tx_position", "priority", "input_index", "inscription_index", "inscription_id")
    return events.withColumn("event_order", F.row_number().over(order))


def ambiguous_reveals(mints: DataFrame) -> DataFrame:
    """Mints of a block that share a commit outpoint, all of them."""
    groups = mints.groupBy("height", "commit_outpoint").agg(F.count("*").alias("n")).where("n > 1")
    return mints.join(groups, ["height", "commit_outpoint"])


def settlement(active: DataFrame, balances: DataFrame, height: int) -> DataFrame:
    """Total balance (saturating) and number of active owners. balances: account, height, delta, balance as of the height."""
    joined = active.join(balances, active["owner"] == balances["account"], "left")
    total = F.least(F.sum(F.col("balance").cast("decimal(38,0)")), F.lit("18446744073709551615").cast("decimal(38,0)"))
    return joined.agg(F.lit(height).cast("bigint").alias("block_height"), F.coalesce(total, F.lit(0).cast("decimal(38,0)")).alias("total_balance"), F.count("account").alias("active_address_count"))


def settlement_faults(active: DataFrame, balances: DataFrame, height: int) -> DataFrame:
    """Owners that are missing, repeated, not asked for, or whose row lies in the future."""
    asked = active.groupBy("owner").agg(F.count("*").alias("asked"))
    got = balances.groupBy(F.col("account").alias("owner")).agg(F.count("*").alias("got"), F.max("height").alias("last"))
    kind = F.when(F.col("got").isNull(), "missing").when(F.col("asked").isNull(), "extra").when(F.col("asked") > 1, "duplicate_owner").when(F.col("got") > 1, "duplicate_row").when(F.col("last") > height, "future")
    return asked.join(got, "owner", "full_outer").select("owner", kind.alias("fault")).where("fault is not null")


def settled_deltas(balances: DataFrame, height: int) -> DataFrame:
    """A row older than the height moved nothing in its block."""
    return balances.withColumn("delta", F.when(F.col("height") < height, F.lit(0)).otherwise(F.col("delta")))


def future_rows(tables: dict[str, DataFrame], height: int) -> DataFrame:
    """Number of rows beyond a height in each table; none has any in a sound store."""
    parts = [t.where(F.col("block_height") > height).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prev_resolution(mints: DataFrame, found: DataFrame) -> DataFrame:
    """Each id that a mint names in prev, the first time it does, and why it isn't inherited from, if it isn't.

    mints: inscription_id, owner, prev; found: a snapshot of all passes. Skipped ids don't fail the mint.
    """
    named = mints.select("inscription_id", "owner", F.posexplode(F.array_distinct("prev")).alias("position", "prev_id"))
    known = found.select(F.col("inscription_id").alias("prev_id"), "new_owner", "new_state")
    why = F.when(F.col("new_state").isNull(), "missing").when(F.col("new_owner") != F.col("owner"), "other_owner").when(F.col("new_state") != "dormant", "not_dormant").otherwise("inherited")
    return named.join(known, "prev_id", "left").select("inscription_id", "position", "prev_id", why.alias("outcome"))


def state_code(state: Column) -> Column:
    """The number of a state's name, whatever its case; null for names that are none."""
    place = F.array_position(F.array(*map(F.lit, STATES)), F.lower(state))
    return F.when(place > 0, place - 1).cast("int")


def state_name(code: Column) -> Column:
    """The name of a state's number, null beyond the last."""
    return F.get(F.array(*map(F.lit, STATES)), code)


def prev_text(prev: Column) -> Column:
    """The predecessors of a mint as one text; none, like null, is empty."""
    return F.coalesce(F.array_join(prev, ","), F.lit(""))


def prev_list(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def compare_and_set(current: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """What becomes of each update (key, expected, value; one a key): the value that stands after it and its outcome.

    An update applies where the column holds what it expects, null included; else it is stale, or its key is missing.
    """
    held = current.select(key, F.col(column).alias("_v"), F.lit(True).alias("_known"))
    outcome = F.when(F.col("_known").isNull(), "missing").when(F.col("_v").eqNullSafe(F.col("expected")), "applied").otherwise("stale")
    found = updates.join(held, key, "left").withColumn("outcome", outcome)
    return found.select(key, F.when(F.col("outcome") == "applied", F.col("value")).otherwise(F.col("_v")).alias(column), "outcome")
