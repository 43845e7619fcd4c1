"""Faults that must stop a job: checks that ride on a plan and raise with the names of the first row that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(rows: DataFrame, bad: Column, code: str, *names: str) -> DataFrame:
    """rows as they are; reading them raises `code` and the named columns at a row where bad holds. No second scan."""
    said = F.concat_ws(" ", F.lit(code), *(F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("null"))) for n in names))
    return rows.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(said).cast("boolean")).otherwise(True))


def event_positions(events: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """events with the place of their transaction and input in the block; an event without one raises. positions: keys, tx_position, input_index."""
    found = events.join(positions.select(*keys, "tx_position", "input_index", F.lit(True).alias("_there")), keys, "left")
    return sound(found, F.col("_there").isNull(), "EVENT_WITHOUT_POSITION", *keys).drop("_there")


def resolved_inputs(inputs: DataFrame, outputs: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs with the account and value of what they spend, from outputs or else from fallback, with the source; neither raises."""
    a = outputs.select(*keys, F.struct("account", "value").alias("_a"))
    b = fallback.select(*keys, F.struct("account", "value").alias("_b"))
    found = inputs.join(a, keys, "left").join(b, keys, "left")
    found = sound(found, F.col("_a").isNull() & F.col("_b").isNull(), "OUTPUT_NOT_FOUND", *keys)
    got = F.coalesce("_a", "_b")
    return found.withColumns({"account": got["account"], "value": got["value"], "source": F.when(F.col("_a").isNotNull(), "first").otherwise("second")}).drop("_a", "_b")


def cross_checked(leaderboard: DataFrame, records: DataFrame, active: DataFrame, snapshot: DataFrame) -> DataFrame:
    """leaderboard (key, energy) as it is, if every row has the energy of records (key, energy), and if the snapshot's total_balance and
    active_address_count are what the active rows (owner, balance) add up to; anything else raises."""
    known = records.select("key", F.col("energy").alias("_energy"))
    agreed = sound(leaderboard.join(known, "key", "left"), ~F.col("energy").eqNullSafe(F.col("_energy")), "LEADERBOARD_ENERGY", "key", "energy", "_energy").drop("_energy")
    sums = active.agg(F.count("*").alias("_count"), F.coalesce(F.sum(F.col("balance").cast("decimal(38,0)")), F.lit(0)).alias("_sum"))
    told = snapshot.agg(F.max("total_balance").cast("decimal(38,0)").alias("_total"), F.max("active_address_count").alias("_owners"))
    both = sums.join(told)  # one row each
    apart = ~(F.col("_count").eqNullSafe(F.col("_owners")) & F.col("_sum").eqNullSafe(F.col("_total")))
    checked = sound(both, apart, "SNAPSHOT_DIFFERS", "_count", "_owners", "_sum", "_total")
    return agreed.join(F.broadcast(checked)).drop("_count", "_owners", "_sum", "_total")  # one row
