"""Balance ledger: signed deltas, running balances, live outputs, script registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolved_inputs(inputs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Each input with the owner and value of the output it spends; unknown outputs keep nulls."""
    return inputs.join(outputs.select(*keys, "account", "value"), keys, "left")


def signed_rows(outputs: DataFrame, spends: DataFrame) -> DataFrame:
    """account, height, delta: outputs in, spends out."""
    return outputs.select("account", "height", F.col("value").alias("delta")).unionByName(spends.select("account", "height", (-F.col("value")).alias("delta")))


def deltas(signed: DataFrame) -> DataFrame:
    """One row for each account and height with movement, also where it nets to zero."""
    return signed.groupBy("account", "height").agg(F.sum("delta").cast("bigint").alias("delta"))


#: Heights in one piece of an account's history when balances are summed.
PIECE = 1024


def running_balance(delta: DataFrame, opening: DataFrame | None = None, piece: int = PIECE) -> DataFrame:
    """Adds the balance after each delta. opening: account and balance before the first row.

    Histories are summed in pieces of heights and the pieces' totals carried over, so that an account
    with a large share of all rows is the work of many tasks.
    """
    cut = delta.withColumn("_piece", F.floor(F.col("height") / piece))
    inside = Window.partitionBy("account", "_piece").orderBy("height").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("account").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("account", "_piece").agg(F.sum("delta").alias("_t")).select("account", "_piece", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    out = cut.withColumn("_sum", F.sum("delta").over(inside)).join(totals, ["account", "_piece"]).select("account", "height", "delta", (F.col("_before") + F.col("_sum")).cast("bigint").alias("balance"))
    if opening is None:
        return out
    start = opening.select("account", F.col("balance").alias("_opening"))
    return out.join(start, "account", "left").withColumn("balance", F.col("balance") + F.coalesce("_opening", F.lit(0))).drop("_opening")


def negative_balances(ledger: DataFrame) -> DataFrame:
    """Rows that a sound ledger doesn't have."""
    return ledger.where("balance < 0")


def double_spends(spends: DataFrame, keys: list[str]) -> DataFrame:
    return spends.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def live_outputs(outputs: DataFrame, spends: DataFrame, keys: list[str]) -> DataFrame:
    return outputs.join(spends.select(*keys), keys, "left_anti")


def created_and_removed(outputs: DataFrame, spends: DataFrame, keys: list[str], first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """Output changes of a batch of heights: one created and spent inside the batch appears in neither."""
    made = outputs.where(F.col("height").between(first, last))
    used = spends.where(F.col("height").between(first, last))
    return made.join(used.select(*keys), keys, "left_anti"), used.join(made.select(*keys), keys, "left_anti")


def touched_accounts(outputs: DataFrame, spends: DataFrame, first: int, last: int) -> DataFrame:
    inside = F.col("height").between(first, last)
    return outputs.where(inside).select("account").union(spends.where(inside).select("account")).distinct()


def script_registry(scripts: DataFrame) -> DataFrame:
    """One row a script hash; conflicts counts different scripts under it and must be one."""
    return scripts.groupBy("script_hash").agg(F.min("script_pubkey").alias("script_pubkey"), F.count_distinct("script_pubkey").alias("conflicts"))


def ledger_difference(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows that two ledgers don't agree on."""
    a = left.select(*keys, F.struct(*values).alias("_a"))
    b = right.select(*keys, F.struct(*values).alias("_b"))
    kind = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("mismatch")
    return a.join(b, keys, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, kind.alias("difference"))


def undo_bundle(outputs: DataFrame, spends: DataFrame, first: int, last: int) -> DataFrame:
    """What a rollback of each height in [first, last] needs: outputs created and spent, accounts touched."""
    inside = F.col("height").between(first, last)
    rows = outputs.where(inside).select("height", "account", F.col("outpoint").alias("created"), F.lit(None).cast(outputs.schema["outpoint"].dataType).alias("spent"))
    rows = rows.unionByName(spends.where(inside).select("height", "account", F.lit(None).cast(outputs.schema["outpoint"].dataType).alias("created"), F.col("outpoint").alias("spent")))
    listed = lambda f, c: F.sort_array(f(c)).alias(c)
    return rows.groupBy("height").agg(listed(F.collect_list, "created"), listed(F.collect_list, "spent"), F.sort_array(F.collect_set("account")).alias("touched"))
