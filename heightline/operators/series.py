"""Summaries, carried-forward series and flows of one or many accounts over a half-open height range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(ledger: DataFrame, start: int, end: int) -> DataFrame:
    """One row an account that has any row before `end`, from one pass over the ledger.

    Peak and low begin at the opening balance, at the range's start, and give way only to a strictly
    larger or smaller balance, so the earliest of equals stays.
    """
    inside = F.col("height") >= start
    own = lambda c: F.when(inside, c)
    high = F.when(inside, F.struct("balance", (-F.col("height")).alias("early")))
    low = F.when(inside, F.struct("balance", "height"))
    found = ledger.where(F.col("height") < end).groupBy("account").agg(
        F.max_by(F.when(~inside, F.col("balance")), F.when(~inside, F.col("height"))).alias("_opening"),
        F.max_by(own(F.col("balance")), own(F.col("height"))).alias("_closing"),
        F.count(own(F.col("delta"))).alias("change_count"),
        F.coalesce(F.sum(F.when(inside & (F.col("delta") >= 0), F.col("delta"))), F.lit(0)).cast("bigint").alias("inflow"),
        F.coalesce(F.sum(F.when(inside & (F.col("delta") < 0), -F.col("delta"))), F.lit(0)).cast("bigint").alias("outflow"),
        F.coalesce(F.sum(own(F.col("delta"))), F.lit(0)).cast("bigint").alias("net_delta"),
        F.min(own(F.col("height"))).alias("first_height"),
        F.max(own(F.col("height"))).alias("latest_height"),
        F.max(high).alias("_high"),
        F.min(low).alias("_low"),
    )
    opening, first = F.coalesce("_opening", F.lit(0)), F.lit(start).cast("bigint")
    higher, lower = F.coalesce(F.col("_high.balance") > opening, F.lit(False)), F.coalesce(F.col("_low.balance") < opening, F.lit(False))
    return found.select(
        "account",
        opening.alias("start_balance"),
        F.coalesce("_closing", opening).alias("end_balance"),
        "change_count",
        "inflow",
        "outflow",
        "net_delta",
        "first_height",
        "latest_height",
        F.when(higher, F.col("_high.balance")).otherwise(opening).alias("peak_balance"),
        F.when(higher, -F.col("_high.early")).otherwise(first).alias("peak_height"),
        F.when(lower, F.col("_low.balance")).otherwise(opening).alias("low_balance"),
        F.when(lower, F.col("_low.height")).otherwise(first).alias("low_height"),
    )


def _slotted(ledger: DataFrame, start: int, end: int, size: int, *values) -> DataFrame:
    """account and _m, a map from bucket number to the values of that bucket; -1 is all before the range. An
    account with rows behind the range alone has an empty map.

    Rows meet by account only after they are one a bucket, so an account with very many rows is no hot key.
    """
    slot = F.when(F.col("height") < start, -1).when(F.col("height") >= end, F.lit(None)).otherwise(F.floor((F.col("height") - start) / size)).cast("int")
    moved = ledger.withColumn("_slot", slot).groupBy("account", "_slot").agg(F.struct(*values).alias("_v"))
    kept = F.filter(F.collect_list(F.struct("_slot", "_v")), lambda x: x["_slot"].isNotNull())
    return moved.groupBy("account").agg(F.map_from_entries(kept).alias("_m"))


def _spread(found: DataFrame, accounts: DataFrame | None, start: int, end: int, size: int) -> DataFrame:
    """account, _m, _k, bucket_start and bucket_end of every bucket; of the given accounts, or else of all found."""
    if accounts is not None:
        found = accounts.select("account").join(found, "account", "left")
    rows = found.select("account", "_m", F.explode(F.sequence(F.lit(0), F.lit((end - 1 - start) // size))).alias("_k"))
    return rows.withColumn("bucket_start", (F.lit(start) + F.col("_k") * size).cast("bigint")).withColumn("bucket_end", F.least(F.col("bucket_start") + size, F.lit(end).cast("bigint")))


def timeseries(ledger: DataFrame, accounts: DataFrame | None, start: int, end: int, size: int) -> DataFrame:
    """Every bucket of every account: closing balance carried forward, net, changes, last height."""
    found = _slotted(ledger, start, end, size, F.max_by("balance", "height").alias("b"), F.sum("delta").cast("bigint").alias("n"), F.count("*").alias("c"), F.max("height").alias("h"))
    rows = _spread(found, accounts, start, end, size).withColumn("_v", F.try_element_at("_m", F.col("_k")))
    order = Window.partitionBy("account").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.coalesce(F.last("_v.b", ignorenulls=True).over(order), F.try_element_at("_m", F.lit(-1))["b"], F.lit(0))
    return rows.select("account", "bucket_start", "bucket_end", carried.alias("balance"), F.coalesce("_v.n", F.lit(0)).alias("net_delta"), F.coalesce("_v.c", F.lit(0)).alias("change_count"), F.col("_v.h").alias("latest_height"))


def flows(ledger: DataFrame, accounts: DataFrame | None, start: int, end: int, size: int) -> DataFrame:
    """Every bucket of every account: inflow, outflow, net and changes, zero where nothing moved."""
    into, out = F.sum(F.when(F.col("delta") >= 0, F.col("delta")).otherwise(0)), F.sum(F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0))
    found = _slotted(ledger, start, end, size, into.cast("bigint").alias("i"), out.cast("bigint").alias("o"), F.sum("delta").cast("bigint").alias("n"), F.count("*").alias("c"))
    rows = _spread(found, accounts, start, end, size).withColumn("_v", F.try_element_at("_m", F.col("_k")))
    zero = lambda c, name: F.coalesce(F.col(f"_v.{c}"), F.lit(0)).alias(name)
    return rows.select("account", "bucket_start", "bucket_end", zero("i", "inflow"), zero("o", "outflow"), zero("n", "net_delta"), zero("c", "change_count"))


def batch_totals(ledger: DataFrame) -> DataFrame:
    """Per account and, with a null account, over all: records, last height, total delta."""
    return ledger.rollup("account").agg(F.count("*").alias("records"), F.max("height").alias("latest_height"), F.sum("delta").cast("bigint").alias("total_delta"))


def client_summary(rows: DataFrame) -> DataFrame:
    """A summary seeded by the first row itself, not by the balance before it."""
    first = F.struct("height")
    return rows.groupBy("account").agg(
        (F.min_by("balance", first) - F.min_by("delta", first)).alias("start_balance"), F.max_by("balance", first).alias("end_balance"), F.max("balance").alias("peak_balance"), F.min("balance").alias("low_balance"), F.count("*").alias("change_count"), F.sum("delta").cast("bigint").alias("net_delta"),
    )


def runs_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.count_if(~F.col("ok")).alias("failures"), F.min("seconds").alias("min_seconds"), F.avg("seconds").alias("avg_seconds"), F.max("seconds").alias("max_seconds"))
