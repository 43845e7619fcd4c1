"""Energy records of passes over their owners' balance rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heightline.functions import energy as E
from heightline.operators import clamp
from heightline.operators.pieces import nearest
from heightline.operators.validation import RequestError
from heightline.staging import staged


def records(rows: DataFrame) -> DataFrame:
    """The energy of a key after each of its rows, bounds included; the first row of a key is its seed with energy 0.

    rows: key, height, balance, delta; staged, as several passes read them. Keys of any length are taken in pieces of heights.
    """
    rows = staged(rows, "energy-rows")
    own = {"_last": F.struct("height", "balance"), "_drop": F.when(F.col("delta") < 0, F.col("height"))}
    seen = nearest(rows, ["key"], ["height"], own)
    firsts = rows.groupBy("key").agg(F.min("height").alias("_first"))
    known = seen.join(firsts, "key")
    active = F.coalesce("_drop", "_first")  # before this row
    grown = E.increase(F.col("_last.balance"), active, F.col("_last.height"), F.col("height"))
    seed = F.col("_last").isNull()
    steps = known.select(
        "key", "height", "balance", "delta", F.when((F.col("delta") < 0) & ~seed, F.col("height")).otherwise(active).alias("active_height"),
        F.when(seed, E.wide(0)).otherwise(grown).alias("up"), F.when(seed, E.wide(0)).otherwise(E.penalty(F.col("delta"))).alias("down"),
    )
    made = clamp.prefixes(steps, ["key"], ["height"])
    return made.select("key", "height", "balance", "delta", "active_height", clamp.applied(F.col("f"), E.wide(0)).cast("decimal(20,0)").alias("energy"))


def as_of(records_: DataFrame, height: int) -> DataFrame:
    """The last record of each key at or before a height; none where there is none."""
    return records_.where(F.col("height") <= height).groupBy("key").agg(F.max_by(F.struct("height", "balance", "delta", "active_height", "energy"), "height").alias("r")).select("key", "r.*")


def projected(records_: DataFrame, height: int, state: str | None = None) -> DataFrame:
    found = as_of(records_, height)
    kind = F.lit(state or "active")
    return found.withColumn("projected", E.projected(F.col("energy"), kind, F.col("balance"), F.col("active_height"), F.col("height"), F.lit(height)))


def leaderboard(rows: DataFrame, top: int, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Energy descending, later records first, then the key; cut to the best `top`, then paged."""
    best = rows.orderBy(F.desc("energy"), F.desc("record_height"), "key").limit(top)
    page = best if limit is None else best.orderBy(F.desc("energy"), F.desc("record_height"), "key").offset(offset).limit(limit)
    return page


def winner(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min_by(F.struct("key", "energy"), F.struct(-F.col("energy"), "key")).alias("r")).select("r.*")


def last_write(rows: DataFrame) -> DataFrame:
    """Of several writes to one key and height the one with the highest sequence stays."""
    return rows.groupBy("key", "height").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("key", "height")]), "sequence").alias("r")).select("key", "height", "r.*")


def reconciled(records: DataFrame, passes_synced: int, synced: int | None, pending: int | None = None) -> tuple[DataFrame, int]:
    """Energy records that stay, and their synced height, once the passes stand at `passes_synced`.

    A pending height was left by a block that never ended: its records and later ones go. So do all beyond the
    passes. Energy that is behind the passes can't be mended by truncation and raises; without a synced height
    the passes' one is taken. records: block_height; a record without one is left out.
    """
    if synced is not None and synced < passes_synced:
        raise RequestError("ENERGY_BEHIND_PASSES", f"{synced} < {passes_synced}")
    bound = passes_synced if pending is None else min(passes_synced, pending - 1)
    return records.where(F.col("block_height") <= bound), passes_synced
