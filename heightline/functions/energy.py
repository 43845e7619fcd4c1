"""Energy arithmetic of version 1, exact on DECIMAL(38,0) with u64 saturation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heightline.schema import U64_MAX

# Fixed values of the formula.
THRESHOLD = 100_000
GROWTH = 10_000
PENALTY = 43_200_000

WIDE = "decimal(38,0)"


def wide(n: int) -> Column:
    return F.lit(str(n)).cast(WIDE)


def capped(c: Column) -> Column:
    return F.least(F.greatest(c, wide(0)), wide(U64_MAX))


def growth(balance: Column, blocks: Column) -> Column:
    product = (balance.cast("decimal(20,0)") * F.lit(GROWTH).cast("decimal(5,0)") * blocks.cast("decimal(10,0)")).cast(WIDE)
    return F.when(balance < THRESHOLD, wide(0)).otherwise(capped(product))


def penalty(delta: Column) -> Column:
    product = (F.abs(delta.cast("decimal(20,0)")) * F.lit(PENALTY).cast("decimal(10,0)")).cast(WIDE)
    return F.when(delta >= 0, wide(0)).otherwise(capped(product))


def increase(balance: Column, active: Column, since: Column, to: Column) -> Column:
    """Growth between two heights of a balance that has been active from a third."""
    return F.when(to <= since, wide(0)).otherwise(F.greatest(growth(balance, to - active) - growth(balance, since - active), wide(0)))


def settled(energy: Column, balance: Column, active: Column, since: Column, to: Column, delta: Column) -> Column:
    grown = F.least(energy.cast(WIDE) + increase(balance, active, since, to), wide(U64_MAX))
    return F.when(delta < 0, F.greatest(grown - penalty(delta), wide(0))).otherwise(grown)


def projected(energy: Column, state: Column, balance: Column, active: Column, since: Column, to: Column) -> Column:
    """Energy at a query height; only an active record keeps growing."""
    return F.when(state == "active", F.least(energy.cast(WIDE) + increase(balance, active, since, to), wide(U64_MAX))).otherwise(energy.cast(WIDE))
