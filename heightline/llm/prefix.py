"""Running sums within groups of any size, by pieces that range partitioning makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heightline.llm.columns import spare
from heightline.staging import staged


def running(df: DataFrame, groups: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with a column for each entry (name, value) of sums: value's sum over the rows of the group that stand before in `order`.

    Rows are dealt by ranges of group and order, so a group of any size is many pieces, each summed by itself;
    the sums of whole pieces, a row for each group and piece, are carried on. No value may be null in `groups`. Two staged
    tables come of it; `order` should tell rows apart, since ranges keep rows that it doesn't tell apart in one piece.
    """
    piece = spare([*df.columns, *sums], "_piece")
    before = {name: spare([*df.columns, *sums], f"_before_{name}") for name in sums}
    ranged = [F.col(g).asc() for g in groups] + order
    dealt = staged(df.repartitionByRange(*ranged).withColumn(piece, F.spark_partition_id()), "dealt")
    totals = dealt.groupBy(*groups, piece).agg(*(F.sum(value).alias(before[name]) for name, value in sums.items()))
    ahead = Window.partitionBy(*groups).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    carried = staged(totals.withColumns({b: F.coalesce(F.sum(b).over(ahead), F.lit(0)) for b in before.values()}), "carried")
    inside = Window.partitionBy(*groups, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumns({name: F.coalesce(F.sum(value).over(inside), F.lit(0)) for name, value in sums.items()})
    return summed.join(carried, [*groups, piece]).withColumns({name: F.col(name) + F.col(b) for name, b in before.items()}).drop(piece, *before.values())
