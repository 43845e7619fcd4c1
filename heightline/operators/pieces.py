"""Looks along the heights of a key, in pieces of heights, so that a key with most rows is the work of many tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heightline.staging import staged

#: Heights in one piece.
PIECE = 1024


def pieced(rows: DataFrame, height: str = "height", piece: int = PIECE) -> DataFrame:
    """rows with _piece, the number of the piece that their height lies in."""
    return rows.withColumn("_piece", F.floor(F.col(height) / piece))


def spanning(cut: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The keys whose rows lie in more than one piece, staged; None where there are none. Only their rows need what other pieces hold."""
    ends = cut.agg(F.min("_piece").alias("_a"), F.max("_piece").alias("_z")).first()
    if ends["_a"] == ends["_z"]:
        return None
    found = cut.groupBy(*keys).agg(F.min("_piece").alias("_a"), F.max("_piece").alias("_z")).where("_a < _z").select(*keys)
    found = staged(found, "spanning")
    return None if found.isEmpty() else found


#: Stands for keys that were not looked for, as None says that there are none.
UNKNOWN = object()


def nearest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column], height: str = "height", piece: int = PIECE, back: bool = True, spans=UNKNOWN) -> DataFrame:
    """rows with, for each of values, its nearest one that isn't null on a row of the same keys that stands before (back) or behind.

    order begins with the height. Inside a piece a window looks; what the pieces before hold comes from a small table with one row for
    each key and piece, only of keys that have several pieces where these are known (spans). rows had best be staged, for both read them. Keys
    aren't null. A column _piece of rows stays, so that what follows in the same pieces needs no other shuffle.
    """
    cut = rows if "_piece" in rows.columns else pieced(rows, height, piece)
    way = (lambda c: F.col(c).asc()) if back else (lambda c: F.col(c).desc())
    inside = Window.partitionBy(*keys, "_piece").orderBy(*map(way, order)).rowsBetween(Window.unboundedPreceding, -1)
    looked = cut.withColumns({n: F.last(v, ignorenulls=True).over(inside) for n, v in values.items()})
    if spans is None:
        return looked.select(*rows.columns, *values)
    pick = F.max_by if back else F.min_by
    place = F.struct(*order)
    several = cut if spans is UNKNOWN else cut.join(spans, [*keys], "left_semi")
    tails = several.groupBy(*keys, "_piece").agg(*(pick(v, F.when(v.isNotNull(), place)).alias(f"_of_{n}") for n, v in values.items()))
    ahead = Window.partitionBy(*keys).orderBy(way("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, "_piece", *(F.last(f"_of_{n}", ignorenulls=True).over(ahead).alias(f"_of_{n}") for n in values))
    found = looked.join(carried, [*keys, "_piece"], "inner" if spans is UNKNOWN else "left")
    return found.select(*rows.columns, *(F.coalesce(n, f"_of_{n}").alias(n) for n in values))
