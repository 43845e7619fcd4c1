"""Recurrences e -> max(min(e + up, TOP) - down, 0), composed in pieces of heights.

Every step is a function x -> min(max(x + s, lo), hi), and so is what several of them make. A piece of a key is one such
function, which the next piece starts from; so no window and no array holds all rows of a key.

In a piece whose sums stay within TOP of each other no start meets both bounds, and both ends of the range follow from running
sums alone: from 0 the sum reflected at its minimum, from TOP the one reflected at its maximum. The few other pieces are folded row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heightline.functions.energy import WIDE
from heightline.operators.pieces import PIECE, UNKNOWN, pieced
from heightline.schema import U64_MAX
from heightline.staging import staged

KIND = f"struct<s:{WIDE},lo:{WIDE},hi:{WIDE}>"


def wide(c: Column | int) -> Column:
    return (F.lit(str(c)) if isinstance(c, int) else c).cast(WIDE)


def function(s: Column, lo: Column, hi: Column) -> Column:
    return F.struct(wide(s).alias("s"), wide(lo).alias("lo"), wide(hi).alias("hi")).cast(KIND)


def identity() -> Column:
    return function(wide(0), wide(0), wide(U64_MAX))


def step(up: Column, down: Column) -> Column:
    return function(up - down, wide(0), F.greatest(wide(U64_MAX) - down, wide(0)))


def applied(f: Column, x: Column) -> Column:
    return F.least(F.greatest((wide(x) + f["s"]).cast(WIDE), f["lo"]), f["hi"])


def composed(first: Column, then: Column) -> Column:
    return function(first["s"] + then["s"], applied(then, first["lo"]), applied(then, first["hi"]))


def shifted(f: Column, more: Column) -> Column:
    """x -> f(min(x + more, TOP))."""
    return composed(function(more, wide(0), wide(U64_MAX)), f)


def _running(functions: Column) -> Column:
    """Of a list of functions the list of what each and those before it make."""
    first = F.array().cast(f"array<{KIND}>")
    join = lambda acc, f: F.concat(acc, F.array(F.when(F.size(acc) > 0, composed(F.coalesce(F.try_element_at(acc, F.lit(-1)), identity()), f)).otherwise(f))).cast(f"array<{KIND}>")
    return F.aggregate(functions, first, join)


def prefixes(rows: DataFrame, keys: Sequence[str], order: Sequence[str], piece: int = PIECE, spans=UNKNOWN) -> DataFrame:
    """rows (with up and down, at least 0) with f: what the steps of the key up to and including this row make.

    order begins with height and tells the rows of a key apart. up and down go, and so does _piece. spans: the keys that have several pieces.
    """
    rows, cut = rows.drop("_piece"), rows if "_piece" in rows.columns else pieced(rows, piece=piece)
    kept = [c for c in rows.columns if c not in ("up", "down")]
    parts = Window.partitionBy(*keys, "_piece")
    upto = parts.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumn("_s", F.sum(wide(F.col("up") - F.col("down"))).over(upto).cast(WIDE))
    summed = summed.withColumn("_t", wide(F.col("_s") + F.col("down"))).withColumns({"_low": F.least(F.min("_s").over(upto), wide(0)), "_high": F.greatest(F.max("_t").over(upto), wide(0))})
    apart = (F.max("_high").over(parts) - F.min("_low").over(parts)) > wide(U64_MAX)
    plain = function(F.col("_s"), F.col("_s") - F.col("_low"), F.lit(str(U64_MAX)).cast(WIDE) + F.col("_s") - F.col("_high"))
    found = staged(summed.withColumn("_apart", apart).select(*rows.columns, "_piece", "_apart", plain.alias("_f")), "steps")
    if not found.where("_apart").isEmpty():
        listed = found.where("_apart").groupBy(*keys, "_piece").agg(F.sort_array(F.collect_list(F.struct(*order, "up", "down"))).alias("_r"))  # the rows of a piece
        pairs = F.arrays_zip(F.col("_r").alias("r"), _running(F.transform("_r", lambda r: step(r["up"], r["down"]))).alias("f"))
        folded = listed.select(*keys, "_piece", F.explode(pairs).alias("_z")).select(*keys, *(F.col(f"_z.r.{c}").alias(c) for c in order), F.col("_z.f").alias("_g"))
        found = found.join(folded, [*keys, *order], "left").withColumn("_f", F.when(F.col("_apart"), F.col("_g")).otherwise(F.col("_f"))).drop("_g")
    if spans is None:
        return found.select(*kept, F.when(F.col("_apart"), composed(identity(), F.col("_f"))).otherwise(F.col("_f")).alias("f"))
    several = found if spans is UNKNOWN else found.join(spans, [*keys], "left_semi")
    totals = several.groupBy(*keys, "_piece").agg(F.max_by("_f", F.struct(*order)).alias("_f"))
    lists = totals.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_piece", "_f"))).alias("_p"))  # a key's pieces, not its rows
    ran = _running(F.transform("_p", lambda p: p["_f"]))
    before = F.transform("_p", lambda p, i: F.struct(p["_piece"].alias("_piece"), F.when(i > 0, F.get("_ran", i - 1)).otherwise(identity()).alias("_b")))
    starts = lists.withColumn("_ran", ran).select(*keys, F.inline(before))
    if spans is UNKNOWN:
        return found.join(starts, [*keys, "_piece"]).select(*kept, composed(F.col("_b"), F.col("_f")).alias("f"))
    starts = staged(starts, "starts")  # its size tells whether a join moves the rows
    return found.join(starts, [*keys, "_piece"], "left").select(*kept, composed(F.coalesce("_b", identity()), F.col("_f")).alias("f"))
