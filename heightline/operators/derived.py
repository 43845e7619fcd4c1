"""Specified but uncoded derived values: version-2 energy, levels, effective energy, emission, windows."""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heightline.operators.pieces import nearest
from heightline.staging import discard, staged

# Fixed values of the specifications.
UNIT = 100_000
INHERIT_BPS, COLLAB_BPS, BPS = 9_500, 5_000, 10_000
ACTIVITY_BLOCKS = 50_400
MOST_LEVEL_DISCOUNT = 5_000

_W = "decimal(38,0)"


def _floor_div(a: Column, b: Column | int) -> Column:
    """Exact integer quotient of wide decimals that aren't negative."""
    b = F.lit(b) if isinstance(b, int) else b
    a, b = a.cast(_W), b.cast(_W)
    return ((a - a % b) / b).cast(_W)


def units(balance: Column) -> Column:
    return _floor_div(balance, UNIT)


#: Heights whose rows of one key are folded at once.
SPAN = 65_536


def raw_energy_v2(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """Fold of each key's balance rows: growth by units, a penalty of 1.5 x lost units x age, age cut in
    proportion to the units that stay. Ages, which are floored at each loss, make it sequential within a key, so spans of heights
    follow one another: each is folded from the state that the one before left, and that is staged. An array holds a key's rows of one span.

    The exact limit of 128 bits has 39 digits and is out of reach of DECIMAL(38,0); energies are held in
    38 digits and an overflow raises.
    """
    kind = "struct<height:bigint,units:decimal(38,0),age:decimal(38,0),energy:decimal(38,0)>"

    def step(acc: Column, r: Column) -> Column:
        n = units(r["balance"])
        blocks = (r["height"] - acc["height"]).cast(_W)
        age = acc["age"] + blocks
        grown = acc["energy"] + (acc["units"] * blocks).cast(_W)
        lost = F.greatest(acc["units"] - n, F.lit(0).cast(_W))
        cost = _floor_div((lost * age).cast(_W) * 3, 2)
        kept = F.when(n < acc["units"], _floor_div((age * n).cast(_W), F.greatest(acc["units"], F.lit(1).cast(_W)))).otherwise(age)
        return F.struct(r["height"].alias("height"), n.alias("units"), kept.cast(_W).alias("age"), F.greatest(grown.cast(_W) - cost, F.lit(0).cast(_W)).cast(_W).alias("energy")).cast(kind)

    cut = staged(rows.select("key", "height", "balance", F.floor(F.col("height") / span).alias("_span")), "raw-energy")
    spans = [r[0] for r in cut.select("_span").distinct().orderBy("_span").collect()]  # one entry for `span` heights
    first = F.element_at("_rows", 1)
    seed = F.struct(first["height"].alias("height"), units(first["balance"]).alias("units"), F.lit(0).cast(_W).alias("age"), F.lit(0).cast(_W).alias("energy")).cast(kind)
    rest = F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(1)))
    state = cut.select("key", F.lit(None).cast(kind).alias("e")).limit(0)
    for at in spans:
        listed = cut.where(F.col("_span") == at).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("height", "balance"))).alias("_rows"))
        both = state.join(listed, "key", "full_outer")
        folded = F.when(F.col("_rows").isNull(), F.col("e")).when(F.col("e").isNull(), F.aggregate(rest, seed, step)).otherwise(F.aggregate("_rows", F.col("e"), step))
        last, state = state, staged(both.select("key", folded.alias("e")), "raw-energy-state")
        if at != spans[0]:
            discard(last)
    return state.select("key", "e.*")


def inherited(rows: DataFrame) -> DataFrame:
    """Sum over each heir of the floored shares of its predecessors. rows: heir, energy."""
    return rows.groupBy("heir").agg(F.sum(_floor_div(F.col("energy").cast(_W) * INHERIT_BPS, BPS)).cast(_W).alias("inherited"))


def leaders(collabs: DataFrame, passes: DataFrame) -> DataFrame:
    """Leader of each collaborator (key, leader_pass, leader_owner): by pass id, else by the owner's pass."""
    by_id = passes.select(F.col("key").alias("leader_pass"), F.col("key").alias("_a"))
    by_owner = passes.select(F.col("owner").alias("leader_owner"), F.col("key").alias("_b"))
    return collabs.join(by_id, "leader_pass", "left").join(by_owner, "leader_owner", "left").select("key", F.coalesce("_a", "_b").alias("leader"))


def effective_energy(raw: DataFrame, collab: DataFrame) -> DataFrame:
    """raw: key, energy, active; collab: key, leader. Collaborators and inactive passes have none."""
    shares = collab.join(raw, "key").where("active").groupBy("leader").agg(F.sum(_floor_div(F.col("energy").cast(_W) * COLLAB_BPS, BPS)).alias("_c"))
    is_collab = collab.select("key", F.lit(True).alias("_k"))
    own = F.when(F.col("_k").isNotNull() | ~F.col("active"), F.lit(0).cast(_W)).otherwise(F.col("energy").cast(_W) + F.coalesce("_c", F.lit(0).cast(_W)))
    return raw.join(shares.withColumnRenamed("leader", "key"), "key", "left").join(is_collab, "key", "left").select("key", own.cast(_W).alias("effective_energy"))


def levels(rows: DataFrame, energy: str, thresholds: DataFrame) -> DataFrame:
    """Highest level whose threshold the energy reaches; thresholds (level, least) has at most some hundred rows."""
    table = F.broadcast(thresholds.agg(F.sort_array(F.collect_list(F.struct("least", "level"))).alias("_t")))
    return rows.join(table).withColumn("level", F.array_max(F.transform(F.filter("_t", lambda t: t["least"] <= F.col(energy)), lambda t: t["level"]))).drop("_t")


def difficulty_factor(level: Column) -> Column:
    return (F.lit(BPS) - F.least(level * 100, F.lit(MOST_LEVEL_DISCOUNT))).cast("int")


def real_difficulty(base: Column, factor: Column) -> Column:
    return _floor_div(base.cast(_W) * factor + (BPS - 1), BPS)


def emission(miner_sats: Column, price: Column, issued: Column, k_bps: Column, blocks: int) -> Column:
    """min(remaining, floor(remaining * k / (blocks * 10000))) of what the miners' balance is worth."""
    target = _floor_div(miner_sats.cast(_W) * price, 100_000_000)
    left = F.greatest(target - issued.cast(_W), F.lit(0).cast(_W))
    return F.least(left, _floor_div((left * k_bps).cast(_W), blocks * BPS))


def split(amount: Column, bps: Column) -> Column:
    """A floored share and the rest."""
    share = _floor_div(amount.cast(_W) * bps, BPS)
    return F.struct(share.alias("share"), (amount.cast(_W) - share).cast(_W).alias("rest"))


#: Heights in one piece when the rows of a chain are numbered.
PIECE = 65_536


def numbered(rows: DataFrame) -> DataFrame:
    """rows with _i, their place by height from 0: places in pieces of heights, and the rows before each piece."""
    piece = F.floor(F.col("height") / PIECE)
    sizes = rows.groupBy(piece.alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a piece
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("height"))
    return rows.withColumn("_p", piece).withColumn("_i", inside - 1).join(before, "_p").withColumn("_i", F.col("_i") + F.col("_before")).drop("_p", "_before")


def rolling_before(rows: DataFrame, value: str, width: int = ACTIVITY_BLOCKS) -> DataFrame:
    """Sum over the `width` rows before each height, itself left out, and their number. One row a block.

    Rows are cut into runs of `width` places; each row also goes to the run behind its own, so a run has all
    that its rows look back on, and no task holds more than two runs.
    """
    run = F.floor(F.col("_i") / width)
    placed = numbered(rows.select("height", F.col(value).alias("_v")))
    both = placed.select("height", "_v", "_i", F.explode(F.array(run, run + 1)).alias("_run"))
    order = Window.partitionBy("_run").orderBy("_i").rowsBetween(-width, -1)
    found = both.withColumns({"previous": F.coalesce(F.sum("_v").over(order), F.lit(0)), "samples": F.count("*").over(order)})
    return found.where(F.col("_run") == run).select("height", F.col("_v").alias(value), "previous", "samples")


def efficiency(now: Column, average: Column) -> Column:
    """K in basis points from this block's energy and the window's average: 8001 to 20000, 10000 without a window."""
    now, average = now.cast(_W), average.cast(_W)
    part = (now + average * 5).cast(_W)
    penalty = _floor_div((average * 60_000 + part - 1).cast(_W), F.greatest(part, F.lit(1).cast(_W)))
    below = F.greatest(F.lit(8001).cast(_W), F.lit(20_000).cast(_W) - penalty)
    above = F.least(F.lit(20_000).cast(_W), _floor_div((now * BPS).cast(_W), F.greatest(average, F.lit(1).cast(_W))))
    return F.when(average == 0, BPS).when(now < average, below).otherwise(above).cast("int")


#: Fixed values of the level table: the first step, the ratio of one step to the next, and the highest level.
FIRST_STEP, RATIO, TOP_LEVEL = 1_000_000, Fraction(118, 100), 50


def level_table() -> list[tuple[int, int]]:
    """(level, least energy): rounded-up sums of a geometric series, exact."""
    sums = [FIRST_STEP * sum(RATIO**i for i in range(level)) for level in range(TOP_LEVEL + 1)]
    return [(level, ceil(s)) for level, s in enumerate(sums)]


def price_at(heights: DataFrame, policy: DataFrame) -> DataFrame:
    """heights (height and others) with the price whose range holds each; policy (start, price) has one row a change, and any number of them.

    Changes and heights are looked along together in pieces; a height before the first change has no price. Of several changes
    at one height the one with the highest price counts.
    """
    changes = policy.groupBy(F.col("start").cast("bigint").alias("height")).agg(F.max("price").alias("price")).withColumn("side", F.lit(0))
    asked = heights.select(F.col("height").cast("bigint").alias("height"), F.lit(None).cast(policy.schema["price"].dataType).alias("price"), F.lit(1).alias("side")).distinct()
    line = staged(changes.unionByName(asked).where("height is not null"), "prices")
    found = nearest(line, [], ["height", "side"], {"_price": F.col("price")}).where("side = 1").select("height", F.col("_price").alias("price"))
    return heights.join(found, "height", "left")


def candidate_page(effective: DataFrame, limit: int, after: tuple[int, object] | None = None, energy: str = "effective_energy") -> DataFrame:
    """The next `limit` candidates (key, energy above 0), most energy first, then the smaller key.

    after: energy and key of the last one seen. A cursor by value stays right while others enter or leave: none that stays is
    shown twice or left out.
    """
    rows = effective.where(F.col(energy) > 0)
    if after is not None:
        most, key = F.lit(str(after[0])).cast(_W), F.lit(after[1])
        rows = rows.where((F.col(energy).cast(_W) < most) | ((F.col(energy).cast(_W) == most) & (F.col("key") > key)))
    return rows.orderBy(F.desc(energy), "key").limit(limit)


def collaborators(page: DataFrame, raw: DataFrame, collab: DataFrame) -> DataFrame:
    """What the energies of a page of candidates are made of: key, collaborator, energy and share; a row for each active collaborator.

    A candidate's own energy is the row that has itself as its collaborator, with all of it as its share.
    """
    share = _floor_div(F.col("energy").cast(_W) * COLLAB_BPS, BPS)
    wanted = page.select("key")
    others = collab.join(wanted.withColumnRenamed("key", "leader"), "leader").join(raw.where("active").select("key", "energy"), "key")
    own = raw.join(wanted, "key").select("key", F.col("key").alias("collaborator"), F.col("energy").cast(_W).alias("energy"), F.col("energy").cast(_W).alias("share"))
    return own.unionByName(others.select(F.col("leader").alias("key"), F.col("key").alias("collaborator"), F.col("energy").cast(_W).alias("energy"), share.alias("share")))


def candidate_energy(height: Column, last_quote: Column, effective: Column, raw: Column) -> Column:
    """Effective energy while the last quote is recent, raw energy otherwise or without any."""
    return F.when(height - last_quote <= ACTIVITY_BLOCKS, effective).otherwise(raw)
