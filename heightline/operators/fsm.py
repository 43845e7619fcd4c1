"""The pass state machine with its energy, as joins and looks along heights; no group holds a component, a pass or an owner.

What ends a pass's active time is known from three heights alone: its owner's next mint, its first move to another owner, its burning.
Who owned it when follows from its own moves. So which mint consumes it is a join of mints' predecessors with both, and states
need no replay. Where a mint must be refused as a whole for one bad predecessor, validity is guessed and derived again
until no guess changes: a decision hangs on earlier ones alone, so every round settles at least the first wrong one, and mostly all.

Energy is one clamped function of what a pass inherits (`clamp`), made of its owner's balance rows in its active time.
Inheritance is a forest: a consumed pass hands its energy to one mint. Rounds resolve it from both ends: passes whose predecessors
are known hand on their value, and passes with one unknown predecessor jump over it, which halves chains.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heightline.functions import energy as E
from heightline.operators import clamp
from heightline.operators.pieces import nearest, pieced, spanning
from heightline.staging import discard, staged

#: events: height, event_order, op (mint, invalid_mint, transfer, burn, balance), inscription_id, owner,
#: prev, satpoint, balance, delta. An owner has one balance row a height, a pass one mint.
#: The log's order within a block is rank, event_order, trigger (the pass whose event it was), step, place.
LOG = ("block_height", "rank", "event_order", "trigger", "step", "place", "inscription_id", "event_type", "prev_state", "new_state", "prev_owner", "new_owner", "prev_satpoint", "new_satpoint", "energy")

REMINT, AWAY, BURN = 0, 1, 2
SEED, SETTLED, ASKED, FINAL = 0, 1, 2, 3


def _position() -> Column:
    """Mints, moves and burns come in their order, then invalid mints."""
    rank = F.when(F.col("op") == "invalid_mint", 2).otherwise(1)
    return F.struct("height", rank.alias("rank"), F.col("event_order").cast("int").alias("event_order"), F.col("inscription_id").alias("trigger"))


def _sound(bad: Column, *message: Column | str) -> Column:
    """True, unless bad holds: that raises, with the row's names."""
    return F.when(bad, F.raise_error(F.concat(*(F.lit(m) if isinstance(m, str) else m.cast("string") for m in message))).cast("boolean")).otherwise(True)


def _born(moves: DataFrame) -> DataFrame:
    """id, born, minter, mint_satpoint, prev, may (be valid) of every pass."""
    mints = moves.where("op in ('mint', 'invalid_mint')").withColumnRenamed("inscription_id", "id")
    counted = mints.withColumn("_n", F.count("*").over(Window.partitionBy("id")))  # one row, or else it raises
    counted = counted.where(_sound(F.col("_n") > 1, "pass ", F.col("id"), " is minted twice"))
    return counted.select("id", F.col("pos").alias("born"), F.col("owner").alias("minter"), F.col("satpoint").alias("mint_satpoint"), "prev", (F.col("op") == "mint").alias("may"))


def _changes(moves: DataFrame, born: DataFrame) -> DataFrame:
    """Transfers and burns, each with the owner and satpoint before and after it."""
    known = moves.where("op in ('transfer', 'burn')").select(F.col("inscription_id").alias("id"), "pos", "height", "op", "owner", "satpoint").join(born.select("id", "born", "minter", "mint_satpoint"), "id", "left")
    lost = F.col("born").isNull() | (F.col("pos") < F.col("born"))
    known = staged(known.where(_sound(lost, "pass ", F.col("id"), " not found for a ", F.col("op"), " at ", F.col("height"))), "moves")
    moved = F.col("op") == "transfer"
    seen = nearest(known, ["id"], ["height", "pos"], {"_before": F.when(moved, F.struct("owner", "satpoint"))}, spans=spanning(pieced(known), ["id"]))
    owner = F.coalesce("_before.owner", "minter")
    at = F.when(F.col("_before").isNull(), F.col("mint_satpoint")).otherwise(F.col("_before.satpoint"))
    kept = lambda new, old: F.when(moved, F.col(new)).otherwise(old)
    return seen.select("id", "pos", "height", "op", "minter", owner.alias("prev_owner"), kept("owner", owner).alias("new_owner"), at.alias("prev_satpoint"), kept("satpoint", at).alias("new_satpoint"))


def _marks(changes: DataFrame) -> DataFrame:
    """id, moved (first move), away (first one to another owner) and burnt of the passes that changed."""
    moved = F.col("op") == "transfer"
    away = moved & (F.col("new_owner") != F.col("minter"))
    return changes.groupBy("id").agg(F.min(F.when(moved, F.col("pos"))).alias("moved"), F.min(F.when(away, F.col("pos"))).alias("away"), F.min(F.when(F.col("op") == "burn", F.col("pos"))).alias("burnt"))


def _claims(born: DataFrame, changes: DataFrame) -> DataFrame:
    """heir, pos, place, id: the predecessors of mints that exist by then, are the minter's and not burned; each once a mint."""
    asked = born.where("may").select(F.col("id").alias("heir"), F.col("born").alias("pos"), F.col("minter").alias("by"), "prev", F.posexplode("prev").alias("place", "id"))
    asked = asked.where("place + 1 = array_position(prev, id)").drop("prev")
    could = asked.join(born.where("may").select("id", "born", "minter", "moved", "burnt"), "id")
    could = could.where((F.col("born") < F.col("pos")) & (F.col("burnt").isNull() | (F.col("burnt") > F.col("pos")))).drop("born", "burnt")
    could = staged(could, "could")
    stayed = could.where(_stayed()).where(F.col("minter") == F.col("by")).select("heir", "pos", "place", "id")
    could = could.where(~_stayed()).drop("moved")
    moved = changes.where("op = 'transfer'").select("id", "pos", F.col("new_owner").alias("owner"))
    line = staged(could.withColumn("owner", F.lit(None).cast("string")).unionByName(moved, allowMissingColumns=True).withColumn("height", F.col("pos.height")), "claims")
    held = nearest(line, ["id"], ["height", "pos"], {"_held": F.col("owner")}, spans=spanning(pieced(line), ["id"])).where("heir is not null")
    return stayed.unionByName(held.where(F.coalesce("_held", "minter") == F.col("by")).select("heir", "pos", "place", "id"))


def _stayed() -> Column:
    """Whether a pass had not moved before pos, so that its owner and place are those of its mint."""
    return F.coalesce(F.col("moved") > F.col("pos"), F.lit(True))


def _valid(born: DataFrame, claims: DataFrame) -> DataFrame:
    """id and valid of every pass, where a mint is invalid unless it gets every one of prev, each named once."""
    held = claims.groupBy(F.col("heir").alias("id")).agg(F.count("*").alias("_n"))
    could = born.join(held, "id", "left").select("id", (F.col("may") & (F.greatest(F.coalesce(F.size("prev"), F.lit(0)), F.lit(0)) == F.coalesce("_n", F.lit(0)))).alias("could"))
    could = staged(could, "mints")
    named = lambda of, value: could.select(F.col("id").alias(of), F.col("could").alias(value))
    claims = staged(claims.select("heir", "pos", "id").join(named("heir", "_sound"), "heir").join(named("id", "_there"), "id"), "claims-of-mints")
    found, news, all_ = _refused(claims, claims), [], claims.count()
    changed = staged(found.where("_sound and _refused").select(F.col("heir").alias("id"), F.lit(False).alias("valid")), "changed")
    while not changed.isEmpty():
        news.append(changed.withColumn("_round", F.lit(len(news))))
        latest = reduce(DataFrame.unionByName, news).groupBy("id").agg(F.max_by("valid", "_round").alias("valid"))
        mine = rivals = claims
        used = []
        if changed.count() * ASIDE < all_:
            # Only heirs whose predecessors, or whose rivals for one, changed may change now.
            touched = changed.select("id").unionByName(claims.join(changed.select(F.col("id").alias("heir")), "heir", "left_semi").select("id"))
            used.append(staged(touched.distinct(), "touched"))
            used.append(staged(claims.where("_sound").join(used[-1], "id", "left_semi").select("heir").distinct(), "heirs"))
            used.append(staged(claims.join(used[-1], "heir", "left_semi"), "claims-of-heirs"))
            mine = used[-1]
            rivals = claims.join(mine.select("id").distinct(), "id", "left_semi")
        now = lambda rows, of, value: rows.join(latest.select(F.col("id").alias(of), F.col("valid").alias("_now")), of, "left").withColumn(value, F.coalesce("_now", value)).drop("_now")
        found = _refused(now(mine, "id", "_there"), now(rivals, "heir", "_sound"))
        found = now(found.where("_sound").withColumn("_old", F.col("_sound")), "heir", "_old")
        changed = staged(found.where("_old = _refused").select(F.col("heir").alias("id"), (~F.col("_refused")).alias("valid")), "changed")
        discard(*used)
    if not news:
        return could.select("id", F.col("could").alias("valid"))
    return could.join(latest, "id", "left").select("id", F.coalesce("valid", "could").alias("valid"))


#: A round reads the claims that the last one's changes touch, where these changes are fewer than one in so many claims; else all of them.
ASIDE = 8


def _refused(mine: DataFrame, rivals: DataFrame) -> DataFrame:
    """heir, _sound (as in mine) and _refused: whether one of its predecessors isn't there, or an earlier sound heir among rivals has it."""
    first = rivals.where("_sound").groupBy("id").agg(F.min("pos").alias("_first"))
    bad = ~F.col("_there") | F.coalesce(F.col("_first") < F.col("pos"), F.lit(False))
    return mine.join(first, "id", "left").groupBy("heir").agg(F.max("_sound").alias("_sound"), F.max(bad).alias("_refused"))


def passes(born: DataFrame, changes: DataFrame, whole_prev: bool) -> DataFrame:
    """All passes with validity, end and cause of their active time, burnt, and heir, taken and place where a mint consumes them."""
    born = staged(born.join(_marks(changes), "id", "left"), "born")
    claims = staged(_claims(born, changes), "claimed")
    if whole_prev:
        rows = staged(born.join(_valid(born, claims), "id"), "valid")
        sound = rows.where("valid").select("id")
        claims = claims.join(sound.withColumnRenamed("id", "heir"), "heir").join(sound, "id")
    else:
        rows = born.withColumn("valid", F.col("may"))  # claims are of such heirs, on such passes
    sound = rows.where("valid").select("id", "minter", "born", F.col("born.height").alias("height"))
    following = nearest(sound, ["minter"], ["height", "born"], {"_next": F.col("born")}, back=False).select("id", F.col("_next").alias("remint"))
    mine = claims.groupBy("id").agg(F.min(F.struct("pos", "heir", "place")).alias("t"))
    full = rows.join(following, "id", "left").join(mine.select("id", F.col("t.pos").alias("taken"), "t.heir", "t.place"), "id", "left")
    end = F.when(F.col("valid"), F.least("remint", "away", "burnt"))
    cause = F.when(F.col("end") == F.col("remint"), REMINT).when(F.col("end") == F.col("away"), AWAY).when(F.col("end").isNotNull(), BURN)
    return staged(full.withColumn("end", end).withColumn("cause", cause).drop("remint", "away", "prev", "may"), "passes")


def _functions(events: DataFrame, held: DataFrame, changes: DataFrame) -> DataFrame:
    """id, kind, pos, ends, f: what a pass's energy is, of what it inherits, at the end of its active time (ends) and at changes in it."""
    balances = events.where("op = 'balance'").select("owner", "height", F.lit(0).alias("kind"), F.lit(None).cast(held.schema["born"].dataType).alias("pos"), F.struct(F.col("balance").cast("bigint").alias("balance"), F.col("delta").cast("bigint").alias("delta")).alias("b"))
    minted = held.where("valid").select(F.col("minter").alias("owner"), F.col("born.height").alias("height"), F.lit(1).alias("kind"), F.col("born").alias("pos"), F.struct("id", "end", F.col("born")).alias("m"))
    line = staged(balances.unionByName(minted, allowMissingColumns=True), "owners")
    # A balance row belongs to the pass minted before its block, a mint starts from the row of its own block.
    seen = staged(nearest(line, ["owner"], ["height", "kind", "pos"], {"_m": F.col("m"), "_b": F.col("b")}), "seen")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    seeds = seen.where("kind = 1").select("m.id", "height", F.lit(SEED).alias("kind"), F.col("m.born").alias("pos"), zero("_b.balance").alias("balance"), F.lit(0).cast("bigint").alias("delta"))
    rows = seen.where("kind = 0 and _m is not null and (_m.end is null or _m.end.height >= height)").select("_m.id", "height", F.lit(SETTLED).alias("kind"), F.col("_m.born").alias("pos"), "b.balance", "b.delta", (F.col("_m.end.height") == F.col("height")).alias("_last"))
    known = changes.join(held.where("valid").select("id", "end", "cause"), "id").where((F.col("end").isNull()) | (F.col("pos") <= F.col("end")))
    asked = staged(known.select("id", "height", F.lit(ASKED).alias("kind"), "pos", F.coalesce((F.col("pos") == F.col("end")) & (F.col("cause") == BURN) & (F.col("op") == "burn"), F.lit(False)).alias("ends")), "asked")
    busy = asked.select("id", "height", F.lit(True).alias("_busy")).distinct()
    rows = rows.join(busy, ["id", "height"], "left").where("delta <> 0 or _last or _busy").drop("_last", "_busy")
    finals = held.where(F.col("cause").isin(REMINT, AWAY)).select("id", F.col("end.height").alias("height"), F.lit(FINAL).alias("kind"), F.col("end").alias("pos"), F.lit(True).alias("ends"))
    steps = seeds.unionByName(rows).unionByName(asked, allowMissingColumns=True).unionByName(finals, allowMissingColumns=True)
    steps = pieced(staged(steps, "steps-of-passes"))
    spans = spanning(steps, ["id"])
    own = F.col("kind") <= SETTLED
    before = nearest(steps, ["id"], ["height", "kind", "pos"], {"_last": F.when(own, F.struct("height", "balance")), "_from": F.when((F.col("kind") == SEED) | (own & (F.col("delta") < 0)), F.col("height"))}, spans=spans)
    grown = E.increase(F.col("_last.balance"), F.col("_from"), F.col("_last.height"), F.col("height"))
    up = F.when(F.col("kind").isin(SETTLED, FINAL), grown).otherwise(E.wide(0))
    down = F.when(F.col("kind") == SETTLED, E.penalty(F.col("delta"))).otherwise(E.wide(0))
    made = clamp.prefixes(before.select("id", "height", "kind", "pos", "ends", "_piece", up.alias("up"), down.alias("down")), ["id"], ["height", "kind", "pos"], spans=spans)
    return staged(made.where(F.col("kind") >= ASKED).select("id", "kind", "pos", "ends", "f"), "functions")


def inherited(edges: DataFrame) -> DataFrame:
    """id and inherited of every heir. edges: id, heir, f; an energy is f of the capped sum of those that were handed on to id.

    A forest in rounds, as many as the logarithm of its longest chain and its branching ask for.
    """
    kinds = "ptr string, g " + clamp.KIND
    open_ = edges.groupBy(F.col("heir").alias("id")).agg(F.count("*").alias("open"))
    rest = staged(edges.join(open_, "id", "left").select("id", "heir", "f", E.wide(0).alias("acc"), F.coalesce("open", F.lit(0)).alias("open"), *(F.lit(None).cast(t).alias(n) for n, t in (x.split(" ", 1) for x in kinds.split(", ", 1)))), "rest")
    done = edges.where(F.lit(False)).select("id", "heir", E.wide(0).alias("v"))  # no rows, and no tasks
    last = done
    while not rest.isEmpty():
        came = last.groupBy(F.col("heir").alias("id")).agg(F.sum("v").cast(clamp.WIDE).alias("_sum"), F.count("*").alias("_n"))
        only = rest.groupBy(F.col("heir").alias("id")).agg(F.min("id").alias("_child"))
        known = rest.join(came, "id", "left").join(only, "id", "left")
        known = known.withColumns({"acc": (F.col("acc") + F.coalesce("_sum", E.wide(0))).cast(clamp.WIDE), "open": F.col("open") - F.coalesce("_n", F.lit(0))})
        new = (F.col("open") == 1) & F.col("ptr").isNull()
        known = known.withColumns({"g": F.when(new, clamp.shifted(F.col("f"), F.col("acc"))).otherwise(F.col("g")), "ptr": F.when(new, F.col("_child")).otherwise(F.col("ptr"))})
        over = rest.where("ptr is not null").select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("g").alias("_g"))
        known = known.join(done.select(F.col("id").alias("ptr"), F.col("v").alias("_v")), "ptr", "left").join(over, "ptr", "left")
        capped = F.least("acc", clamp.wide(clamp.U64_MAX))
        value = F.when(F.col("open") == 0, clamp.applied(F.col("f"), capped)).when(F.col("_v").isNotNull(), clamp.applied(F.col("g"), F.col("_v")))
        jump = F.col("_ptr").isNotNull()
        known = staged(known.select("id", "heir", "f", "acc", "open", F.when(jump, F.col("_ptr")).otherwise(F.col("ptr")).alias("ptr"), F.when(jump, clamp.composed(F.col("_g"), F.col("g"))).otherwise(F.col("g")).alias("g"), value.cast(clamp.WIDE).alias("v")), "rest")
        last = known.where("v is not null").select("id", "heir", "v")
        done = done.unionByName(last)
        rest = known.where("v is null").drop("v")
    return done.groupBy(F.col("heir").alias("id")).agg(F.least(F.sum("v").cast(clamp.WIDE), clamp.wide(clamp.U64_MAX)).alias("inherited"))


def run(events: DataFrame, strict_terminal_energy: bool = False, strict_prev: bool = False) -> DataFrame:
    """The event log of all passes, with the energy of each after the event.

    strict_terminal_energy: a burned pass keeps none. strict_prev: a mint that doesn't get all its predecessors is invalid as a whole.
    A change of a pass before its mint, or without one, and a second mint of a pass raise.
    """
    moves = staged(events.where("op <> 'balance'").withColumn("pos", _position()), "events")
    born = _born(moves)
    changes = staged(_changes(moves, born), "changes")
    held = passes(born, changes, strict_prev)
    functions = _functions(events, held, changes)
    finals = functions.where("ends").select("id", F.col("f").alias("_final"))
    edges = staged(held.where(F.col("heir").isNotNull() & F.col("cause").isin(REMINT, AWAY)).select("id", "heir").join(finals.withColumnRenamed("_final", "f"), "id"), "edges")
    asked = functions.where(F.col("kind") == ASKED).select("id", "pos", F.col("f").alias("_asked"))
    full = held.join(inherited(edges), "id", "left").join(finals, "id", "left")
    gained = F.coalesce("inherited", E.wide(0))
    full = staged(full.withColumn("gained", gained).withColumn("kept", clamp.applied(F.col("_final"), gained)).drop("_final", "inherited"), "full")

    nothing = F.lit(None).cast("string")

    def row(pos, step, place, kind, states, owners, satpoints, energy):
        of = [pos["height"], pos["rank"], pos["event_order"], pos["trigger"], F.lit(step), place.cast("int"), F.col("id"), F.lit(kind) if isinstance(kind, str) else kind, *states, *owners, *satpoints, energy.cast("decimal(20,0)")]
        return [c.alias(n) for c, n in zip(of, LOG)]

    text = F.lit
    valid = F.col("valid")
    mints = full.select(*row(F.col("born"), 1, F.lit(0), F.when(valid, "mint").otherwise("invalid_mint"), (nothing, F.when(valid, "active").otherwise("invalid")), (nothing, F.col("minter")), (nothing, F.col("mint_satpoint")), F.when(valid, F.col("gained"))))
    # Where a pass and its owner stood when another pass's mint changed it.
    marks = full.where(F.col("cause") == REMINT).select("id", F.col("end").alias("pos"), F.lit(0).alias("step"), F.lit(0).alias("place"), "minter", "mint_satpoint", "moved", F.col("kept").alias("energy"))
    marks = marks.unionByName(full.where("heir is not null").select("id", F.col("taken").alias("pos"), F.lit(2).alias("step"), "place", "minter", "mint_satpoint", "moved", E.wide(0).alias("energy")))
    stayed, marks = marks.where(_stayed()).drop("moved"), marks.where(~_stayed()).drop("moved")
    moved = changes.where("op = 'transfer'").select("id", "pos", F.struct("new_owner", "new_satpoint").alias("_new"))
    line = staged(marks.unionByName(moved, allowMissingColumns=True).withColumns({"height": F.col("pos.height"), "step": F.coalesce("step", F.lit(-1))}), "marks")
    stood = nearest(line, ["id"], ["height", "pos", "step"], {"_at": F.col("_new")}, spans=spanning(pieced(line), ["id"])).where("step >= 0").unionByName(stayed, allowMissingColumns=True)
    owner, place = F.coalesce("_at.new_owner", "minter"), F.when(F.col("_at").isNull(), F.col("mint_satpoint")).otherwise(F.col("_at.new_satpoint"))
    slept = stood.where("step = 0").select(*row(F.col("pos"), 0, F.col("place"), "state_update", (text("active"), text("dormant")), (owner, owner), (place, place), F.col("energy")))
    eaten = stood.where("step = 2").select(*row(F.col("pos"), 2, F.col("place"), "state_update", (text("dormant"), text("consumed")), (owner, owner), (place, place), F.col("energy")))

    of = changes.drop("minter").join(full.select("id", "valid", "end", "cause", "burnt", "taken", "gained", "kept"), "id").join(asked, ["id", "pos"], "left")
    past = lambda c: F.coalesce(F.col(c) < F.col("pos"), F.lit(False))
    leaves = F.coalesce((F.col("pos") == F.col("end")) & (F.col("cause") == AWAY), F.lit(False))
    state = F.when(past("burnt"), "burned").when(~valid, "invalid").when(past("taken"), "consumed").when(past("end") | leaves, "dormant").otherwise("active")
    of = of.withColumn("_state", state).withColumn("_leaves", leaves)
    live = F.when(F.col("_state") == "active", clamp.applied(F.col("_asked"), F.col("gained"))).otherwise(F.col("kept"))
    spent = E.wide(0) if strict_terminal_energy else F.when(F.col("taken") < F.col("burnt"), E.wide(0)).otherwise(F.col("kept"))
    burned = F.col("op") == "burn"
    energy = F.when(~valid, F.lit(None).cast(clamp.WIDE)).when((F.col("_state") == "burned") | (burned & F.lit(strict_terminal_energy)), spent).when(F.col("_state") == "consumed", E.wide(0)).otherwise(live)
    kind = F.when(burned, "state_update").when(F.col("prev_owner") == F.col("new_owner"), "satpoint_update").otherwise("owner_transfer")
    owners, satpoints = (F.col("prev_owner"), F.col("new_owner")), (F.col("prev_satpoint"), F.col("new_satpoint"))
    later = of.select(*row(F.col("pos"), 1, F.lit(0), kind, (F.col("_state"), F.when(burned, "burned").otherwise(F.col("_state"))), owners, satpoints, energy))
    left = of.where("_leaves").select(*row(F.col("pos"), 0, F.lit(0), "state_update", (text("active"), text("dormant")), (owners[0], owners[0]), (satpoints[0], satpoints[0]), F.col("kept")))
    return mints.unionByName(slept).unionByName(eaten).unionByName(later).unionByName(left)
