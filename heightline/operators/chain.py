"""Chains of blocks: linking, reorganisation, rollback, differences between sources, satoshi positions."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heightline.operators.validation import RequestError
from heightline.staging import discard, staged

ZERO_HASH = "0" * 64


def linearize(headers: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """Heights of blocks (block_hash, prev_hash) reached from the zero hash.

    The chain is walked by pointer doubling: each round doubles the steps that every block knows towards
    the origin, so the number of rounds is logarithmic in the length. Blocks that have reached the origin are
    set aside, each round is staged, and blocks that lead nowhere else are left out. canonical (height,
    block_hash) decides between forks.
    """
    steps = staged(headers.select("block_hash", F.col("prev_hash").alias("to"), F.lit(1).cast("bigint").alias("n")), "steps")
    rooted = F.col("to") == ZERO_HASH
    for _ in range(64):  # more only where blocks form a ring
        far = steps.select(F.col("block_hash").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"))
        moved = steps.where(~rooted).join(far, "to").select("block_hash", F.col("_to").alias("to"), (F.col("n") + F.col("_n")).alias("n"))
        last, steps = steps, staged(steps.where(rooted).unionByName(moved), "steps")
        discard(last)
        if steps.where(~rooted).isEmpty():
            break
    found = steps.where(rooted).select((F.col("n") - 1).alias("height"), "block_hash")
    if canonical is not None:
        named = canonical.select("height", F.col("block_hash").alias("_c"))
        found = found.join(named, "height", "left").where(F.col("_c").isNull() | (F.col("_c") == F.col("block_hash"))).drop("_c")
    return found


def broken_links(blocks: DataFrame) -> DataFrame:
    """Blocks whose parent is not the block below them; adjacent heights meet by an equi join."""
    below = blocks.select((F.col("height") + 1).alias("height"), F.col("block_hash").alias("_below"))
    low = blocks.agg(F.min("height").alias("_low"))
    return blocks.join(below, "height", "left").join(F.broadcast(low)).where((F.col("height") > F.col("_low")) & ~F.col("_below").eqNullSafe(F.col("prev_hash"))).select("height", "block_hash")


def common_ancestor(ours: DataFrame, theirs: DataFrame, default: int = 0) -> DataFrame:
    """The highest height at which both have the same hash."""
    same = ours.join(theirs.select("height", F.col("block_hash").alias("_h")), "height").where(F.col("block_hash") == F.col("_h"))
    return same.agg(F.coalesce(F.max("height"), F.lit(default).cast("bigint")).alias("ancestor_height"))


def rolled_back(rows: DataFrame, ancestor: int, column: str = "height") -> DataFrame:
    return rows.where(F.col(column) <= ancestor)


def upstream_drift(local: DataFrame, upstream: DataFrame, genesis: int) -> DataFrame:
    """One row: reasons why the local state no longer follows its source, and the height to roll back to.

    Both sides have a row for each height: height, block_hash, commit. Judged at the highest local height:
    `height_regressed` if the source ends below it, `anchor_drifted` if the source ends there with another hash,
    `commit_missing` or `commit_drifted` from genesis on. The target is the highest height with the same hash
    and commit on both sides; it is the one before genesis if there is none, or if a local row is missing above
    it. Without reasons, and without local rows, reasons is empty and the target null.
    """
    tip = local.agg(F.max("height").alias("_tip"))
    end = upstream.agg(F.max("height").alias("_end"))
    theirs = upstream.select("height", F.col("block_hash").alias("_hash"), F.col("commit").alias("_commit"), F.lit(True).alias("_there"))
    ours = local.select("height", "block_hash", "commit").join(theirs, "height", "left").join(F.broadcast(tip)).join(F.broadcast(end))  # one row each
    reachable = (F.col("height") >= genesis) & (F.col("height") <= F.least("_tip", F.coalesce("_end", F.lit(genesis - 1))))
    same_hash, same_commit = F.col("block_hash").eqNullSafe(F.col("_hash")), F.col("commit").eqNullSafe(F.col("_commit"))
    shared = reachable & F.col("_there").isNotNull() & same_hash & same_commit
    found = ours.agg(
        F.max("_tip").alias("tip"), F.max("_end").alias("end"), F.max_by(F.struct(F.coalesce("_there", F.lit(False)).alias("there"), same_hash.alias("hash"), same_commit.alias("commit")), "height").alias("at"),
        F.max(F.when(shared, F.col("height"))).alias("last"),
    )
    search = F.least("tip", "end")
    above = ours.where(reachable).select("height").distinct().join(F.broadcast(found.select("last"))).where("height > last").agg(F.count("*").alias("_above"))
    whole = F.col("_above") == search - F.col("last")
    owes = F.col("tip") >= genesis
    tests = [
        F.when(F.col("end").isNull() | (F.col("tip") > F.col("end")), "height_regressed"), F.when((F.col("tip") == F.col("end")) & ~F.col("at.hash"), "anchor_drifted"),
        F.when(owes & ~F.col("at.there"), "commit_missing"), F.when(owes & F.col("at.there") & ~F.col("at.commit"), "commit_drifted"),
    ]
    named = F.when(F.col("tip").isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*tests)))
    target = F.when(F.size("reasons") > 0, F.when(whole, F.col("last")).otherwise(F.lit(genesis - 1)))
    return found.join(F.broadcast(above)).withColumn("reasons", named).select("tip", F.col("end").alias("upstream_tip"), "reasons", target.cast("bigint").alias("rollback_to"))


def check_rollback(tip: int, ancestor: int, retention: int) -> None:
    """Refuses a rollback beyond the undo window before anything is changed."""
    if tip - ancestor > retention:
        raise RequestError("ROLLBACK_BEYOND_RETENTION", f"{tip} to {ancestor}")


def source_difference(primary: DataFrame, shadow: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Ids that only one source has, and those whose content differs."""
    a = primary.select(key, F.struct(*columns).alias("_a"))
    b = shadow.select(key, F.struct(*columns).alias("_b"))
    kind = F.when(F.col("_b").isNull(), "only_primary").when(F.col("_a").isNull(), "only_shadow").otherwise("content_mismatch")
    return a.join(b, key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, kind.alias("difference"))


def missing_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).exceptAll(right.select(key))


def ids_apart(primary: DataFrame, shadow: DataFrame, key: str) -> DataFrame:
    """Ids that one of two sources has more often than the other, as often as it does, and which one that is."""
    parts = {"primary": missing_ids(primary, shadow, key), "shadow": missing_ids(shadow, primary, key)}
    return parts["primary"].withColumn("only", F.lit("primary")).unionByName(parts["shadow"].withColumn("only", F.lit("shadow")))


def sat_positions(inputs: DataFrame, outputs: DataFrame, sats: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Output of a transaction that a satoshi of one of its inputs moves to.

    inputs: txid, input_index, value; outputs: txid, vout, value; sats: txid, input_index, offset and
    others. A position past all outputs went to the fee: vout and new_offset are null. also:
    other columns of outputs to give, by names that sats hasn't.
    """
    before = Window.partitionBy("txid").orderBy("input_index").rowsBetween(Window.unboundedPreceding, -1)
    starts = inputs.select("txid", "input_index", F.coalesce(F.sum("value").over(before), F.lit(0)).alias("_start"))
    upto = Window.partitionBy("txid").orderBy("vout").rowsBetween(Window.unboundedPreceding, 0)
    spans = outputs.withColumn("_to", F.sum("value").over(upto)).select("txid", "vout", (F.col("_to") - F.col("value")).alias("_from"), "_to", *also)
    placed = sats.join(starts, ["txid", "input_index"]).withColumn("position", F.col("_start") + F.col("offset")).drop("_start")
    where = (placed["txid"] == spans["txid"]) & (F.col("position") >= F.col("_from")) & (F.col("position") < F.col("_to"))
    return placed.join(spans, where, "left").select(placed["*"], "vout", (F.col("position") - F.col("_from")).alias("new_offset"), *also)


def tracked_moves(inputs: DataFrame, outputs: DataFrame, tracked: DataFrame) -> DataFrame:
    """Every move of tracked passes through a batch of blocks, also several within one block.

    inputs: height, tx_index, txid, input_index, prev_txid, prev_vout, value; outputs: txid, vout, value, owner
    (null where the script has no address); tracked: inscription_id, owner, txid, vout, offset. An outpoint is
    spent once, so each round joins the outputs that passes lie on with the inputs that spend them and places
    the satoshis again, until none moves. A round reads only the transactions that it touches and is staged;
    there are as many as the longest way of one pass through the batch.

    hop counts a pass's moves from 1. kind: `transfer` (same_owner says whether it came back), `burn` for an
    output without address, `fee` past all outputs (vout null); after the last two a pass is tracked no more.
    Several passes may share an outpoint. Repeated rows of tracked count once, and rows with a null outpoint or
    offset never move.
    """
    ends = inputs.select("height", "tx_index", "txid", "input_index", F.col("prev_txid").alias("_txid"), F.col("prev_vout").alias("_vout"))
    made = outputs.select("txid", "vout", "value", F.col("owner").alias("new_owner"))
    names = ["inscription_id", "owner", "txid", "vout", "offset"]
    lying = tracked.select(names).distinct()
    kind = F.when(F.col("vout").isNull(), "fee").when(F.col("new_owner").isNull(), "burn").otherwise("transfer")
    found = None
    for hop in count(1):
        at = lying.select("inscription_id", F.col("owner").alias("prev_owner"), F.col("txid").alias("_txid"), F.col("vout").alias("_vout"), "offset")
        spent = staged(at.join(ends, ["_txid", "_vout"]), "spent")
        touched = spent.select("txid").distinct()
        placed = sat_positions(inputs.join(touched, "txid", "left_semi"), made.join(touched, "txid", "left_semi"), spent, ("new_owner",))
        moved = placed.select(
            "inscription_id", F.lit(hop).alias("hop"), "height", "tx_index", "input_index", kind.alias("kind"), "prev_owner", "new_owner", F.coalesce(F.col("prev_owner") == F.col("new_owner"), F.lit(False)).alias("same_owner"),
            F.col("_txid").alias("prev_txid"), F.col("_vout").alias("prev_vout"), F.col("offset").alias("prev_offset"), "txid", "vout", F.col("new_offset").alias("offset"),
        )
        step = staged(moved, "moved")
        discard(spent)
        found = step if found is None else found.unionByName(step)
        if step.isEmpty():
            return found
        lying = step.where("kind = 'transfer'").withColumn("owner", F.col("new_owner")).select(names)


def tracked_after(tracked: DataFrame, moves: DataFrame) -> DataFrame:
    """Where tracked passes lie behind a batch; the ones burned or lost to fees are gone."""
    last = moves.groupBy("inscription_id").agg(F.max_by(F.struct("kind", F.col("new_owner").alias("owner"), "txid", "vout", "offset"), "hop").alias("_m"))
    stayed = tracked.select("inscription_id", "owner", "txid", "vout", "offset").distinct().join(last, "inscription_id", "left_anti")
    return stayed.unionByName(last.where("_m.kind = 'transfer'").select("inscription_id", "_m.owner", "_m.txid", "_m.vout", "_m.offset"))
