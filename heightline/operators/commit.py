"""Hash-chained commitments and state identities."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from heightline.functions import binary as B
from heightline.staging import extended, staged

# Domain tags and versions that are part of the hashed bytes.
ROOT_TAG = "balance-history:block-delta-root:v1"
COMMIT_TAG = "balance-history:block-commit:v1"
PASS_VERSION = "1.0.0"


#: Chains are folded over so many heights at a time.
HEIGHTS = 65_536


def _digests(heads: DataFrame, entries: DataFrame, order: list[str], kept: list[str], name: str, bare: bool) -> DataFrame:
    """kept and the SHA-256 of each head's bytes followed by those of the entries of its height, in order.

    heads: height, kept and _h; entries: height, order and _e. The entries of a height come as a stream, so
    one of any size takes no more memory than others. An entry without bytes leaves the head alone if bare,
    and else no digest.
    """
    nothing = [F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in order]
    first = heads.select("height", F.lit(0).alias("_k"), *nothing, F.col("_h").alias("_e"), F.struct(*kept).alias("_kept"))
    rows = first.unionByName(entries.where("height is not null").select("height", F.lit(1).alias("_k"), *order, "_e"), allowMissingColumns=True)
    rows = rows.repartition("height").sortWithinPartitions("height", "_k", *order, "_e").select("height", "_k", "_e", "_kept")
    kind = heads.select(*kept).schema

    def run(batches):
        at, held = None, []  # of each head: kept, the head's bytes and the running hash

        def out():
            hashes = [h.hexdigest() if h else hashlib.sha256(x).hexdigest() if bare and x is not None else None for _, x, h in held]
            columns = [pa.array([k[c] for k, _, _ in held], to_arrow_type(kind[c].dataType)) for c in kept]
            return pa.RecordBatch.from_arrays([*columns, pa.array(hashes, pa.string())], [*kept, name])

        for batch in batches:
            heights, entry = batch.column(0).fill_null(-1).to_numpy(), batch.column(1).to_numpy() == 1
            e = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(e.buffers()[1], np.int64)[e.offset : e.offset + len(e) + 1]
            data, lost = memoryview(e.buffers()[2] or b""), e.is_null().to_numpy(zero_copy_only=False)
            # Runs of entries of one height are one update; heads stand alone.
            edges = np.flatnonzero((heights[1:] != heights[:-1]) | ~entry[1:] | ~entry[:-1]) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(heights)]):
                height = heights[a]
                if not entry[a]:
                    if held and height != at:
                        yield out()
                        held = []
                    at, own = height, e[a].as_py()
                    held.append([batch.column(3)[a].as_py(), own, None if own is None else hashlib.sha256(own)])
                elif held and height == at:
                    for one in held:
                        if lost[a:b].any():
                            one[2] = None
                        elif one[2]:
                            one[2].update(data[offsets[a] : offsets[b]])
        if held:
            yield out()

    return rows.mapInArrow(run, extended(heads.select(*kept), f"`{name}` string"))


def delta_roots(blocks: DataFrame, ledger: DataFrame) -> DataFrame:
    """height, block_hash and balance_delta_root; ledger: script_hash, height, delta, balance."""
    entry = F.concat(F.unhex("script_hash"), B.be32(F.col("height")), B.be64(F.col("delta")), B.be64_unsigned(F.col("balance")))
    head = F.concat(B.utf8(ROOT_TAG), B.be32(F.col("height")), B.hash_bytes(F.col("block_hash")))
    rows = ledger.select("height", "script_hash", entry.alias("_e"))
    return _digests(blocks.select("height", "block_hash", head.alias("_h")), rows, ["script_hash"], ["height", "block_hash"], "balance_delta_root", True)


def _chained(rows: DataFrame, seed: str, before: Column, after: Column, text: bool, carried: list[str]) -> DataFrame:
    """Links rows in order of height: the SHA-256 of before, the last link (as text or bytes) and after.

    Spans of at most HEIGHTS heights are linked one after the other, each staged and seeded by the one before.
    """
    rows = staged(rows.select("height", *carried, before.alias("_b"), after.alias("_a")), "links")
    span = F.floor(F.col("height") / HEIGHTS)
    spans = sorted((r[0] for r in rows.select(span).distinct().collect()), key=lambda x: (x is not None, x or 0))
    kept = ["height", *carried]
    kind = extended(rows.select(*kept), "block_commit string, _n long")

    def linked(last):
        def run(batches):
            now, n = last, 0
            for batch in batches:
                made = []
                for b, a in zip(batch.column("_b").to_pylist(), batch.column("_a").to_pylist()):
                    whole = None not in (now, b, a)
                    now = hashlib.sha256(b + (now.encode() if text else bytes.fromhex(now)) + a).hexdigest() if whole else None
                    made.append(now)
                at = pa.array(range(n, n + len(made)), pa.int64())
                n += len(made)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, pa.string()), at], [*kept, "block_commit", "_n"])

        return run

    parts, last = [], seed
    for x in spans:
        own = rows.where(F.col("height").isNull() if x is None else F.col("height").between(x * HEIGHTS, (x + 1) * HEIGHTS - 1))
        part = staged(own.repartition(1).sortWithinPartitions(*kept).mapInArrow(linked(last), kind), "chain")
        last = part.orderBy(F.desc("_n")).first()["block_commit"]
        parts.append(part.drop("_n"))
    return reduce(DataFrame.unionByName, parts) if parts else rows.select(*kept, F.lit(None).cast("string").alias("block_commit"))


def block_commits(roots: DataFrame, previous: str = "0" * 64) -> DataFrame:
    """Chain of blocks, from the commit before them."""
    before = F.concat(B.utf8(COMMIT_TAG), B.be32(F.col("height")), B.hash_bytes(F.col("block_hash")), F.unhex("balance_delta_root"))
    return _chained(roots, previous, before, F.lit(b""), False, ["block_hash", "balance_delta_root"])


def mutation_roots(mutations: DataFrame) -> DataFrame:
    """mutations: height, position, json (fields in their fixed order)."""
    bar = B.utf8("|")
    head = F.concat(B.utf8(PASS_VERSION), bar, B.be32(F.col("height")), bar, B.be32(F.col("_n")))
    heads = mutations.groupBy("height").agg(F.count("*").cast("int").alias("_n")).select("height", head.alias("_h"))
    rows = mutations.select("height", "position", "json", F.concat(bar, B.prefixed(F.col("json"))).alias("_e"))
    return _digests(heads, rows, ["position", "json"], ["height"], "mutation_root", False)


def pass_commits(roots: DataFrame, upstream: DataFrame, previous: str = "genesis") -> DataFrame:
    """Chain of pass commits, each anchored at the upstream commit of its own height."""
    bar = B.utf8("|")
    joined = roots.join(upstream.select("height", F.col("block_commit").alias("upstream_commit")), "height")
    before = F.concat(B.utf8(PASS_VERSION), bar, B.be32(F.col("height")), bar)
    after = F.concat(bar, B.be32(F.col("height")), bar, B.utf8(F.col("upstream_commit")), bar, B.utf8(F.col("mutation_root")))
    return _chained(joined, previous, before, after, True, ["upstream_commit", "mutation_root"])


def snapshot_id(version: str, c: dict[str, Column]) -> Column:
    text = ("api_version", "semantics_version", "index_formula_version", "index_protocol_version")
    return B.sha256_hex(F.concat(B.prefixed(version), B.prefixed(c["source_chain"]), B.prefixed(c["network"]), B.be32(c["stable_height"]), B.prefixed(c["stable_block_hash"]), B.be32(c["stable_lag"]), *(B.prefixed(c[t]) for t in text)))


def local_state_commit(version: str, c: dict[str, Column]) -> Column:
    """c: snapshot_id, height, protocol_version, and the structs pass_commit and balance_snapshot or nulls."""
    p, b = c["pass_commit"], c["balance_snapshot"]
    nothing = F.lit(b"")
    passed = F.when(p.isNull(), nothing).otherwise(F.concat(B.be32(p["block_height"]), B.prefixed(p["block_commit"]), B.prefixed(p["commit_protocol_version"]), B.prefixed(p["commit_hash_algo"])))
    active = F.when(b.isNull(), nothing).otherwise(F.concat(B.be32(b["block_height"]), B.be64_unsigned(b["total_balance"]), B.be32(b["active_address_count"])))
    return B.sha256_hex(F.concat(B.prefixed(version), B.prefixed(c["snapshot_id"]), B.be32(c["height"]), B.marker(p.isNotNull()), passed, B.marker(b.isNotNull()), active, B.prefixed(c["protocol_version"])))


def system_state_id(version: str, snapshot: Column, local: Column) -> Column:
    return B.sha256_hex(F.concat(B.prefixed(version), B.prefixed(snapshot), B.prefixed(local)))


def commit_at(commits: DataFrame, height: int) -> DataFrame:
    """The latest commit at or before a height."""
    return commits.where(F.col("height") <= height).agg(F.max_by(F.struct(*commits.columns), "height").alias("r")).where("r is not null").select("r.*")
