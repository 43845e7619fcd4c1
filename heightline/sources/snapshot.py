"""Snapshots as directories of Parquet tables with a manifest, installed by renaming."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heightline.operators import temporal
from heightline.operators.validation import RequestError

SHARDS = 256
VERSION = 2


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def export(spark: SparkSession, path: str, ledger: DataFrame, commits: DataFrame, registry: DataFrame, height: int, utxo: DataFrame | None = None, tip: int | None = None, shards: int = SHARDS) -> dict:
    """Positive balances as of a height, commits up to it and the registry. Live outputs only at the tip."""
    if utxo is not None and tip is not None and height != tip:
        raise RequestError("UTXO_EXPORT_NOT_AT_TIP", f"{height} != {tip}")
    tables = {"balance_history": temporal.holders_at(ledger, height), "block_commits": commits.where(F.col("height") <= height), "script_registry": registry}
    if utxo is not None:
        tables["utxos"] = utxo
    counts = {}
    for name, rows in tables.items():
        key = "account" if "account" in rows.columns else rows.columns[0]
        rows.repartition(shards, F.pmod(F.xxhash64(key), F.lit(shards))).sortWithinPartitions(key).write.mode("errorifexists").parquet(f"{path}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{name}").count()
    manifest = {"version": VERSION, "height": height, "counts": counts, "digests": {n: content_digest(spark.read.parquet(f"{path}/{n}")) for n in counts}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")
    return manifest


def content_digest(rows: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order or files."""
    own = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    halves = [F.conv(F.substring(own, i, 15), 16, 10).cast("decimal(38,0)") for i in (1, 16, 31)]
    sums = rows.agg(F.count("*"), *(F.sum(h) for h in halves)).first()
    return hashlib.sha256("|".join(map(str, sums)).encode()).hexdigest()


def described(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def verify(spark: SparkSession, path: str) -> dict:
    manifest = described(spark, path)
    if manifest["version"] != VERSION:
        raise RequestError("SNAPSHOT_VERSION", str(manifest["version"]))
    for name, digest in manifest["digests"].items():
        rows = spark.read.parquet(f"{path}/{name}")
        if rows.count() != manifest["counts"][name] or content_digest(rows) != digest:
            raise RequestError("SNAPSHOT_DIGEST_MISMATCH", name)
    return manifest


def install(spark: SparkSession, staged: str, live: str, trust: str = "manifest") -> dict:
    """Checks a staged snapshot, then swaps it in by renaming; what was live is kept beside it."""
    manifest = verify(spark, staged) if trust != "dev" else described(spark, staged)
    source, fs = _hadoop(spark, staged)
    target, _ = _hadoop(spark, live)
    if fs.exists(target):
        old, _ = _hadoop(spark, f"{live}.previous")
        if fs.exists(old):
            fs.delete(old, True)
        fs.rename(target, old)
    if not fs.rename(source, target):
        if not fs.exists(target) and fs.exists(_hadoop(spark, f"{live}.previous")[0]):
            fs.rename(_hadoop(spark, f"{live}.previous")[0], target)  # what was live is live again
        raise RequestError("SNAPSHOT_INSTALL_FAILED", live)
    return manifest | {"provenance": {"source": staged, "trust": trust}}
