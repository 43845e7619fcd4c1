"""Sharding by a hypergeometric communication matrix.

The rows of the input lie in numbered blocks. The counts of rows that each block sends to each shard are
drawn from the multivariate hypergeometric distribution, so that shard sizes come out exact (law `rows`:
at most one apart) and the whole is a uniform shuffle. Each block permutes its rows locally by a seeded
permutation that is cut by those counts; one exchange takes the rows to buckets of their shard, and each
bucket is permuted again by random keys, which gives slots.

A row is known by its file and its index there, so a lost task repeats its draw exactly. The driver holds
blocks x shards counts with at most MOST_BLOCKS blocks; it never holds rows.

Defined results: null texts have no bytes; repeated rows are rows of their own; an empty table gives an
empty result; there are no groups, for equal texts are spread as all rows are.
"""

from __future__ import annotations

import math
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heightline.llm.columns import others
from heightline.staging import shared_dir

SHARDS = 24
BLOCK_ROWS = 1 << 16
MOST_BLOCKS = 1 << 16
BUCKET_ROWS = 8192
#: Up to so many files their row offsets are broadcast (about 200 bytes each).
BROADCAST_FILES = 50_000
_NUMPY_LIMIT = 10**9 - 1


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among `drawn` out of good + bad, without replacement.

    Beyond numpy's limit the distribution is inverted from its mode outwards, with log-gamma for the
    probability of the mode.
    """
    if not drawn or not good:
        return 0
    if not bad:
        return drawn
    if good + bad <= _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    up = down = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    u = rng.random() - up
    a = b = mode
    while u > 0 and (a > low or b < high):
        if b < high:
            up *= (good - b) * (drawn - b) / ((b + 1) * (bad - drawn + b + 1))
            b += 1
            u -= up
            if u <= 0:
                return b
        if a > low:
            down *= a * (bad - drawn + a) / ((good - a + 1) * (drawn - a + 1))
            a -= 1
            u -= down
            if u <= 0:
                return a
        if max(up, down) < 1e-300:
            break
    return mode


def communication_matrix(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each block sends to each shard; columns add up to sizes at most one apart."""
    total = sum(blocks)
    rng = np.random.default_rng([seed, total, shards])
    left = [total // shards + (j < total % shards) for j in range(shards)]
    out = np.zeros((len(blocks), shards), np.int64)
    for i, rows in enumerate(blocks):
        rest = sum(left)
        for j in range(shards):
            if not rows:
                break
            rest -= left[j]
            n = hypergeometric(rng, left[j], rest, rows) if rest else rows
            out[i, j] = n
            left[j] -= n
            rows -= n
    return out


@lru_cache(4)
def permuted(counts: bytes, seed: int, block: int) -> np.ndarray:
    """Shard of each row of a block: its share of every shard in a seeded random order."""
    own = np.frombuffer(counts, np.int32)
    return np.random.default_rng([seed, block]).permutation(np.repeat(np.arange(len(own), dtype=np.int32), own))


def shard_files(spark: SparkSession, path: str, columns: list[str], shards: int = SHARDS, seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of the Parquet files at path with shard, and slot gapless from 0 in each shard."""
    rows = spark.read.parquet(path).select(F.struct(*others(columns, "shard", "slot")).alias("row"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    per_file = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    files = per_file.collect()  # one number a file
    files.sort(key=lambda r: r["_file"])
    ends = np.cumsum([0, *(r["_n"] for r in files)])
    total = int(ends[-1])
    width = max(BLOCK_ROWS, -(-total // MOST_BLOCKS))
    counts = [min(width, total - a) for a in range(0, total, width)]
    matrix = spark.sparkContext.broadcast(communication_matrix(counts, shards, seed).astype(np.int32))
    offsets = spark.createDataFrame([(r["_file"], int(e)) for r, e in zip(files, ends)], "_file string, _before long")
    if len(files) <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)

    @F.pandas_udf("int")
    def label(at: pd.Series) -> pd.Series:
        block, place = np.divmod(at.to_numpy(), width)
        out = np.empty(len(at), np.int32)
        for b in np.unique(block):
            mine = block == b
            out[mine] = permuted(matrix.value[b].tobytes(), seed, int(b))[place[mine]]
        return pd.Series(out)

    buckets = max(1, -(-total // (shards * bucket_rows)))
    at = rows.join(offsets, "_file").withColumn("_at", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")
    keyed = at.withColumns({"shard": label("_at"), "_key": F.xxhash64(F.lit(seed), "_at")}).withColumn("_bucket", F.pmod(F.shiftrightunsigned("_key", 16), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("shard", "_bucket").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_start", F.sum("_size").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "_bucket", F.coalesce("_start", F.lit(0)).alias("_start"))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_key", "_at")))
    return ranked.join(before, ["shard", "_bucket"]).withColumn("slot", (F.col("_start") + F.col("_rank") - 1).cast("long")).select("row.*", "shard", "slot")


def shard_frame(df: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """As shard_files for any frame, which is written in the shared folder first."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/to-shard-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return shard_files(spark, path, df.columns, shards, seed)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_files(spark, f"{sf_dir}/documents.parquet", ["doc_id", "text"])
    return rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
