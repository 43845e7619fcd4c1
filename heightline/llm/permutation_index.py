"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of the data. Each vector is represented by the order of its nearest pivots and posted
in the inverted files of the first POSTED of them, with that order. A query reads the files of its own
nearest pivots, ranks what they hold by the footrule distance between the orders, and the best ranked are
ranked again by their true distance. The number of pivots grows with the square root of the number of
vectors, and the files that a query reads with the number of pivots, so that the share of vectors in its
reach does not shrink. A vector and a query that share several files meet in the first of the vector's
alone, so no pair is ranked or measured twice. Files are read in blocks of at most BLOCK vectors and QUERIES queries, so a file that holds a third
of all vectors is many tasks' work.

Equal vectors are one entry with its k + 1 smallest ids, which answers any query exactly as all would, and
equal queries are searched once.

Defined results: vectors and queries that are null, zero, of another dimension than most vectors, or that hold
null, NaN or infinite components take no part, nor do rows without id; an empty table gives an empty result. A repeated id counts once in a result, at its
smallest distance. Ties go to the smaller id. With fewer candidates than k all are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from heightline.llm.text import tidied
from heightline.staging import discard, staged

#: Pivots: this many times the square root of the number of vectors, within bounds.
PIVOTS_A_ROOT = 0.6
MOST_PIVOTS = 4096
LENGTH = 128
POSTED = 8
#: Files a query reads: this share of the pivots, and at least so many.
PROBED_SHARE = 0.12
PROBED = 16
#: Share of a file's block, and least number, that the footrule distance passes on to true distances.
KEPT_SHARE = 0.25
KEPT_LEAST = 512
BLOCK = 4096
QUERIES = 512
EVERY = 100


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id and v (doubles) of the rows whose vectors are sound."""
    v = F.col(column).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v")).where(sound)


def dimension(rows: DataFrame) -> int:
    """Components of most vectors, the fewest of equally many."""
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return common["d"] if common else 0


def orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest `length` pivots of each row, nearest first."""
    d = (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    near = np.argpartition(d, length - 1, axis=1)[:, :length] if length < len(pivots) else np.tile(np.arange(len(pivots)), (len(x), 1))
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1).astype(np.int16)


def footrule(query: np.ndarray, places: np.ndarray, rest: np.ndarray | int, length: int) -> np.ndarray:
    """Distance of one order to many. places[j, p]: place of pivot p in order j, or `length`; columns had best be contiguous.

    A pivot that one order lacks counts as standing at `length`; rest is what an order would cost if it
    shared no pivot with the query. A shared pivot costs the distance d of its two places in place of what
    both orders would pay for it alone, which leaves the query's place and twice what the other exceeds it by.
    """
    at = np.arange(len(query), dtype=places.dtype)
    over = places.T[query]
    over -= at[:, None]
    np.maximum(over, 0, out=over)
    return 2 * over.sum(0, dtype=np.int32) + at.sum(dtype=np.int32) + rest - length * len(query)


def stored_as(*tables: DataFrame, column: str) -> type:
    """The narrowest type that holds the components of all tables exactly."""
    return np.float32 if all(df.schema[column].dataType == ArrayType(FloatType(), df.schema[column].dataType.containsNull) for df in tables) else np.float64


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found of each query."""
    spark = vectors.sparkSession
    exact = stored_as(vectors, queries, column=column)
    sound = staged(usable(vectors, key, column), "vectors")
    alike = F.size("v") == dimension(sound)
    data, asked = sound.where(alike), usable(queries, key, column).where(alike).distinct()
    first = data.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= k + 1)
    entries = staged(first.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")), "entries")
    discard(sound)
    n = entries.count()
    count = min(MOST_PIVOTS, n, max(16, int(PIVOTS_A_ROOT * math.sqrt(n))))
    chosen = entries.select("v", F.xxhash64(F.lit(3), "v").alias("_h")).orderBy("_h", "v").limit(max(count, 1)).select("v").collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not chosen:
        return spark.createDataFrame([], out)
    pivots = spark.sparkContext.broadcast(np.array([r["v"] for r in chosen]))
    length, posted, probed = min(LENGTH, count), min(POSTED, count), min(count, max(PROBED, math.ceil(PROBED_SHARE * count)))

    def ordered(taken: int):
        @tidied
        def run(batches):
            for batch in batches:
                d = pivots.value.shape[1]
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                got = orders(x, pivots.value, max(length, taken))
                rows = np.repeat(np.arange(len(x)), taken)
                raw = [a.tobytes() for a in got]
                vectors_ = [a.tobytes() for a in x.astype(exact)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(got[:, :taken].reshape(-1).astype(np.int32)), batch.column("ids").take(pa.array(rows)), pa.array(raw, pa.binary()).take(pa.array(rows)), pa.array(vectors_, pa.binary()).take(pa.array(rows))],
                    ["pivot", "ids", "perm", "vec"],
                )

        return run

    kind = "pivot int, ids array<long>, perm binary, vec binary"
    files = entries.select("v", "ids").mapInArrow(ordered(posted), kind)
    heads = staged(asked.groupBy("v").agg(F.min("id").alias("id")), "heads")  # joins with it can split a vector of many queries
    probes = heads.select("v", F.array("id").alias("ids")).mapInArrow(ordered(probed), kind)
    files, probes = staged(files, "files"), staged(probes, "probes")

    # Blocks of a file meet blocks of its queries; at most MOST_PIVOTS counts of each.
    sizes = files.groupBy("pivot").agg(F.count("*").alias("_n")).join(probes.groupBy("pivot").agg(F.count("*").alias("_q")), "pivot")
    sizes = F.broadcast(sizes.select("pivot", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_b"), F.ceil(F.col("_q") / QUERIES).cast("int").alias("_c")))
    salt = lambda parts: F.pmod(F.xxhash64("vec"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    held = files.join(sizes, "pivot").withColumn("_x", salt("_b")).select("pivot", "_x", each("_c").alias("_y"), F.lit(0).alias("side"), "ids", "perm", "vec")
    wanted = probes.join(sizes, "pivot").withColumn("_y", salt("_c")).select("pivot", each("_b").alias("_x"), "_y", F.lit(1).alias("side"), "ids", "perm", "vec")

    def meet(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        mine, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        q, v, s = [], [], []
        if len(mine) and len(theirs):
            unpack = lambda c, rows, kind: np.frombuffer(b"".join(table.column(c).take(pa.array(rows)).to_pylist()), kind).reshape(len(rows), -1)
            ids = table.column("ids").to_pylist()
            perm, wanted_perm = unpack("perm", mine, np.int16).astype(np.int64), unpack("perm", theirs, np.int16).astype(np.int64)
            base, x = unpack("vec", mine, exact).astype(np.float64), unpack("vec", theirs, exact).astype(np.float64)
            places = np.full((len(pivots.value), len(mine)), length, np.int16).T
            places[np.arange(len(mine))[:, None], perm[:, :length]] = np.arange(length, dtype=np.int16)[None, :]
            rest = length * (length + 1) // 2
            files_of = perm[:, :posted]
            ahead = np.arange(posted)[None, :] < places[:, table.column("pivot")[0].as_py()][:, None]
            for j in range(len(theirs)):
                read = np.zeros(len(pivots.value), bool)
                read[wanted_perm[j, :probed]] = True
                here = np.flatnonzero(~(read[files_of] & ahead).any(1))
                keep = min(len(here), max(KEPT_LEAST, math.ceil(KEPT_SHARE * len(mine))))
                if not keep:
                    continue
                near = footrule(wanted_perm[j, :length], places, rest, length)[here]
                top = here[np.argpartition(near, keep - 1)[:keep]] if keep < len(here) else here
                d = np.sqrt(((base[top] - x[j]) ** 2).sum(1))
                best = np.lexsort((top, d))
                cut = best[d[best] <= d[best[min(k, len(best) - 1)]]]  # the k + 1 nearest and what ties with the last
                for t in cut.tolist():
                    for i in ids[mine[top[t]]]:
                        q.append(ids[theirs[j]][0])
                        v.append(i)
                        s.append(float(d[t]))
        return pa.table({"query": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    found = held.unionByName(wanted).groupBy("pivot", "_x", "_y").applyInArrow(meet, "query long, vec_id long, score double")
    top = Window.partitionBy("query").orderBy("score", "vec_id")
    merged = found.groupBy("query", "vec_id").agg(F.min("score").alias("score")).withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k + 1)
    merged = staged(merged.drop("_r"), "merged")
    discard(files, probes, entries)
    own = asked.join(heads.select("v", F.col("id").alias("query")), "v").select(F.col("id").alias("query_id"), "query")
    answers = own.join(merged, "query").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % EVERY == 0))
