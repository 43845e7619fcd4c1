"""Recall of the permutation index against brute force on unit vectors without clusters.

    python -m tests.llm.measure_recall VECTORS [QUERIES]
"""

import os
import sys
import tempfile
import time

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from heightline.llm import permutation_index
from heightline.shipping import ship

SIZE = 64


def drawn(first: int, n: int) -> np.ndarray:
    x = np.random.default_rng(first).normal(size=(n, SIZE))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def main(n: int, asked: int = 40, block: int = 10_000) -> None:
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '8')}]").config("spark.sql.shuffle.partitions", "32").config("spark.driver.memory", "10g").config("spark.local.dir", scratch).config("spark.checkpoint.dir", f"file://{scratch}/shared").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for first in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + block)), pa.array(list(drawn(first, block)), pa.list_(pa.float32()))], ["vec_id", "embedding"])

    path = f"{scratch}/vectors"
    spark.range(0, n, block, 8).mapInArrow(rows, "vec_id long, embedding array<float>").write.parquet(path)
    vectors = spark.read.parquet(path)
    began = time.time()
    found = permutation_index.search(vectors, vectors.where(F.col("vec_id") % (n // asked) == 0)).collect()
    took = time.time() - began
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = np.concatenate([drawn(a, block) for a in range(0, n, block)]).astype(np.float64)
    hits = total = 0
    for q in got:
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argpartition(d, 10)[:10].tolist()) & got[q])
        total += 10
    print(f"recall {hits / total:.4f} of {n} vectors, {len(got)} queries, {took:.0f} s")


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))
