import zlib
from collections import Counter

import numpy as np
import pytest

from heightline.llm import sharding


def test_contract(spark, table, edge_rows):
    found = sharding.op3_sharding(spark, table(edge_rows)).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in edge_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}
    sizes = Counter(r["shard"] for r in found)
    assert set(sizes) <= set(range(24)) and max(sizes.values()) - min(sizes.get(j, 0) for j in range(24)) <= 1
    for j, n in sizes.items():
        assert sorted(r["slot"] for r in found if r["shard"] == j) == list(range(n))


def test_same_draw_each_time(spark, sf_dir):
    a, b = (sorted(map(tuple, sharding.op3_sharding(spark, sf_dir).select("doc_id", "shard", "slot").collect())) for _ in range(2))
    assert a == b


def test_many_buckets_and_columns(spark, clashing):
    found = sharding.shard_frame(clashing, 3, seed=5)
    assert found.columns == [c for c in clashing.columns if c.lower() not in ("shard", "slot")] + ["shard", "slot"]
    assert Counter(found.toPandas()["shard"]) == {0: 4, 1: 4, 2: 4}


def test_slots_over_buckets(spark, sf_dir):
    found = sharding.shard_files(spark, f"{sf_dir}/documents.parquet", ["doc_id"], 4, bucket_rows=8).toPandas()
    for _, own in found.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_empty_table(spark, table):
    assert sharding.op3_sharding(spark, table([])).collect() == []


def test_matrix_sums():
    blocks = [1000, 7, 0, 333]
    m = sharding.communication_matrix(blocks, 7, 3)
    assert m.sum(1).tolist() == blocks and m.sum(0).max() - m.sum(0).min() <= 1


@pytest.mark.parametrize("limit", [10**9, 0])
def test_hypergeometric_moments(monkeypatch, limit):
    monkeypatch.setattr(sharding, "_NUMPY_LIMIT", limit)
    rng = np.random.default_rng(2)
    x = np.array([sharding.hypergeometric(rng, 30, 70, 40) for _ in range(4000)])
    assert abs(x.mean() - 12) < 0.15 and abs(x.var() - 40 * 0.3 * 0.7 * 60 / 99) < 0.4
    assert x.min() >= 0 and x.max() <= 30


def test_shuffle_is_uniform(spark, tmp_path):
    spark.range(4000).repartition(4).write.parquet(str(tmp_path / "r"))
    found = sharding.shard_files(spark, str(tmp_path / "r"), ["id"], 4).toPandas()
    low = found[found.id < 1000].shard.value_counts()
    assert (abs(low - 250) < 70).all()
    assert abs(np.corrcoef(found.id, found.slot)[0, 1]) < 0.08
