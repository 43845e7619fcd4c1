import math

import numpy as np
import pytest

from heightline.llm import permutation_index

KIND = "vec_id long, embedding array<float>, label int"


def nearest(rows, k=10):
    """Exact answers of every query among vectors that take part."""
    dims = [len(v) for i, v in rows if sound(i, v)]
    common = max(set(dims), key=lambda d: (dims.count(d), -d)) if dims else 0
    rows = [(i, np.float32(v).astype(float)) for i, v in rows if sound(i, v) and len(v) == common]
    out = []
    for q, v in {(i, v.tobytes()): (i, v) for i, v in rows if i % 100 == 0}.values():
        best = {}
        for i, x in rows:
            if i != q:
                d = math.sqrt(float(((x - v) ** 2).sum()))
                best[i] = min(d, best.get(i, d))
        out.append((q, sorted(best.items(), key=lambda p: (p[1], p[0]))[:k]))
    return out


def sound(i, v):
    return i is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_edges_and_ties(spark, table):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 60)]
    rows += [(100, rows[4][1]), (200, [0.0] * 6), (300, None), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] + [1.0] * 5), (600, [float("inf")] + [1.0] * 5), (700, [1.0, 2.0]), (800, []), (None, rows[4][1])]
    rows += [(1000 + j, rows[4][1]) for j in range(30)] + [(900, rows[9][1]), (61, rows[9][1]), (61, rows[10][1])]
    folder = table([(i, v, 0) for i, v in rows], KIND, "embeddings")
    found = permutation_index.op5_permutation_index(spark, folder).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = dict(nearest(rows))
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


@pytest.mark.parametrize("rows", [[], [(100, [1.0, 2.0], 0)], [(100, None, 0)], [(100, [1.0], 0), (7, [2.0], 0), (8, [3.0], 1)]])
def test_few(spark, table, rows):
    found = permutation_index.op5_permutation_index(spark, table(rows, KIND, "embeddings")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == ([(100, 1, 7, 1.0), (100, 2, 8, 2.0)] if len(rows) == 3 else [])


@pytest.mark.parametrize("one, others", [(1, range(2, 22)), (200, range(301, 321))])
def test_repeated_rows_take_one_place(spark, table, one, others):
    """30 copies of one row beside 20 other ids of the same vector, asked for from elsewhere and from within."""
    rows = [(one, [1.0, 2.0, 3.0])] * 30 + [(i, [1.0, 2.0, 3.0]) for i in others] + [(100, [1.0, 2.0, 3.5]), (50, [9.0, 2.0, 3.0])]
    found = permutation_index.op5_permutation_index(spark, table([(i, v, 0) for i, v in rows], KIND, "embeddings")).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = dict(nearest(rows))
    assert 100 in want and got == want


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    data = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack(data.embedding.to_numpy()).astype(float)
    ids = data.vec_id.to_numpy()
    found = permutation_index.op5_permutation_index(spark, sf).toPandas()
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        own = found[found.query_id == ids[q]]
        assert sorted(own["rank"]) == list(range(1, 11))
        hit += len(best & set(own.vec_id))
        total += 10
    assert hit / total >= 0.9


def test_recall_holds_with_many_pivots(spark, table, monkeypatch):
    """1,000 pivots, as 2.8 million vectors would have, over vectors without clusters."""
    monkeypatch.setattr(permutation_index, "PIVOTS_A_ROOT", 1000 / math.sqrt(4000))
    x = np.random.default_rng(8).normal(size=(4000, 64)).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.tolist(), 1)]
    found = permutation_index.op5_permutation_index(spark, table([(i, v, 0) for i, v in rows], KIND, "embeddings")).collect()
    want = {q: {i for i, _ in best} for q, best in nearest(rows)}
    assert len(found) == 400 and sum(r["vec_id"] in want[r["query_id"]] for r in found) >= 0.97 * 400


def test_footrule_equals_its_definition():
    rng = np.random.default_rng(0)
    n, length = 12, 6
    pick = [rng.permutation(n)[:length] for _ in range(40)]
    places = np.full((40, n), length, np.int16)
    for j, p in enumerate(pick):
        places[j, p] = np.arange(length)
    q = pick[0]
    own = {p: i for i, p in enumerate(q.tolist())}
    want = [sum(abs(own.get(x, length) - dict(zip(p.tolist(), range(length))).get(x, length)) for x in range(n)) for p in pick]
    got = permutation_index.footrule(q.astype(np.int64), places, np.full(40, length * (length + 1) // 2), length)
    assert got.tolist() == want


def test_queries_of_another_dimension_take_no_part(spark):
    data = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(100, [1.0, 1.0, 1.0]), (101, [3.0, 1.0]), (102, None)], "vec_id long, embedding array<double>")
    found = permutation_index.search(data, asked, 3).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in found] == [(101, 2), (101, 1), (101, 3)]


def test_no_vectors_no_neighbours(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert permutation_index.search(empty, empty).count() == 0
