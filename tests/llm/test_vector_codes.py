import hashlib
import math

import numpy as np
import pytest

from heightline.llm import vector_codes
from tests.oracle import same

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, codebooks_sha256) by the contract's words, all distances in whole numbers."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    first = {}
    for i, q, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        first.setdefault(i, q)
    width = len(kept[0][1]) // parts
    cut = lambda q, p: q[p * width : (p + 1) * width]
    books = [[cut(first[i], p) for i in sorted(first)[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(cut(q, p), e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, q, _ in kept]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(q, p) for (_, q, _), c in zip(kept, codes) if c[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    codes = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(d for d, _ in c) for c in codes]
    total = {}
    for (_, _, lab), e in zip(kept, error):
        total[lab] = total.get(lab, 0) + e
    return [(i, "".join(f"{k:02x}" for _, k in c), e, total[lab], digest) for (i, _, lab), c, e in zip(kept, codes, error)]


@pytest.fixture
def vectors(spark, tmp_path):
    def make(rows, schema=ROWS):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
        return str(tmp_path)

    return make


def found(spark, folder):
    return [tuple(r) for r in vector_codes.op11_vector_codes(spark, folder).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]


def test_edges(spark, vectors):
    rng = np.random.default_rng(3)
    draw = lambda: [float(np.float32(x)) for x in rng.normal(0, 0.3, 16)]
    base = draw()
    rows = [(i, draw(), i % 3) for i in range(90)] + [(200 + i, base, None) for i in range(40)]  # copies, null labels
    rows += [(300, None, 1), (301, base[:5] + [None] + base[6:], 1), (302, base[:5] + [float("nan")] + base[6:], 1), (303, base[:5] + [float("inf")] + base[6:], 1)]
    rows += [(304, [0.0] * 16, 2), (None, draw(), 2), (3, draw(), 0), (5, rows[5][1], 2), (-7, draw(), 1), (305, [7.99] * 8 + [-8.0] * 8, None)]
    got = found(spark, vectors(rows))
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr) and len(got) == len(rows) - 4


@pytest.mark.parametrize("n", [0, 1, 7])
def test_few_vectors(spark, vectors, n):
    rows = [(i, [float(i)] * 8 + [0.5] * 8, None) for i in range(n)] + [(50, None, 1)]
    assert sorted(found(spark, vectors(rows))) == sorted(plain(rows))


def test_other_lengths_and_sizes(spark, vectors):
    rows = [(i, [float(i % 5)] * 16, 1) for i in range(20)]
    assert len(found(spark, vectors([*rows, (30, [1.0] * 8, 1), (31, [], 1)]))) == 20
    with pytest.raises(ValueError):
        vector_codes.fit(spark.createDataFrame([(1, [1.0] * 12, 1)], ROWS))
    with pytest.raises(Exception, match="component of"):
        vector_codes.encode(spark.createDataFrame([(1, [1e9] * 16, 1)], ROWS), np.zeros((8, 1, 2), np.int64)).collect()


def test_clashing_columns(spark):
    rows = [(i, [float(i)] * 8, 1, "x", "y", "z") for i in range(20)]
    got = vector_codes.compressed(spark.createDataFrame(rows, f"{ROWS}, id string, v string, code string"))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 20


def test_annulus_finds_the_nearest_and_spares_distances():
    rng = np.random.default_rng(9)
    for scale in (1, 30, 1_000_000):
        entries = (rng.integers(-100, 100, (64, 4)) * rng.integers(1, 12, (64, 1)) * scale // 16).astype(np.int64)
        entries[10] = entries[3]  # ties go to the lower index
        x = np.concatenate([rng.integers(-900, 900, (3000, 4)) * scale // 16, entries]).astype(np.int64)
        index, best, evaluated = vector_codes.Codebook(entries).nearest(x)
        d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
        assert evaluated < 0.8 * len(x) * len(entries)


def test_codes_stand_for_their_entries(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    books = vector_codes.fit(rows)
    decoded = vector_codes.decode(vector_codes.encode(rows, books), books)
    for a, b in zip(rows.orderBy("vec_id").limit(40).collect(), decoded.orderBy("vec_id").limit(40).collect()):
        q = np.floor(4096 * np.array(a["embedding"], float)).astype(np.int64)
        assert ((q - np.array(b["vector"])) ** 2).sum() == b["error"]


def test_query_equals_its_twin(spark, sf_dir):
    same(vector_codes.op11_vector_codes(spark, sf_dir), vector_codes.ORACLE, sf_dir)
