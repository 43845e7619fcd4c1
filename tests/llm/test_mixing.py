import hashlib
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from heightline.llm import mixing, prefix
from tests.llm.brute import DOCS
from tests.oracle import same


def water(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """Targets by sharing again and again what sources above their caps can't take."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, Fraction(0))
    open_, left = set(names), share * sum(sizes.values())
    while open_ and left > 0:
        total = sum(weight[s] for s in open_)
        given = {s: left * weight[s] / total for s in open_}
        left = Fraction(0)
        for s, x in given.items():
            target[s] += x
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = Fraction(most * sizes[s])
        open_ = {s for s in open_ if target[s] < most * sizes[s]}
    return target


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain(rows):
    """(doc_id, size, source_size, target, taken)."""
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target, out = water(sizes), []
    for s in sizes:
        rate = int(float(target[s]) * 2**24 / sizes[s]) if sizes[s] else 0
        own = sorted(((i, t) for i, t, x in rows if x == s), key=lambda r: (r[0] is None, hashlib.sha256(str(r[0]).encode()).hexdigest()[:16] if r[0] is not None else "", size(r[1])))
        tried = []
        for k in range(64):
            at = int(hashlib.sha256((f"mix{k}" if s is None else f"mix{k}:{s}").encode()).hexdigest()[:6], 16)
            taken = [((at + (n + 1) * rate >> 24) - (at + n * rate >> 24)) * size(t) for n, (_, t) in enumerate(own)]
            tried.append((abs(sum(taken) - float(target[s])), k, taken))
        out += [(i, size(t), sizes[s], float(target[s]), n) for (i, t), n in zip(own, min(tried)[2])]
    return out


@pytest.fixture
def edges(edge_rows):
    rng = random.Random(2)
    names = ["hot"] * 6 + ["a", "B", "é", "\U0001f600", "￮", "", None]
    rows = [(i, t, rng.choice(names)) for i, t in edge_rows * 3]
    return rows + [(900 + i, None, "silent") for i in range(4)]


def found(spark, table, rows):
    folder = table([(i, t, "en", s, 0) for i, t, s in rows], DOCS + " ")
    return mixing.op12_source_mixing(spark, folder)


def rounded(rows):
    return sorted(((*r[:3], round(r[3], 6), r[4]) for r in map(tuple, rows)), key=repr)


def test_edges(spark, table, edges):
    got = found(spark, table, edges).collect()
    assert rounded(got) == rounded(plain(edges))
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    taken, largest, target = {}, {}, {}
    for r in got:
        k = (r["source_size"], r["target"])
        taken[k] = taken.get(k, 0) + r["taken"]
        largest[k] = max(largest.get(k, 0), r["size"])
    assert all(abs(taken[k] - k[1]) <= 2 * largest[k] + 1 for k in taken)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b", "x")], [(1, "a b", "x"), (1, "a b", "x"), (2, "", "y")]])
def test_few_rows(spark, table, rows):
    assert rounded(found(spark, table, rows).collect()) == rounded(plain(rows))


def test_many_sources(spark):
    rng = random.Random(7)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 80, 3000]) for i in range(400)}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(7)
    want = water(sizes)
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    assert got == pytest.approx({s: float(x) for s, x in want.items()}) and sum(want.values()) == Fraction(3, 2) * sum(sizes.values())


def test_running_sums_over_pieces(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaab"), rng.randrange(40), i, rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, i int, x long").repartition(5)
    got = {r["i"]: r["s"] for r in prefix.running(df, ["g"], [F.col("o").desc(), F.col("i").asc()], {"s": "x"}).collect()}
    at = {}
    for g, o, i, x in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        assert got[i] == at.get(g, 0)
        at[g] = at.get(g, 0) + x


def test_the_mix_repeats_documents(spark, clashing):
    docs = clashing.withColumn("source", F.lit("one"))
    got = mixing.mixture(docs)
    assert got.columns == docs.columns and got.count() == 18  # half as much again


def test_query_equals_its_twin(spark, sf_dir):
    same(mixing.op12_source_mixing(spark, sf_dir), mixing.ORACLE, sf_dir)
