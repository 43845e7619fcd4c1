import random

import numpy as np
import pytest

from heightline.llm import jaccard_join, substring_dedup
from heightline.llm.text import grams, words
from tests.llm import brute
from tests.llm.conftest import prose
from tests.oracle import same


def by_row(rows):
    return sorted(rows, key=repr)


def test_substring_edges(spark, table, edge_rows):
    found = substring_dedup.op7_substring_dedup(spark, table(edge_rows))
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert by_row(map(tuple, found.collect())) == by_row(brute.repeated_windows(edge_rows))


@pytest.mark.parametrize("seed", range(3))
def test_substring_random(spark, table, seed):
    """Few different words and copied pieces of all lengths about the window's, so factors break everywhere."""
    rng = random.Random(seed)
    pool, rows = prose(rng, 600, 5 if seed == 2 else 80), []
    for i in rng.sample(range(1000), 60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            a, n = rng.randrange(500), rng.choice([10, 26, 49, 50, 51, 75, 99])
            parts += pool[a : a + n] + prose(rng, rng.choice([0, 1, 5]), 80)
        rows.append((i, " ".join(parts)))
    found = substring_dedup.op7_substring_dedup(spark, table(rows)).collect()
    assert by_row(map(tuple, found)) == by_row(brute.repeated_windows(rows))


def test_substring_empty(spark, table):
    assert substring_dedup.op7_substring_dedup(spark, table([])).collect() == []
    assert substring_dedup.op7_substring_dedup(spark, table([(1, None)])).count() == 1


def test_substring_oracle(spark, sf_dir):
    same(substring_dedup.op7_substring_dedup(spark, sf_dir), substring_dedup.ORACLE, sf_dir)


def test_texts_without_duplicates(spark, table, edge_rows):
    """The cut texts have exactly the words that stay; other texts are the same bytes."""
    rows = [(i, t) for i, t in dict(reversed(edge_rows)).items()]
    docs = spark.read.parquet(table(rows) + "/documents.parquet")
    found = {r["doc_id"]: r["text"] for r in substring_dedup.without_duplicates(docs).collect()}
    for (i, t), (_, n, gone, sha) in zip(rows, brute.repeated_windows(rows)):
        if not gone:
            assert found[i] == t
        else:
            assert len(brute.words(found[i])) == n - gone
            assert substring_dedup.hashlib.sha256(b" ".join(brute.words(found[i]))).hexdigest() == sha


def test_columns_are_carried(spark, clashing):
    found = substring_dedup.without_duplicates(clashing)
    assert found.columns == clashing.columns and found.count() == 12
    assert jaccard_join.one_of_each(clashing).columns == clashing.columns


def test_leftmost_minima():
    g = np.random.default_rng(0).integers(0, 20, 200).astype(np.uint64)
    for width in (1, 2, 5, 25):
        got = substring_dedup.leftmost_minima(g, width)
        assert all(got[i] == i + int(np.argmin(g[i : i + width])) for i in range(200 - width + 1))


def test_grams_tell_runs_apart():
    h = words(__import__("pyarrow").array(["a b c a b c a b d"])).hashes()
    g = grams(h, 3)
    assert g[0] == g[3] and g[0] != g[6] and len(set(g[:7].tolist())) == 4


def test_join_edges(spark, table, edge_rows):
    found = jaccard_join.op10_jaccard_join(spark, table(edge_rows))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert by_row(map(tuple, found.collect())) == by_row(brute.linked(edge_rows))


@pytest.mark.parametrize("seed", range(3))
def test_join_random(spark, table, seed):
    """Sets of all sizes about the boundary of small and large, at similarities about 0.8."""
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(40):
        w = prose(rng, rng.choice([3, 5, 6, 8, 10, 12, 13, 14, 15, 16, 18, 22, 30, 60, 150]), 60)
        for _ in range(rng.randint(1, 5)):
            own = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                a = rng.choice([0, len(own) - 1, rng.randrange(len(own))])
                if rng.random() < 0.5:
                    own[a] = "x" + own[a]
                else:
                    own.insert(a, "y")
            rows.append((i, " ".join(own)))
            i += 1
    rng.shuffle(rows)
    found = jaccard_join.op10_jaccard_join(spark, table(rows)).collect()
    assert by_row(map(tuple, found)) == by_row(brute.linked(rows))


@pytest.mark.parametrize("bits", [4, 9])
def test_join_of_sets_whose_keys_meet_by_chance(spark, edge_rows, bits):
    """Keys of sets and subsets of a few bits: classes are split by the second hash, pairs are checked on words."""
    rng = random.Random(bits)
    rows = edge_rows + [(1000 + i, " ".join(prose(rng, rng.choice([5, 7, 9, 11, 14])))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert by_row(map(tuple, jaccard_join.joined(docs, bits).collect())) == by_row(brute.linked(rows))


def test_join_empty(spark, table):
    assert jaccard_join.op10_jaccard_join(spark, table([])).collect() == []
    assert [tuple(r) for r in jaccard_join.op10_jaccard_join(spark, table([(9, None)])).collect()] == [(9, 0, 9)]


def test_join_oracle(spark, sf_dir):
    same(jaccard_join.op10_jaccard_join(spark, sf_dir), jaccard_join.ORACLE, sf_dir)


def test_small_subsets_meet_exactly_for_linked_sets():
    rng = np.random.default_rng(3)
    most = jaccard_join.boundary()
    for _ in range(300):
        n, m = rng.integers(1, most + 1, 2)
        shared = rng.integers(0, min(n, m) + 1)
        pool = np.unique(rng.integers(1, 1 << 62, 64).astype(np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:shared], pool[n : n + m - shared]]))
        linked = 100 * shared >= 80 * (n + m - shared)
        if not (linked and n == m == shared):  # equal sets are one class
            x, y = ({((k >> 2, m), k & 3) for k, m in zip(*(v.tolist() for v in jaccard_join.small_keys(s, most)))} for s in (a, b))
            assert linked == any(k == q and (r != p or r == jaccard_join.SAME) for k, r in x for q, p in y)


def test_prefixes_of_linked_sets_touch():
    for n in range(1, 200):
        for m in jaccard_join.partners(n):
            c = jaccard_join.least_overlap(n, m)
            if c <= min(n, m):
                assert n - c + 1 <= jaccard_join.prefix(n) and m - c + 1 <= jaccard_join.prefix(m)


def test_sketches_of_linked_sets_are_near():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n, m = rng.integers(10, 900, 2)
        shared = rng.integers(0, min(n, m) + 1)
        pool = np.unique(rng.integers(1, 1 << 62, 2000).astype(np.uint64))
        rng.shuffle(pool)
        a, b = pool[:n], np.concatenate([pool[:shared], pool[n : n + m - shared]])
        apart = int(np.bitwise_count((jaccard_join.sketch(a) ^ jaccard_join.sketch(b)).view(np.uint64)).sum())
        assert apart <= n + m - 2 * shared
        if 100 * shared >= 80 * (n + m - shared):
            assert n + m >= 9 * apart


def test_places_of_one_window_are_merged():
    at = np.array([3, 1, 2, 60, 200, 7])
    a = np.array([5, 5, 5, 5, 5, 9], np.uint64)
    b = np.array([1, 1, 1, 1, 1, 4], np.uint64)
    wa, wb, counts, start, stop = substring_dedup.alike(at, a, b)
    assert wa.tolist() == [5, 9] and wb.tolist() == [1, 4] and counts.tolist() == [3, 1]
    assert list(zip(start.tolist(), stop.tolist())) == [(1, 53), (60, 110), (200, 250), (7, 57)]
    assert [len(x) for x in substring_dedup.alike(at[:0], a[:0], b[:0])] == [0] * 5
