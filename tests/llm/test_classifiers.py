import math
import re

import numpy as np
import pyarrow as pa
import pytest

from heightline.llm import quality, text, toxicity
from tests.llm import brute

TERSE = "doc_id long, quality int, toxic int"
CASES = [(toxicity.op2_toxicity, "toxic", 4, 2, 0.9), (quality.op4_quality_classifier, "quality", 5, 0, 0.9)]


@pytest.fixture(scope="module")
def scored(spark):
    """Both results over sf0.1, with labels; smaller tables hold too few held-out toxic documents to tell."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    return {label: (op(spark, sf).toPandas(), labels[label].dropna()) for op, label, *_ in CASES}


@pytest.mark.parametrize("op,label,folds,held,least", CASES)
def test_contract_and_held_out_accuracy(spark, scored, op, label, folds, held, least):
    found, labels = scored[label]
    assert list(found.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert len(found) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    assert found.score.between(0, 1).all() and ((found.score >= 0.3) == (found.predicted == 1)).all()
    assert [brute.fold(i, folds) == held for i in found.doc_id] == found.held_out.tolist()
    out = found[found.held_out & found.doc_id.isin(labels.index)].drop_duplicates("doc_id")
    assert brute.auc(out.score, labels.loc[out.doc_id]) >= least


@pytest.mark.parametrize("op,label,folds,held,least", CASES)
def test_edges(spark, table, edge_rows, monkeypatch, op, label, folds, held, least):
    """Null, empty and very long texts get scores; equal texts get equal ones; held-out labels don't matter."""
    monkeypatch.setattr(quality, "LEAST_STEPS", 60)
    folder = table(edge_rows)
    rows = [(i, 1 if i % 3 else 0, 1 if i % 3 else 0) for i in range(1, 80)] + [(None, 1, 1), (5, None, None), (6, 1, 0)]
    spark.createDataFrame(rows, TERSE).write.parquet(folder + "/labels.parquet")
    found = op(spark, folder).toPandas()
    assert len(found) == len(edge_rows) and found.score.between(0, 1).all()
    copies = found[found.doc_id.isin([20, 21, 22, 23])].score
    assert copies.nunique() == 1
    other = [(i, (1 - q if q is not None and brute.fold(i, folds) == held else q), (1 - t if t is not None and brute.fold(i, folds) == held else t)) for i, q, t in rows if i is not None] + [(None, 0, 0)]
    spark.createDataFrame(other, TERSE).write.mode("overwrite").parquet(folder + "/labels.parquet")
    again = op(spark, folder).toPandas()
    assert np.allclose(np.sort(found.score), np.sort(again.score))


@pytest.mark.parametrize("op,label,folds,held,least", CASES)
@pytest.mark.parametrize("rows", [[], [(1, "word " * 100), (2, None), (3, "")]])
def test_without_labels_or_rows(spark, table, rows, op, label, folds, held, least):
    folder = table(rows)
    spark.createDataFrame([], TERSE).write.parquet(folder + "/labels.parquet")
    found = op(spark, folder).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)


def test_columns_are_kept(spark, clashing, monkeypatch):
    monkeypatch.setattr(quality, "LEAST_STEPS", 20)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], TERSE)
    kept = [c for c in clashing.columns if c.lower() not in ("score", "predicted")]
    for module in (toxicity, quality):
        found = module.score(clashing, module.fit(clashing, labels))
        assert found.columns == [*kept, "score", "predicted"]
        assert {r["_text"] for r in found.collect()} == {f"_text{i}" for i in range(12)}


def brute_segments(x):
    """Maximal scoring segments by the definition: the best segment, then those of what lies on either side."""
    if not len(x):
        return []
    sums = np.concatenate([[0], np.cumsum(x)])
    best = max(((sums[b] - sums[a], -(b - a), -a) for a in range(len(x)) for b in range(a + 1, len(x) + 1)))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    return brute_segments(x[:a]) + [(a, b, float(best[0]))] + [(s + b, e + b, v) for s, e, v in brute_segments(x[b:])]


def test_segments_equal_the_definition():
    rng = np.random.default_rng(8)
    for _ in range(200):
        x = np.round(rng.normal(-0.3, 1, rng.integers(0, 40)), 3)
        got, want = toxicity.segments(x), brute_segments(x)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_passages_lie_in_the_text(spark):
    clean = [(i, f"calm plain words about number {i} and more of them here and there " * 6) for i in range(60)]
    bad = [(100 + i, "calm plain words here " * 20 + "vile nasty rotten foul " * 6 + "calm plain words there " * 20) for i in range(30)]
    docs = spark.createDataFrame(clean + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in bad], TERSE)
    model = toxicity.fit(docs, labels)
    texts = {i: t.encode() for i, t in bad}
    found = [r for r in toxicity.passages(docs, model).collect() if r["doc_id"] >= 100]
    assert {r["doc_id"] for r in found} == set(texts)
    for r in found:
        assert b"vile nasty rotten foul" in texts[r["doc_id"]][r["start"] : r["stop"]] and r["e_value"] <= toxicity.SIGNIFICANT
        assert r["stop"] - r["start"] < 200


def test_decay_is_the_root():
    x = np.array([-1.0] * 9 + [2.0])
    scale = toxicity.decay(x)
    assert abs(np.exp(scale * x).mean() - 1) < 1e-6


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    net = quality.Network()
    for name in ("embedding", "filters", "bias", "last", "offset"):
        setattr(net, name, getattr(net, name).astype(float))
    net.bias += 0.05  # padding then isn't at the bend of the activation
    raw = [rng.integers(32, 120, n).astype(np.uint8).tobytes() for n in (900, 10, 0, 2000)]
    codes, halves = net.codes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    y, w = np.array([1.0, 0, 1, 0]), np.ones(4)
    found = net.gradients(codes, halves, y, w)

    def loss():
        p = net.forward(codes, halves, True)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k, at in ((0, (97, 3)), (1, (5, 7)), (1, (60, 40)), (2, (7,)), (3, (60,)), (3, (2,)), (4, (0,))):
        p = net.parameters()[k]
        old, step = p[at], 1e-6
        p[at] = old + step
        high = loss()
        p[at] = old - step
        low = loss()
        p[at] = old
        assert abs((high - low) / (2 * step) - found[k][at]) < 1e-5


def test_blocks_don_t_matter(monkeypatch):
    rng = np.random.default_rng(5)
    texts = pa.array(["".join(chr(c) for c in rng.integers(32, 120, n)) for n in (5000, 3, 70_000)] + [None, ""])
    net = quality.Network()
    whole = quality.probabilities(net, texts)
    monkeypatch.setattr(quality, "BLOCK", 3)
    monkeypatch.setattr(quality, "SLICE", 1000)
    assert np.allclose(whole, quality.probabilities(net, texts), atol=1e-5)
    assert whole[3] == whole[4]


def _hash(token: bytes) -> int:
    """One token's hash by the definition: a polynomial over its bytes, A-Z folded, and the finaliser."""
    total = sum(int(text._FOLDED[b]) * pow(text._BASE, i, 1 << 64) for i, b in enumerate(token)) % (1 << 64)
    return int(text.mix(np.array([total], np.uint64))[0])


def _best(scores: list[float], at: int = 0) -> list[tuple[int, int, float]]:
    """Maximal segments by their definition: the best one, then those on either side of it."""
    sums = [(sum(scores[i:j]), j - i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    top = max((s for s in sums if s[0] > 0), key=lambda s: (round(s[0], 9), -s[1]), default=None)
    if top is None:
        return []
    _, _, i, j = top
    return _best(scores[:i], at) + [(at + i, at + j, top[0])] + _best(scores[j:], at + j)


def test_toxic_scores_equal_a_plain_form(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    t, half = model.table, 64 - toxicity.BITS
    rows = [(r["doc_id"], r["text"]) for r in docs.where("length(text) < 400").orderBy("doc_id").limit(25).collect()] + [(-1, ""), (-2, None)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, whole in rows:
        scores = []
        for token in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (whole or "").encode()):
            k, stem = _hash(token) >> half, _hash(token[: toxicity.STEM]) >> half
            rate = float(t.rate[stem])
            odds = math.log((float(t.toxic[k]) + toxicity.PRIOR * rate) / (float(t.clean[k]) + toxicity.PRIOR * (1 - rate))) - t.log_base
            scores.append(min(max(odds - toxicity.DRIFT, toxicity.FLOOR), toxicity.CEILING))
        n = max(1, len(scores))
        found = [(b - a, model.scale * s - model.log_k - math.log(n)) for a, b, s in _best(scores)]
        strong = [x for x in found if x[1] >= -math.log(toxicity.SIGNIFICANT)]
        best = max((x[1] for x in found), default=-model.log_k - math.log(n))
        features = [min(max(best, -15), 30), math.log1p(sum(x[1] for x in strong)), math.log1p(len(strong)), sum(x[0] for x in strong) / n, math.log(n)]
        logit = sum(w * f for w, f in zip(model.weights, features)) + model.weights[-1]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-3)


def test_network_scores_equal_a_plain_form():
    rng = np.random.default_rng(8)
    net = quality.Network()
    net.bias += rng.normal(0, 0.2, quality.FILTERS).astype(np.float32)
    raw = [rng.integers(32, 120, n).astype(np.uint8).tobytes() for n in (0, 3, 255, 256, 257, 512, 513, 1500)]
    got = quality.probabilities(net, pa.array([r.decode() for r in raw]))
    for p, own in zip(got, raw):
        halves = max(2, -(-len(own) // quality.HALF))
        codes = list(own) + [quality.PAD] * (halves * quality.HALF + quality.OVERHANG - len(own))
        chunks = []
        for first in range(0, (halves - 1) * quality.HALF, quality.HALF):
            windows = [net.embedding[codes[s : s + quality.WIDTH]].reshape(-1).astype(float) @ net.filters.astype(float) for s in range(first, first + quality.CHUNK, quality.STRIDE)]
            chunks.append(np.maximum(np.max(windows, axis=0) + net.bias, 0))
        logit = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ net.last.astype(float) + float(net.offset[0])
        assert p == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-4)


def test_one_text_has_one_score_in_any_batch(spark):
    """At any place among other texts, also where these fill the last block of halves by another length."""
    rng = np.random.default_rng(11)
    draw = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n)) if n else ""
    text_of = " ".join(draw(int(k)) for k in rng.integers(1, 9, 300))
    net = quality.Network()
    net.bias += rng.normal(0, 0.2, quality.FILTERS).astype(np.float32)
    net.rounded()
    table = toxicity.Table(*(rng.random(1 << toxicity.BITS).astype(np.float32) for _ in range(3)), 0.1)
    model = toxicity.Model(table, 0.7, 0.3, rng.normal(0, 1, len(toxicity.FEATURES) + 1))
    quiet, toxic = set(), set()
    rows = []
    for k in range(40):
        before, after = ([" ".join(draw(int(x)) for x in rng.integers(1, 9, int(rng.integers(0, 700)))) for _ in range(int(rng.integers(0, 12)))] for _ in range(2))
        own = [*before, text_of, *after]
        quiet.add(quality.probabilities(net, pa.array(own))[len(before)])
        rows += [(k, i, t) for i, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "k int, i int, text string")
    for parts in (1, 3, 11):
        toxic |= {r["score"] for r in toxicity.score(docs.repartition(parts), model).where(f"text = '{text_of}'").collect()}
    assert len(quiet) == 1 and len(toxic) == 1


def test_rows_that_repeat_a_labelled_id_are_one_sample(spark):
    from heightline.llm import labelled

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(1, "text 7")] * 500 + [(i, f"other {i}") for i in range(2, 40)] + [(50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 60)], TERSE)
    rows = labelled.sample(docs, labels, "toxic", 4, 2, 30).collect()
    assert len(rows) <= 30 and len({r["doc_id"] for r in rows}) == len(rows)
    assert [r["text"] for r in rows if r["doc_id"] == 1] in ([], ["text 0"])
