"""Toxicity by maximum-scoring segments.

Tokens have log-odds of toxic against clean documents, smoothed by a Dirichlet prior at the rate of their
stem (their first STEM bytes), which in turn is smoothed at the rate of the classes. A linear-time scan finds every maximal scoring segment of a text, long texts included. Scores are
calibrated by the extreme-value law of such segments in clean text: with the root lambda of
E[exp(lambda s)] = 1 and the constant K, a segment of score s among n tokens has the E-value
K n exp(-lambda s). What the segments of a document add up to becomes one probability by a logistic
regression on a part of the sample that the log-odds have not seen.

The tables of tokens and stems have 2**BITS entries each whatever the corpus; the labelled sample has at most SAMPLE rows.

Defined results: null and empty texts have no segments and get the score of no evidence. Repeated rows
stay, and equal texts get equal scores. An empty table gives an empty result. Texts of any length are scanned
whole. Columns of the input are kept; score and predicted replace columns of the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heightline.llm import labelled
from heightline.llm.columns import others
from heightline.staging import discard, extended, staged
from heightline.llm.text import BREAK, Words, buffers, slices, tidied, words

BITS = 20
#: Labelled documents that a fit takes at most.
SAMPLE = 24_000
PRIOR = 8.0
STEM_PRIOR = 20.0
STEM = 4
DRIFT = 0.6
FLOOR, CEILING = -3.0, 8.0
SIGNIFICANT = 0.05
THRESHOLD = 0.3
FOLDS, HELD = 4, 2
FEATURES = ("best", "total", "number", "share", "length")
SLICE = 4 << 20


@dataclass
class Table:
    """Counts of documents by token bucket, and the rate of toxic documents by stem bucket."""

    toxic: np.ndarray
    clean: np.ndarray
    rate: np.ndarray
    log_base: float

    def scores(self, token: np.ndarray, stem: np.ndarray) -> np.ndarray:
        rate = self.rate[stem]
        odds = np.log((self.toxic[token] + PRIOR * rate) / (self.clean[token] + PRIOR * (1 - rate))) - self.log_base
        return np.clip(odds - DRIFT, FLOOR, CEILING)


@dataclass
class Model:
    table: Table
    scale: float
    log_k: float
    weights: np.ndarray


def buckets(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each token its bucket and that of its stem."""
    short = replace(found, stop=np.minimum(found.stop, found.start + STEM))
    cut = np.uint64(64 - BITS)
    return (found.hashes(fold=True) >> cut).astype(np.int64), (short.hashes(fold=True) >> cut).astype(np.int64)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, score) in one pass (Ruzzo and Tompa, 1999).

    Runs of one sign are summed first, which changes no segment.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(positive)) + 1
    first = np.concatenate([[0], edges])
    sums = np.add.reduceat(scores.astype(np.float64), first)
    stops = np.concatenate([edges, [len(scores)]])
    found: list[list] = []  # start, stop, sum before, sum up to its end, last one with a smaller sum before
    before = 0.0
    for a, b, s in zip(first.tolist(), stops.tolist(), sums.tolist()):
        if s > 0:
            new = [a, b, before, before + s, -1]
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= new[2]:
                    j = found[j][4]
                new[4] = j
                if j < 0 or found[j][3] >= new[3]:
                    break
                new[0], new[2] = found[j][0], found[j][2]
                del found[j:]
            found.append(new)
        before += s
    return [(int(a), int(b), r - l) for a, b, l, r, _ in found]


def token_table(seen: np.ndarray, n_toxic: int, n_clean: int) -> Table:
    """seen: clean and toxic documents by token bucket, then by stem bucket."""
    share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    half = 1 << BITS
    rate = (seen[1, half:] + STEM_PRIOR * share) / (seen[:, half:].sum(0) + STEM_PRIOR)
    return Table(seen[1, :half].astype(np.float32), seen[0, :half].astype(np.float32), rate.astype(np.float32), math.log(share / (1 - share)))


def decay(scores: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The positive root of E[exp(lambda s)] = 1 over scores of background tokens and how often each occurs."""
    share = np.ones(len(scores)) if weights is None else weights.astype(float)
    excess = lambda x: float(np.exp(np.minimum(x * scores, 50)) @ share / share.sum()) - 1 if len(scores) else 1.0
    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 16:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(high, 0.05)


def evidence(scores: np.ndarray, scale: float, log_k: float) -> tuple[float, float, float, float, float, list]:
    """Best normalised score, sum over significant segments, their number, share of tokens, log length;
    the significant segments."""
    n = max(1, len(scores))
    base = log_k + math.log(n)
    found = [(a, b, s, scale * s - base) for a, b, s in segments(scores)]
    strong = [x for x in found if x[3] >= -math.log(SIGNIFICANT)]
    best = max((x[3] for x in found), default=-base)
    return best, sum(x[3] for x in strong), float(len(strong)), sum(x[1] - x[0] for x in strong) / n, math.log(n), strong


def features(found: np.ndarray) -> np.ndarray:
    best, total, number, share, length = found.T
    return np.column_stack([np.clip(best, -15, 30), np.log1p(total), np.log1p(number), share, length])


def _scores(column: pa.Array, table: Table):
    """For each text of the column its tokens' scores and the tokens."""
    for a, b in slices(np.diff(buffers(column)[1]), SLICE):
        found = words(column.slice(a, b - a), BREAK)
        score = table.scores(*buckets(found))
        for i in range(b - a):
            yield score[found.first[i] : found.first[i + 1]], found, found.first[i], i


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Model:
    taught = staged(labelled.sample(docs, labels, label, FOLDS, HELD, most), "taught")  # four passes read it
    sc = docs.sparkSession.sparkContext

    @tidied
    def count(batches):
        seen = np.zeros((2, 2 << BITS), np.int32)
        totals = np.zeros(2, np.int64)
        for batch in batches:
            flags = batch.column("label").to_numpy(zero_copy_only=False)
            found = words(batch.column("text"), BREAK)
            token, stem = buckets(found)
            for i, y in enumerate(flags):
                own = slice(found.first[i], found.first[i + 1])
                seen[int(y > 0), np.unique(token[own])] += 1
                seen[int(y > 0), np.unique(stem[own]) + (1 << BITS)] += 1
                totals[int(y > 0)] += 1
        used = np.flatnonzero(seen.any(axis=0))
        for a in range(0, len(used), 1 << 16):
            u = used[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(seen[1, u], pa.int64()), pa.array(seen[0, u], pa.int64())], ["bucket", "toxic", "clean"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([totals[1]]), pa.array([totals[0]])], ["bucket", "toxic", "clean"])

    counted = taught.where("part = 0").select("text", "label").mapInArrow(count, "bucket long, toxic long, clean long")
    rows = counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toArrow()  # at most 2**(BITS + 1) + 1 rows
    at, toxic, clean = (rows.column(c).to_numpy() for c in ("bucket", "toxic", "clean"))
    seen = np.zeros((2, 2 << BITS), np.int32)
    seen[0, at[at >= 0]], seen[1, at[at >= 0]] = clean[at >= 0], toxic[at >= 0]
    table = token_table(seen, int(toxic[at < 0].sum()), int(clean[at < 0].sum()))
    shared = sc.broadcast(table)

    places = round((CEILING - FLOOR) * 100) + 1

    @tidied
    def background(batches):
        """How often each score, to two digits, occurs among all tokens of the clean documents."""
        seen = np.zeros(places, np.int64)
        for batch in batches:
            quiet = batch.filter(pc.equal(batch.column("label"), 0))
            for s, *_ in _scores(quiet.column("text"), shared.value):
                seen += np.bincount(np.rint((s - FLOOR) * 100).astype(np.int64), minlength=places)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["at", "n"])

    quiet_tokens = taught.where("part = 1").select("text", "label").mapInArrow(background, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most `places` rows
    scale = decay(FLOOR + quiet_tokens["at"].to_numpy(float) / 100, quiet_tokens["n"].to_numpy())

    @tidied
    def collect(batches):
        for batch in batches:
            found = [(*evidence(s, scale, 0.0)[:4], max(1, len(s))) for s, *_ in _scores(batch.column("text"), shared.value)]
            best, total, number, share, n = (pa.array(x, pa.float64()) for x in zip(*found)) if found else [pa.array([], pa.float64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column("label"), best, n], ["label", "best", "n"])

    first = taught.where("part = 1").select("text", "label").mapInArrow(collect, "label int, best double, n double").toPandas()
    quiet = first[first.label == 0]
    log_k = float(quiet.best.mean() - np.euler_gamma) if len(quiet) else 0.0

    @tidied
    def evidenced(batches):
        for batch in batches:
            found = [evidence(s, scale, log_k)[:5] for s, *_ in _scores(batch.column("text"), shared.value)]
            cols = [pa.array(x, pa.float64()) for x in zip(*found)] if found else [pa.array([], pa.float64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column("label"), *cols], ["label", *FEATURES])

    seen_by = taught.where("part = 1").select("text", "label").mapInArrow(evidenced, "label int, " + ", ".join(f"{x} double" for x in FEATURES)).toPandas()
    weights = labelled.logistic(features(seen_by[list(FEATURES)].to_numpy()), (seen_by.label > 0).to_numpy(float)) if len(seen_by) else np.array([0.3, 0.3, 0.3, 0.0, 0.0, -2.0])
    shared.destroy()  # no job reads it any more
    discard(taught)
    return Model(table, scale, log_k, weights)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """docs with score and predicted, computed over each whole text, which goes unless keep_text."""
    kept = others(docs.columns, "score", "predicted", *([] if keep_text else [text]))
    source = docs.select(*kept, F.col(text).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidied
    def run(batches):
        m = shared.value
        for batch in batches:
            found = np.array([evidence(s, m.scale, m.log_k)[:5] for s, *_ in _scores(batch.column(len(kept)), m.table)]).reshape(-1, 5)
            p = labelled.sigmoid((features(found) * m.weights[:-1]).sum(1) + m.weights[-1])  # by rows, each alike in any batch
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    return source.mapInArrow(run, extended(docs.select(*kept), "score double, predicted int"))


def passages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every significant passage: key, byte range in the text, score and E-value."""
    source = docs.select(key, F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = extended(source.select(key), "start long, stop long, segment_score double, e_value double")

    @tidied
    def run(batches):
        m = shared.value
        for batch in batches:
            row, out = [], []
            for i, (s, found, first, j) in enumerate(_scores(batch.column("_text"), m.table)):
                for a, b, score_, norm in evidence(s, m.scale, m.log_k)[5]:
                    row.append(i)
                    origin = int(found.bounds[j])
                    out.append((int(found.start[first + a]) - origin, int(found.stop[first + b - 1]) - origin, score_, math.exp(-norm)))
            cols = list(zip(*out)) if out else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], schema.names)

    return source.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(labelled.fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return score(docs, model, keep_text=False).select("doc_id", held.alias("held_out"), "score", "predicted")
