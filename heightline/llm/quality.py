"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded and convolved by learned filters of WIDTH bytes at every STRIDE-th byte. The filters'
maxima are taken over overlapping chunks of CHUNK bytes, half a chunk apart, which cover the whole
document; the chunks' maxima combine by their mean and maximum into one probability. The network is
trained on the driver by gradient descent on a bounded sample: at most SAMPLE labelled documents, none
above SAMPLE_BYTES. Scoring reads every byte of every document.

Defined results: null and empty texts are one chunk of padding. Repeated rows stay, and equal texts get
equal scores. An empty table gives an empty result. Columns of the input are kept; score and predicted replace
columns of the same name. Without labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heightline.llm import labelled
from heightline.llm.columns import others
from heightline.llm.text import buffers, slices, tidied
from heightline.staging import extended

EMBEDDING, WIDTH, STRIDE, FILTERS = 8, 8, 4, 48
CHUNK = 512
HALF = CHUNK // 2
#: Bytes of the next half that the last window of a half reaches.
OVERHANG = WIDTH - STRIDE
SAMPLE = 5000
SAMPLE_BYTES = 12_000
EPOCHS = 12
#: Small samples take more rounds, up to this many steps.
LEAST_STEPS = 1200
DOCS_A_STEP = 32
RATE = 4e-3
THRESHOLD = 0.3
FOLDS, HELD = 5, 0
SLICE = 1 << 20
#: Halves convolved at once, which bounds memory on texts of any length.
BLOCK = 1024
#: Bits of embedding and filters of a trained network. With these, and 6 for the 64 products of a window, sums stay below
#: the 24 bits that single precision holds exactly, so no order of summing, which differs by batch, can change a score.
BITS = 9, 8
PAD = 256


class Network:
    """Parameters: embedding of 256 bytes and padding, filters, their bias, and the last layer."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32)
        self.embedding[PAD] = 0
        self.filters = rng.normal(0, 1 / np.sqrt(WIDTH * EMBEDDING / 4), (WIDTH * EMBEDDING, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.last = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.last, self.offset]

    def rounded(self) -> "Network":
        """With embedding and filters rounded to BITS bits below a power of two."""
        for x, bits in zip((self.embedding, self.filters), BITS):
            unit = 2.0 ** np.ceil(np.log2(np.abs(x).max() / (2**bits - 1) + 1e-30))
            x[:] = np.rint(x / unit) * unit
        return self

    def layout(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Halves that each document takes, padded to at least two, and where they begin."""
        halves = np.maximum(2, -(-sizes // HALF))
        return halves, np.cumsum(halves) - halves

    def codes(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte codes, one row a half chunk with the first bytes of the document's next one, and the halves
        of each document. What a document lacks is padding, so no window sees another document."""
        halves, begin = self.layout(np.diff(bounds))
        n = int(halves.sum())
        flat = np.full(n * HALF, PAD, np.int16)
        for at, a, b in zip((begin * HALF).tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
            flat[at : at + b - a] = data[a:b]
        out = np.full((n, HALF + OVERHANG), PAD, np.int16)
        out[:, :HALF] = flat.reshape(n, HALF)
        out[:-1, HALF:] = out[1:, :OVERHANG]
        out[np.cumsum(halves) - 1, HALF:] = PAD
        return out, halves

    def halves(self, codes: np.ndarray, where: bool = False):
        """Maximum of each filter over each half chunk, before the bias; with `where` also its place."""
        n = len(codes)
        if where:
            both = np.stack(self._phases(codes, 0, n), 2).reshape(n, -1, FILTERS)
            return both.max(1), both.argmax(1)
        out = np.empty((n, FILTERS), np.float32)
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            out[a:b] = np.maximum(*(phase.max(1) for phase in self._phases(codes, a, b)))
        return out

    def _phases(self, codes: np.ndarray, a: int, b: int) -> list[np.ndarray]:
        """Responses over halves a to b, from each of the two alignments of windows that do not overlap."""
        x = self.embedding[codes[a:b]]
        return [(x[:, p : p + HALF].reshape(-1, WIDTH * EMBEDDING) @ self.filters).reshape(b - a, -1, FILTERS) for p in range(0, WIDTH, STRIDE)]

    def forward(self, codes: np.ndarray, halves: np.ndarray, where: bool = False):
        """Probability of each document and what the backward pass needs."""
        best = self.halves(codes, where)
        best, place = best if where else (best, None)
        first = np.cumsum(halves) - halves
        chunk = np.maximum(best[:-1], best[1:])  # chunk i covers halves i and i + 1
        inside = np.ones(len(chunk), bool)
        inside[(first - 1)[1:]] = False
        active = np.maximum(chunk + self.bias, 0)[inside]
        counts = halves - 1
        starts = np.cumsum(counts) - counts
        mean = np.add.reduceat(active, starts) / counts[:, None]
        top = np.maximum.reduceat(active, starts)
        logit = (np.concatenate([mean, top], 1) * self.last).sum(1) + self.offset[0]  # by rows, each alike in any batch
        return labelled.sigmoid(logit.astype(np.float64)), (best, place, inside, active, counts, starts, mean, top)

    def gradients(self, codes: np.ndarray, halves: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        p, (best, place, inside, active, counts, starts, mean, top) = self.forward(codes, halves, True)
        error = ((p - labels) * weight / len(labels)).astype(np.float32)
        d_last = np.concatenate([error @ mean, error @ top])
        to_mean, to_top = error[:, None] * self.last[:FILTERS] / counts[:, None], error[:, None] * self.last[FILTERS:]
        owner = np.repeat(np.arange(len(counts)), counts)
        is_top = active == top[owner]
        is_top = is_top / np.add.reduceat(is_top, starts, dtype=np.float32)[owner]  # neighbours share a half
        d_active = (to_mean[owner] + to_top[owner] * is_top) * (active > 0)
        at = np.flatnonzero(inside)
        right = best[at] < best[at + 1]
        half = at[:, None] + right
        chunk, filt = np.nonzero(d_active)
        g = d_active[chunk, filt]
        h = half[chunk, filt]
        window = codes[h[:, None], (place[h, filt] * STRIDE)[:, None] + np.arange(WIDTH)]
        x = self.embedding[window].reshape(len(g), WIDTH * EMBEDDING)
        order = np.argsort(filt, kind="stable")
        edges = np.searchsorted(filt[order], np.arange(FILTERS + 1))
        d_filters = np.zeros_like(self.filters)
        for f in range(FILTERS):
            own = order[edges[f] : edges[f + 1]]
            d_filters[:, f] = g[own] @ x[own]
        d_window = (g[:, None] * self.filters.T[filt]).reshape(-1, EMBEDDING)
        flat = window.reshape(-1)
        d_embedding = np.column_stack([np.bincount(flat, d_window[:, k], 257) for k in range(EMBEDDING)]).astype(np.float32)
        d_embedding[PAD] = 0
        return [d_embedding, d_filters, d_active.sum(0), d_last, np.array([error.sum()], np.float32)]

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> "Network":
        """Adam over shuffled steps of DOCS_A_STEP documents; both labels weigh the same half-way."""
        rng = np.random.default_rng(seed)
        share = labels.mean() if len(labels) else 0.5
        if share in (0, 1) or not len(labels):
            self.offset[:] = 0 if not len(labels) else 4 * (2 * share - 1)
            return self.rounded()
        self.offset[:] = np.log(share / (1 - share))
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        each = -(-len(texts) // DOCS_A_STEP)
        epochs = max(epochs, -(-LEAST_STEPS // each))
        step, steps = 0, epochs * each
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), DOCS_A_STEP):
                own = order[a : a + DOCS_A_STEP]
                raw = [texts[i] for i in own]
                bounds = np.cumsum([0, *map(len, raw)])
                codes, halves = self.codes(np.frombuffer(b"".join(raw), np.uint8), bounds)
                y = labels[own]
                found = self.gradients(codes, halves, y, np.ones(len(y)))
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for p, (m, v), g in zip(self.parameters(), moments, found):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self.rounded()


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Network:
    taught = labelled.sample(docs.where(F.octet_length("text") <= SAMPLE_BYTES), labels, label, FOLDS, HELD, most)
    rows = taught.select("doc_id", "text", "label").orderBy(F.xxhash64(F.lit(11), "doc_id", "text"), "doc_id", "text").limit(most).toArrow()
    order = np.lexsort((rows.column("text").to_numpy(zero_copy_only=False), rows.column("doc_id").to_numpy())) if rows.num_rows else []
    texts = [t.encode() for t in rows.column("text").to_pylist()]
    return Network().train([texts[i] for i in order], (rows.column("label").to_numpy() > 0).astype(float)[order] if rows.num_rows else np.empty(0))


def probabilities(net: Network, column: pa.Array) -> np.ndarray:
    data, bounds = buffers(column)
    out = np.empty(len(column))
    for a, b in slices(np.diff(bounds) + CHUNK, SLICE):
        codes, halves = net.codes(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        out[a:b] = net.forward(codes, halves)[0]
    return out


def score(docs: DataFrame, net: Network, text: str = "text", threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """docs with score and predicted, computed over each whole text, which goes unless keep_text."""
    kept = others(docs.columns, "score", "predicted", *([] if keep_text else [text]))
    source = docs.select(*kept, F.col(text).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @tidied
    def run(batches):
        for batch in batches:
            p = probabilities(shared.value, batch.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    return source.mapInArrow(run, extended(docs.select(*kept), "score double, predicted int"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(labelled.fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return score(docs, net, keep_text=False).select("doc_id", held.alias("held_out"), "score", "predicted")
