"""Sequence packing by cutting-stock column generation.

Documents are tokenised and cut into full pieces and a rest. The lengths of all pieces, in classes of a
few tokens, form a histogram whose size does not depend on the corpus. A linear program over packing
patterns of that histogram is solved by column generation: a revised simplex keeps the basis, and a
knapsack dynamic program prices new columns. The patterns are rounded down, the small rest is packed first
fit decreasing, and the pieces of each class, ranked, are assigned to the places of the patterns.

Only the histogram and the patterns (at most CLASSES numbers each) reach the driver. Ranks come from the
pieces' counts by class and block, so that no class meets in one task.

Defined results: a null text counts as empty and is the end id alone; repeated rows are packed each; an
empty table gives an empty result. Columns other than those named are not carried.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heightline.staging import extended, staged
from heightline.llm.text import buffers, slices, tidied

VOCABULARY = "word_bpe_49k.json"
LENGTH = 2048
END = 1
CLASS_TOKENS = 8
#: Words in a task's table (about 170 bytes each); beyond, those seen again stay, half as many at most.
TABLE_WORDS = 400_000
#: New words encoded as one text; longer texts cost the tokenizer more a word.
TOGETHER = 256
SLICE = 2 << 20
MARKS = ".,;:!?"
#: Words on which a tokenizer must agree with its own merges of their lower case, alone and before each mark.
PROBES = ("a", "Z", "the", "Word", "QUICKLY", "zxqvwkj", "internationalisation", "ddIIllss")


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places begin[i] .. begin[i] + count[i] - 1 of every i, one after the other."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordCoder:
    """Ids of white-space separated words, each encoded by the tokenizer once while the table lasts.

    The tokenizer drops white space before it matches, so no match spans two of these words and the ids
    of a text are those of its words in order.
    """

    def __init__(self, path: str, most: int = TABLE_WORDS):
        # A forked worker must not start the library's own threads.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        # Where the tokenizer only folds the case of words of letters and parts them from marks, the merges can be asked directly.
        ids = lambda w: self.tokenizer.encode(w, add_special_tokens=False).ids
        self.marks = {m.encode(): ids(m) for m in MARKS}
        self.folds = all(self._merged(w) + m == ids(w + k.decode()) for w in PROBES for k, m in [(b"", []), *self.marks.items()])
        self.most = most
        self._reset()

    def forget(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.seen = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _shrink(self) -> None:
        seen = self.seen[: len(self.index)]
        kept = np.flatnonzero(seen > 1)
        if len(kept) > self.most // 2:
            kept = np.sort(kept[np.argsort(-seen[kept], kind="stable")[: self.most // 2]])
        names, begin, count = list(self.index), self.begin[kept], self.count[kept]
        ids = self.ids[_ranges(begin, count)]
        self._reset()
        if len(kept):
            self._store([names[i] for i in kept.tolist()], ids, count)

    def _coded(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and how many each has. Words are encoded together, apart by a control
        character whose one id shows where the next begins; words that hold it are encoded alone."""
        text = b" \x01 ".join(new)
        if text.count(b"\x01") >= len(new):
            found = [np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, np.uint32) for w in new]
            return np.concatenate(found), np.array([len(f) for f in found], np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.flatnonzero(ids == self.mark)
        sizes = np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1
        return np.delete(ids, cut), sizes

    def _merged(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word.lower())]

    def _add(self, new: list[bytes]) -> None:
        plain, rest = [], []  # of ASCII letters, with one mark behind them or none; all others
        for w in new:
            (plain if self.folds and (w.isalpha() or w[-1:] in self.marks and w[:-1].isalpha()) else rest).append(w)
        if plain:
            found = [self._merged(w.decode()) if w.isalpha() else self._merged(w[:-1].decode()) + self.marks[w[-1:]] for w in plain]
            self._store(plain, np.array([i for f in found for i in f], np.uint32), np.array([len(f) for f in found], np.int64))
        if new := rest:
            parts = [self._coded(new[i : i + TOGETHER]) for i in range(0, len(new), TOGETHER)]
            self._store(new, *(np.concatenate(x) for x in zip(*parts)))

    def _store(self, new: list[bytes], coded: np.ndarray, sizes: np.ndarray) -> None:
        have, need, flat = len(self.index), len(self.index) + len(new), len(coded)
        while need > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        while self.used + flat > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.count[have:need] = sizes
        self.begin[have:need] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + flat] = coded
        self.used += flat
        self.index.update(zip(new, range(have, need)))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and the number of ids of each text."""
        if len(self.index) > self.most:
            self._shrink()
        split = [t.split() for t in texts]
        words = [w for s in split for w in s]
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        if (unknown := np.flatnonzero(at < 0)).size:
            missing = [words[i] for i in unknown.tolist()]
            self._add(list(dict.fromkeys(missing)))
            at[unknown] = np.fromiter(map(self.index.__getitem__, missing), np.int64, len(missing))
        self.seen[: len(self.index)] += np.bincount(at, minlength=len(self.index))
        counts = self.count[at]
        ends = np.cumsum(counts)
        ids = self.ids[_ranges(self.begin[at], counts)]
        bounds = np.cumsum([0, *map(len, split)])
        ends = np.concatenate([[0], ends])
        return ids, np.diff(ends[bounds])


@lru_cache(2)
def coder(path: str) -> WordCoder:
    """The worker's tokenizer; its table of words is emptied after each task."""
    return WordCoder(path)


def cut(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, its class, block and rank there.

    A block is one task's share of the input. Written and read back before ranks are used, so that a
    repeated task can't change them.
    """
    source = docs.select("doc_id", F.col("text").alias("_text"))
    kind = "start long, length long, ids_crc32 long, doc_tokens long, class int, block int, rank long" + ", ids binary" * keep_ids
    schema = extended(source.select("doc_id"), kind)

    @tidied
    def run(batches):
        words, block = coder(path), TaskContext.get().partitionId()
        ranks = np.zeros(-(-length // CLASS_TOKENS) + 1, np.int64)
        for batch in batches:
            data, bounds = buffers(batch.column("_text"))
            for a, b in slices(np.diff(bounds), SLICE):
                raw = data[bounds[a] : bounds[b]].tobytes()
                near = (bounds[a : b + 1] - bounds[a]).tolist()
                ids, sizes = words.encode([raw[i:j] for i, j in zip(near[:-1], near[1:])])
                yield _pieces(batch.column("doc_id").slice(a, b - a), ids.astype("<u4"), sizes, ranks, block)
        words.forget()

    def _pieces(keys, ids, sizes, ranks, block):
        row, start, size, crc, kept = [], [], [], [], []
        at, last = 0, np.array([end], "<u4").tobytes()
        for i, n in enumerate(sizes.tolist()):
            raw = ids[at : at + n].tobytes() + last
            at += n
            for s in range(0, n + 1, length):
                piece = raw[4 * s : 4 * (s + length)]
                row.append(i)
                start.append(s)
                size.append(len(piece) // 4)
                crc.append(zlib.crc32(piece))
                if keep_ids:
                    kept.append(piece)
        row, size = np.array(row, np.int64), np.array(size, np.int64)
        classes = -(-size // CLASS_TOKENS)
        order = np.argsort(classes, kind="stable")
        sorted_classes = classes[order]
        first = np.searchsorted(sorted_classes, sorted_classes)
        place = np.empty(len(size), np.int64)
        place[order] = np.arange(len(size)) - first
        place += ranks[classes]
        ranks += np.bincount(classes, minlength=len(ranks))
        columns = [keys.take(pa.array(row)), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(sizes[row] + 1), pa.array(classes.astype(np.int32)), pa.array(np.full(len(row), block, np.int32)), pa.array(place)]
        return pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, schema.names)

    return source.mapInArrow(run, schema)


def price(duals: np.ndarray, widths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best pattern under the duals: unbounded knapsack by dynamic programming over capacity."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(widths)
    ordered, worth = widths[order], duals[order]
    for u in range(1, capacity + 1):
        n = int(np.searchsorted(ordered, u, "right"))
        best[u] = best[u - 1]
        if n:
            values = worth[:n] + best[u - ordered[:n]]
            j = int(values.argmax())
            if values[j] > best[u] + 1e-12:
                best[u], taken[u] = values[j], order[j]
    pattern, u = np.zeros(len(widths), np.int64), capacity
    while u > 0:
        if taken[u] < 0:
            u -= 1
        else:
            pattern[taken[u]] += 1
            u -= int(widths[taken[u]])
    return float(best[capacity]), pattern


def inverted(a: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan steps with row pivots; needs none of the threads of a linear algebra library."""
    n = len(a)
    work = np.concatenate([a.astype(float), np.eye(n)], axis=1)
    for k in range(n):
        j = k + int(np.abs(work[k:, k]).argmax())
        if j != k:
            work[[k, j]] = work[[j, k]]
        work[k] /= work[k, k]
        rest = work[:, k].copy()
        rest[k] = 0
        work -= np.outer(rest, work[k])
    return work[:, n:]


def column_generation(widths: np.ndarray, demand: np.ndarray, capacity: int, most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used by an optimal basis of the linear program.

    Prices come from slightly raised demands, no two alike, so that ties don't make the simplex cycle. A
    basis that is not optimal after `most` steps only costs padding.
    """
    m = len(widths)
    exact, demand = demand, demand * (1 + 1e-6) + np.random.default_rng(0).permutation(m) * (1e-2 / m)
    patterns = np.diag(capacity // widths).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(patterns))
    used = inverse @ demand
    for step in range(1, most + 1):
        value, column = price(inverse.sum(axis=0), widths, capacity)
        if value <= 1 + 1e-7:
            break
        change = inverse @ column
        ratio = np.full(m, np.inf)
        grows = change > 1e-9
        ratio[grows] = np.maximum(used[grows], 0) / change[grows]
        leave = int(ratio.argmin())
        patterns[leave] = column
        if step % 256 == 0:
            inverse = inverted(patterns.T)
            used = inverse @ demand
        else:
            pivot = inverse[leave] / change[leave]
            inverse -= np.outer(change, pivot)
            inverse[leave] = pivot
            used = used - change * ratio[leave]
            used[leave] = ratio[leave]
    return patterns, np.maximum(inverted(patterns.T) @ exact, 0)


def first_fit_decreasing(widths: np.ndarray, counts: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns for what rounding left over; the number of items is bounded by classes x pattern size."""
    room: list[int] = []
    bins: list[np.ndarray] = []
    for j in np.argsort(-widths):
        for _ in range(int(counts[j])):
            k = next((k for k, r in enumerate(room) if r >= widths[j]), None)
            if k is None:
                k = len(room)
                room.append(capacity)
                bins.append(np.zeros(len(widths), np.int64))
            room[k] -= int(widths[j])
            bins[k][j] += 1
    return bins


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole patterns (class -> pieces) with the number of sequences of each; places equal the histogram."""
    out = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    widths = np.array(sorted(c for c in histogram if c < capacity), np.int64)
    if not len(widths):
        return out
    left = np.array([histogram[int(w)] for w in widths], np.int64)
    patterns, used = column_generation(widths, left.astype(float), capacity)
    for pattern, times in zip(patterns, np.floor(used + 1e-9).astype(np.int64)):
        times = min([int(times), *(int(left[j] // pattern[j]) for j in np.flatnonzero(pattern))])
        if times > 0:
            left -= times * pattern
            out.append(({int(widths[j]): int(pattern[j]) for j in np.flatnonzero(pattern)}, times))
    out += [({int(widths[j]): int(b[j]) for j in np.flatnonzero(b)}, 1) for b in first_fit_decreasing(widths, left, capacity)]
    return out


def assign(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """pieces (as written by cut) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("class", "block").agg(F.count("*").alias("_n"))
    histogram = {r["class"]: r["_n"] for r in counts.groupBy("class").agg(F.sum("_n").alias("_n")).collect()}
    places: dict[int, list[tuple[int, int, int]]] = {}
    have: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan(histogram, -(-length // CLASS_TOKENS)):
        for c, n in pattern.items():
            places.setdefault(c, []).append((have.get(c, 0), n, sequence))
            have[c] = have.get(c, 0) + n * times
        sequence += times
    table = spark.sparkContext.broadcast({c: np.array(v, np.int64).T for c, v in places.items()})

    @F.pandas_udf("sequence_id long, nth long")
    def placed(classes: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        kind, rank = classes.to_numpy(), ranks.to_numpy()
        out = np.zeros((2, len(kind)), np.int64)
        for c in np.unique(kind):
            mine = np.flatnonzero(kind == c)
            first, each, base = table.value[int(c)]
            j = np.searchsorted(first, rank[mine], "right") - 1
            turn, nth = np.divmod(rank[mine] - first[j], each[j])
            out[0, mine], out[1, mine] = base[j] + turn, nth
        return pd.DataFrame({"sequence_id": out[0], "nth": out[1]})

    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = pieces.join(before, ["class", "block"]).withColumn("_p", placed("class", F.col("_before") + F.col("rank")))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "_nth").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranked.withColumns({"sequence_id": F.col("_p.sequence_id"), "_nth": F.col("_p.nth")})
        .withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
        .drop("_p", "_nth", "_before", "class", "block", "rank")
    )


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    return assign(staged(cut(docs, path, length, end, keep_ids), "pieces"), length)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (the binary ids of its pieces in order) and tokens, from pack(keep_ids=True)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    joined = F.aggregate("_parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts"), F.sum("length").alias("tokens")).select("sequence_id", joined.alias("ids"), "tokens")


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path(VOCABULARY)).select(*COLUMNS)
