"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the corpus itself. Its index posts, for every text, anchors: of each window of WINDOW
words the leftmost smallest hash of ANCHOR consecutive words, so equal windows have equal anchors. The
index is split by hash into blocks, and every anchor of every text is looked up in the block that would
hold it, which names the smallest document that has it. A text is then parsed greedily: a factor goes on
as long as its anchors point at the same earlier document at the same distance. Anchors are never further
apart than they are long, so a factor is a proven copy of all its words; factors of at least WINDOW words
become duplicate spans. Windows at factor boundaries, which no factor holds whole, are checked by two
64-bit hashes against the windows of all other texts that no factor holds. The first occurrence of a
window is never inside a factor, so this finds exactly the windows that an earlier document has.

Texts of equal words are parsed once, for the smallest document id. Nothing is kept per pair. Anchors that many
texts share, and windows that one text repeats, are gathered before they are shuffled.

Defined results: a null text has no words. A null doc_id is neither removed from nor a reference. Rows
that repeat an id don't count as earlier than each other; each row gets the result for its own text.
Words are the runs of bytes other than 0x20 and 0x09-0x0D; texts of any length are one row. An empty table
gives an empty result. Columns of other names are carried by `without_duplicates`, whatever they are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heightline.llm.columns import spare
from heightline.staging import discard, extended, staged
from heightline.llm.text import buffers, grams, slices, tidied, words

WINDOW = 50
ANCHOR = 26
SPREAD = WINDOW - ANCHOR + 1
SLICE = 4 << 20
#: Up to so many anchors that texts share (about 70 bytes each in memory) their index is broadcast; beyond, it is shuffled.
BROADCAST_ANCHORS = 200_000


def digest(raw: bytes) -> bytes:
    return hashlib.sha256(b" ".join(raw.split())).digest()


def tag_of(sha: bytes) -> int:
    """Tells texts under one id apart."""
    return int.from_bytes(sha[:4], "little", signed=True)


def leftmost_minima(g: np.ndarray, width: int) -> np.ndarray:
    """For each i the leftmost place of the smallest of g[i:i+width]; the last width - 1 are unused."""
    n = len(g)
    best, have = np.arange(n), 1

    def merged(step: int) -> np.ndarray:
        right = np.concatenate([best[step:], np.full(min(step, n), n - 1)])[:n]
        return np.where(g[right] < g[best], right, best)

    while have * 2 <= width:
        best = merged(have)
        have *= 2
    return merged(width - have) if have < width else best


def anchored(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the anchor of each, and the hashes of ANCHOR words at every place."""
    g = grams(h, ANCHOR, 1)
    sizes = np.diff(first)
    windows = np.flatnonzero(np.arange(len(h)) + WINDOW <= np.repeat(first[1:], sizes))
    return windows, leftmost_minima(g, SPREAD)[windows] if len(windows) else windows, g


def profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, sha (of the words joined by blanks), its tag, n_words, and of each anchor hash and place."""
    source = docs.select("doc_id", F.col(text).alias("_text"))
    schema = extended(source.select("doc_id"), "sha binary, tag int, n_words long, hashes array<long>, places array<int>")

    @tidied
    def run(batches):
        for batch in batches:
            column = batch.column("_text")
            for a, b in slices(np.diff(buffers(column)[1]), SLICE):
                found = words(column.slice(a, b - a))
                windows, anchor, g = anchored(found.first, found.hashes())
                places = np.unique(anchor)
                owner = np.searchsorted(found.first, places, "right") - 1
                offsets = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
                raw, bounds = found.data.tobytes(), found.bounds.tolist()
                sha = [digest(raw[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(sha, pa.binary()), pa.array(map(tag_of, sha), pa.int32()), pa.array(np.diff(found.first)), pa.ListArray.from_arrays(offsets, pa.array(g[places].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array((places - found.first[owner]).astype(np.int32)))],
                    schema.names,
                )

    return source.mapInArrow(run, schema)


def postings(texts: DataFrame) -> DataFrame:
    """hash and entries (doc_id, place, tag) of texts (doc_id, tag, hashes, places): one row a hash and batch of
    texts, so that an anchor which very many texts have is few rows."""
    source = texts.select("doc_id", "tag", "hashes", "places")
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"hash long, entries array<struct<doc_id: {kind}, place: int, tag: int>>")

    @tidied
    def run(batches):
        for batch in batches:
            hashes, places = batch.column("hashes"), batch.column("places")
            owner = np.repeat(np.arange(len(batch)), np.diff(hashes.offsets.to_numpy()))
            flat = hashes.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(flat, kind="stable")
            own, first = np.unique(flat[order], return_index=True)
            owner = pa.array(owner[order])
            entries = pa.StructArray.from_arrays([batch.column("doc_id").take(owner), places.flatten().take(pa.array(order)), batch.column("tag").take(owner)], ["doc_id", "place", "tag"])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)).astype(np.int32)), entries)], ["hash", "entries"])

    return source.mapInArrow(run, schema)


def compressed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the zstd-compressed words of each text, so that a shuffle moves less."""
    source = docs.select("doc_id", F.col(text).alias("_text"))

    @tidied
    def run(batches):
        coder = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, bounds = buffers(batch.column("_text"))
            raw, at = data.tobytes(), bounds.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([coder.compress(raw[i:j]) for i, j in zip(at[:-1], at[1:])], pa.binary())], ["doc_id", "packed"])

    return source.mapInArrow(run, extended(source.select("doc_id"), "packed binary"))


def factors(places: np.ndarray, ref: np.ndarray, at: np.ndarray, every: np.ndarray) -> list[tuple[int, int]]:
    """Greedy parse of one text: spans copied whole from one earlier document.

    places: those of its anchors that an earlier document has, with that document and the place there;
    every: the places of all its anchors. A factor breaks where an anchor is not found, or is found
    elsewhere.
    """
    if not len(places):
        return []
    rank = np.searchsorted(every, places)
    joined = (np.diff(rank) == 1) & (ref[1:] == ref[:-1]) & (np.diff(at) == np.diff(places))
    edges = np.flatnonzero(~joined) + 1
    starts, stops = places[np.concatenate([[0], edges])], places[np.concatenate([edges, [len(places)]]) - 1] + ANCHOR
    return [(a, b) for a, b in zip(starts.tolist(), stops.tolist()) if b - a >= WINDOW]


PARSED = "tag int, wa long, wb long, spans array<struct<start: int, stop: int>>"


def parse(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Factors (wa null) and boundary windows of each text that shares an anchor with another: one row a text
    and different window, with the spans that its places cover.

    texts: doc_id, packed; found: doc_id, tag and hits, an array of (place, ref, at).
    """
    joined = texts.join(found.hint("shuffle_hash"), "doc_id")
    schema = extended(texts.select("doc_id"), PARSED)

    @tidied
    def run(batches):
        coder = zstandard.ZstdDecompressor()
        for batch in batches:
            keys, ids = batch.column("doc_id"), batch.column("doc_id").to_pylist()
            hits = batch.column("hits")
            at = hits.offsets.to_numpy()
            place, ref, there = (hits.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            out: list[tuple] = []
            for i, (packed, tag) in enumerate(zip(batch.column("packed").to_pylist(), batch.column("tag").to_pylist())):
                raw = coder.decompress(packed)
                if tag_of(digest(raw)) != tag:
                    continue  # another text under the same id
                w = words(pa.array([raw], pa.binary()))
                h = w.hashes()
                windows, anchor, _ = anchored(w.first, h)
                own, first = np.unique(place[at[i] : at[i + 1]], return_index=True)
                r, t = ref[at[i] : at[i + 1]][first], there[at[i] : at[i + 1]][first]
                earlier = r < ids[i]
                spans = factors(own[earlier], r[earlier], t[earlier], np.unique(anchor))
                held = np.zeros(len(h) + 1, np.int32)
                for a, b in spans:
                    held[a] += 1
                    held[b - WINDOW + 1] -= 1
                open_ = windows[np.isin(anchor, own) & (np.cumsum(held)[windows] == 0)]
                out.append((i, tag, spans, *alike(open_, grams(h, WINDOW, 2)[open_], grams(h, WINDOW, 3)[open_])))
                if sum(len(x[4]) + len(x[2]) for x in out) > 100_000:
                    yield _rows(keys, out)
                    out = []
            yield _rows(keys, out)

    def _rows(keys, out):
        row, tags, wa, wb, gap, counts, start, stop = [], [], [], [], [], [], [], []
        for i, tag, spans, a, b, n, s, e in out:
            more = int(bool(spans))  # all factors of a text are one row
            row.append(np.full(more + len(a), i))
            tags.append(np.full(more + len(a), tag))
            gap.append(np.arange(more + len(a)) < more)
            wa.append(np.concatenate([np.zeros(more, np.int64), a]))
            wb.append(np.concatenate([np.zeros(more, np.int64), b]))
            counts.append(np.concatenate([np.full(more, len(spans)), n]))
            start.append(np.concatenate([np.array([x for x, _ in spans], np.int64), s]))
            stop.append(np.concatenate([np.array([x for _, x in spans], np.int64), e]))
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        none = join(gap, bool)
        lists = pa.StructArray.from_arrays([pa.array(join(start, np.int32)), pa.array(join(stop, np.int32))], ["start", "stop"])
        offsets = pa.array(np.concatenate([[0], np.cumsum(join(counts, np.int64))]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(join(row, np.int64))), pa.array(join(tags, np.int32)), pa.array(join(wa, np.int64), mask=none), pa.array(join(wb, np.int64), mask=none), pa.ListArray.from_arrays(offsets, lists)],
            schema.names,
        )

    return joined.mapInArrow(run, schema)


def alike(at: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different windows (a, b) of one text, the number of spans of each, and their starts and stops: places of
    a window that overlap or touch are one span."""
    order = np.lexsort((at, b, a))
    at, a, b = at[order], a[order], b[order]
    fresh = np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0))[: len(at)]
    first = np.flatnonzero(fresh | np.append(True, np.diff(at) > WINDOW)[: len(at)])
    last = np.append(first[1:], len(at))[: len(first)] - 1
    heads = np.flatnonzero(fresh)
    counts = np.diff(np.append(np.searchsorted(first, heads), len(first)))
    return a[heads].view(np.int64), b[heads].view(np.int64), counts, at[first], at[last] + WINDOW


def covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    held = np.zeros(n + 1, np.int64)
    for a, b in spans:
        held[a] += 1
        held[b] -= 1
    return np.cumsum(held)[:n] > 0


def duplicate_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profile of all rows, and of each text with duplicate words doc_id, tag and its spans."""
    rows = staged(profile(docs), "profile")
    # One text of each wording, under its smallest id, is parsed; of the others every window recurs there.
    texts = rows.where(f"doc_id is not null and n_words >= {WINDOW}").groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.first("tag").alias("tag"), F.first("hashes").alias("hashes"), F.first("places").alias("places"))
    anchors = staged(postings(texts), "anchors")
    index = anchors.groupBy("hash").agg(F.min(F.array_min("entries")).alias("lo"), F.max(F.array_max("entries")["doc_id"]).alias("hi")).where("lo.doc_id < hi")
    # Written, so that a join with it can split a hash which a third of all texts have.
    index = staged(index.select("hash", F.col("lo.doc_id").alias("ref"), F.col("lo.place").alias("at")), "index")
    # Few shared anchors go to every task, which spares the shuffle of all of them.
    small = index.limit(BROADCAST_ANCHORS + 1).count() <= BROADCAST_ANCHORS
    found = anchors.join(F.broadcast(index) if small else index, "hash").select(F.explode("entries").alias("e"), "ref", "at")
    hits = found.groupBy("e.doc_id", "e.tag").agg(F.collect_list(F.struct("e.place", "ref", "at")).alias("hits"))
    parsed = staged(parse(compressed(docs.where("doc_id is not null")), hits), "parsed")
    discard(anchors, index)
    windows = parsed.where("wa is not null")
    earliest = windows.groupBy("wa", "wb").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("hi")).where("ref < hi").drop("hi")
    earliest = staged(earliest, "earliest")
    repeated = windows.join(earliest, ["wa", "wb"]).where("doc_id > ref").select("doc_id", "tag", "spans")
    spans = repeated.unionByName(parsed.where("wa is null").select("doc_id", "tag", "spans")).groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return rows, spans


def _firsts(rows: DataFrame) -> DataFrame:
    """The smallest doc_id of each wording that is long enough to lose words, where there are several."""
    own = rows.where(f"doc_id is not null and n_words >= {WINDOW}").groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last"))
    return staged(own.where("first < _last").drop("_last"), "firsts")


def _kept(raw: bytes, spans) -> tuple[int, bytes]:
    split = raw.split()
    gone = covered([(s["start"], s["stop"]) for s in spans], len(split))
    return int(gone.sum()), b" ".join(w for w, g in zip(split, gone.tolist()) if not g)


def dedup(docs: DataFrame) -> DataFrame:
    """Of each row of docs: doc_id, n_words, n_removed and the sha256 of the words that stay."""
    rows, spans = duplicate_spans(docs.select("doc_id", "text"))
    firsts = _firsts(rows)
    schema = extended(docs.select("doc_id"), "sha binary, n_removed long, kept string")

    @tidied
    def cut(batches):
        coder = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, tag, own in zip(*(batch.column(c).to_pylist() for c in ("packed", "tag", "spans"))):
                raw = coder.decompress(packed)
                sha = digest(raw)
                if tag_of(sha) != tag:
                    out.append((None, None, None))
                    continue
                n, kept = _kept(raw, own)
                out.append((sha, n, hashlib.sha256(kept).hexdigest()))
            a, b, c = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.string())], schema.names)

    cuts = compressed(docs.where("doc_id is not null")).join(spans.hint("shuffle_hash"), "doc_id").mapInArrow(cut, schema).where("sha is not null").dropDuplicates(["doc_id", "sha"])
    full = F.lower(F.hex("sha"))
    later = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= WINDOW)
    return (
        rows.select("doc_id", "sha", "n_words")
        .join(firsts, "sha", "left")
        .join(cuts, ["doc_id", "sha"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(later, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(later, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", full)).alias("kept_sha256"),
        )
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs with every duplicate word cut from its text; the bytes between the words that stay are kept.

    A text that loses words is their remaining runs, each with the white space inside it, joined by the
    white space before the next run. Other columns are carried.
    """
    rows, spans = duplicate_spans(docs.select("doc_id", "text"))
    firsts = _firsts(rows)
    later = rows.select("doc_id", "sha", "tag", "n_words").join(firsts, "sha").where("doc_id > first").select("doc_id", "tag", F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("stop"))).alias("spans"))
    own = spans.unionByName(later).groupBy("doc_id").agg(F.collect_set(F.struct("tag", "spans")).alias("_cuts"))
    rest = [c for c in docs.columns if c != "text"]
    ident, cuts = spare(docs.columns, "_id"), spare(docs.columns, "_cuts")
    joined = docs.select(*rest, "text").join(own.toDF(ident, cuts).hint("shuffle_hash"), F.col("doc_id") == F.col(ident), "left").select(*rest, "text", cuts)

    @tidied
    def cut(batches):
        for batch in batches:
            texts = [_remaining(t, c) if c and t else t for t, c in zip(batch.column("text").to_pylist(), batch.column(cuts).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string())], [*rest, "text"])

    return joined.mapInArrow(cut, joined.drop(cuts).schema).select(docs.columns)


def _remaining(text: str, cuts) -> str:
    raw = text.encode()
    tag = tag_of(digest(raw))
    spans = next((c["spans"] for c in cuts if c["tag"] == tag), None)
    if not spans:
        return text
    w = words(pa.array([raw], pa.binary()))
    gone = covered([(s["start"], s["stop"]) for s in spans], len(w.start))
    kept = np.flatnonzero(~gone)
    if not len(kept):
        return ""
    # Each kept word takes along the white space before it, but for the first one.
    before = np.where(kept > 0, w.stop[np.maximum(kept - 1, 0)], 0)
    before[0] = w.start[kept[0]]
    return b"".join(raw[a:b] for a, b in zip(before.tolist(), w.stop[kept].tolist())).decode()


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT r, doc_id, unnest(generate_series(1, len(ws) - 49)) AS i, ws FROM w WHERE len(ws) >= 50
), windows AS (
  SELECT r, doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h FROM starts
), firsts AS (
  SELECT h, min(doc_id) AS d FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT r, i + unnest(generate_series(0, 49)) AS i FROM (SELECT r, i FROM windows JOIN firsts USING (h) WHERE doc_id > d)
), kept AS (
  SELECT w.r, list(word ORDER BY k) FILTER (WHERE g.i IS NULL) AS ks, count(g.i) AS n
  FROM (SELECT r, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS k FROM w) w LEFT JOIN gone g ON w.r = g.r AND w.k = g.i GROUP BY w.r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(array_to_string(coalesce(ks, []), ' ')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""
