"""Phrase collocation mining: PCY/DHP passes over n-grams.

One pass a phrase length. The pass over words counts them exactly and, in hashed buckets, the two-word phrases; the
pass over k-word phrases counts those exactly that may be frequent, and in buckets the phrases of k + 1 words. A phrase may be
frequent if its bucket is and, by Apriori, the phrases without its first and without its last word are; both are looked up in
broadcast bitmaps of 2**bits bits. A bitmap never denies a frequent phrase and exact counts follow, so hashes decide nothing:
they only spare work. Buckets count up to the least frequency and no further, in one byte.

A frequent phrase gets the score a * a / (l * r) of its worst cut, in millionths, and is dropped where a longer frequent one holds
it and most of its occurrences. Ranks within a language come from running sums in pieces (`prefix.running`), so no language
is one task's work.

Defined results: a null text has no words, a null language is LANGUAGE. Repeated rows all count. Pieces end at BREAKS and
with the text, words at blanks and tabs; A-Z are lower-cased, other letters are kept. Texts above SLICE bytes are cut where
pieces end. A tie of scores goes to the more frequent phrase, then to the smaller one by bytes. An empty table gives an empty
result; columns other than the text and the language are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heightline.llm.prefix import running
from heightline.llm.text import buffers, mix, slices, tidied, words
from heightline.staging import discard, staged

BREAKS = b".,;:!?\n\x0b\x0c\r"
LANGUAGE = "und"
LONGEST = 3
LEAST = 10
#: A longer phrase with this share (per cent) of a phrase's occurrences absorbs it.
ABSORBED = 50
TOP = 2000
#: Buckets: two to the power of at most MOST_BITS, a byte each in a task and a bit each in a broadcast (8 MB).
LEAST_BITS, MOST_BITS = 16, 26
#: Buckets in one row of a partial count.
BLOCK_BITS = 16
SLICE = 8 << 20

_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Slice:
    """Words of some texts in one language: dictionary (distinct, folded), code of each, hash of each, and whether the next is in its piece."""

    def __init__(self, texts: pa.Array, language: str):
        found = words(texts, _APART)
        lengths = found.stop - found.start
        full = ~_APART[found.data]
        folded = pa.py_buffer(np.ascontiguousarray(_FOLD[found.data[full]]))
        offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, offsets, folded]).dictionary_encode()
        self.dictionary, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        salt = words(pa.array([language.encode()], pa.binary()), np.zeros(256, bool)).hashes() if language else np.zeros(1, np.uint64)
        self.hashes = found.hashes(fold=True) ^ salt[0]
        ends = np.flatnonzero(_BREAK[found.data])
        piece = np.searchsorted(ends, found.start) + np.repeat(np.arange(len(texts)), np.diff(found.first))
        self.joined = np.zeros(len(lengths), bool)
        self.joined[:-1] = piece[1:] == piece[:-1]

    def gram_hashes(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; what runs past the end is zero."""
        out = self.hashes.copy()
        for t in range(1, k):
            out[:-t] = mix(out[:-t] * _STEP + self.hashes[t:])
            out[-t:] = 0
        return out

    def within(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one piece."""
        out = np.ones(len(self.codes), bool)
        for t in range(k - 1):
            out[: len(out) - t] &= self.joined[t:]
            out[len(out) - t :] = False
        return out

    def counted(self, at: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
        """The distinct phrases of k words that begin at `at`, and how often each does. Told apart by their words, not by hashes."""
        key, size = self.codes[at], max(1, len(self.dictionary))
        for t in range(1, k):
            if t > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * size + self.codes[at + t]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        parts = [self.dictionary.take(pa.array(self.codes[at[first] + t])) for t in range(k)]
        return (pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]), n


def _pieces(texts: pa.Array) -> pa.Array:
    """texts with those above SLICE bytes cut behind the last break of each stretch of so many; what has no break stays whole."""
    data, bounds = buffers(texts)
    if not len(texts) or np.diff(bounds).max() <= SLICE:
        return texts
    cuts = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        cuts.append(a)
        if b - a > SLICE:
            ends = a + np.flatnonzero(_BREAK[data[a:b]]) + 1
            while b - cuts[-1] > SLICE and len(ends) and ends[-1] > cuts[-1]:
                i = max(np.searchsorted(ends, cuts[-1] + SLICE, "right") - 1, np.searchsorted(ends, cuts[-1], "right"))
                if ends[i] >= b:
                    break
                cuts.append(int(ends[i]))
    offsets = np.array([*cuts, bounds[-1]], np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _by_language(batches):
    """(language, texts) of at most about SLICE bytes each."""
    waiting: dict[str, list[pa.Array]] = {}
    sizes: dict[str, int] = {}

    def out(language):
        texts = pa.concat_arrays(waiting.pop(language))
        sizes.pop(language)
        for a, b in slices(np.diff(buffers(texts)[1]), SLICE):
            yield language, texts.slice(a, b - a)

    for batch in batches:
        languages = batch.column(0).dictionary_encode()
        codes = languages.indices.to_numpy(zero_copy_only=False)
        for code, language in enumerate(languages.dictionary.to_pylist()):
            texts = batch.column(1).filter(pa.array(codes == code)).cast(pa.large_string()).fill_null("")
            texts = _pieces(texts)
            waiting.setdefault(language, []).append(texts)
            sizes[language] = sizes.get(language, 0) + int(np.diff(buffers(texts)[1]).sum()) + len(texts)
            if sizes[language] >= SLICE // 2:
                yield from out(language)
        while sum(sizes.values()) > 2 * SLICE:
            yield from out(max(sizes, key=sizes.get))
    for language in list(waiting):
        yield from out(language)


def _rows(kind: int, languages, phrases, counts, blocks, payloads) -> pa.RecordBatch:
    n = max(len(phrases), len(blocks))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), languages if kind == 0 else pa.nulls(n, pa.string()), pc.cast(phrases, pa.string()) if kind == 0 else pa.nulls(n, pa.string()), pa.array(counts, pa.int64()) if kind == 0 else pa.nulls(n, pa.int64()), pa.array(blocks, pa.int32()) if kind else pa.nulls(n, pa.int32()), pa.array(payloads, pa.binary()) if kind else pa.nulls(n, pa.binary())],
        PASS_NAMES,
    )


PASS_NAMES = ["kind", "lang", "phrase", "n", "block", "payload"]
PASS = "kind int, lang string, phrase string, n long, block int, payload binary"


def _blocks(seen: np.ndarray):
    """Rows of a table of byte counts: a block's places and counts, packed."""
    coder = zstandard.ZstdCompressor(level=1)
    size = 1 << BLOCK_BITS
    blocks, payloads = [], []
    for a in range(0, len(seen), size):
        used = np.flatnonzero(seen[a : a + size])
        if len(used):
            blocks.append(a // size)
            payloads.append(coder.compress(used.astype(np.uint16).tobytes() + seen[a : a + size][used].tobytes()))
        if len(blocks) == 256:
            yield _rows(1, None, [], None, blocks, payloads)
            blocks, payloads = [], []
    if blocks:
        yield _rows(1, None, [], None, blocks, payloads)


def _add(seen: np.ndarray, buckets: np.ndarray, least: int) -> None:
    u, n = np.unique(buckets, return_counts=True)
    seen[u] = np.minimum(seen[u] + np.minimum(n, least), least)


def bitmap(partial: DataFrame, bits: int, least: int) -> np.ndarray:
    """Packed bits of the buckets whose partial counts (block, payload) add up to least; 2**bits bits whatever the corpus."""
    size = 1 << min(BLOCK_BITS, bits)

    @tidied
    def merge(batches):
        coder = zstandard.ZstdDecompressor()
        block, seen = None, np.zeros(size, np.int64)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(seen >= least).tobytes()], pa.binary())], ["block", "bits"])
        for batch in batches:
            for own, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != block:
                    if block is not None:
                        yield done()
                    block, seen = own, np.zeros(size, np.int64)
                raw = coder.decompress(packed.as_buffer())
                n = len(raw) // 3
                seen[np.frombuffer(raw, np.uint16, n)] += np.frombuffer(raw, np.uint8, n, 2 * n)
        if block is not None:
            yield done()

    dealt = partial.select("block", "payload").repartition("block").sortWithinPartitions("block")
    found = dealt.mapInArrow(merge, "block int, bits binary").toArrow()  # 2**bits bits
    out = np.zeros(max(1, (1 << bits) // size), (np.void, size // 8))
    for block, packed in zip(found.column("block").to_pylist(), found.column("bits").to_pylist()):
        out[block] = packed
    return out.view(np.uint8).reshape(-1)


def _held(bits: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bits[buckets >> 3] >> (7 - (buckets & 7)).astype(np.uint8) & 1).astype(bool)


def _pass(texts: DataFrame, k: int, bits: int, least: int, known, likely, more: bool) -> DataFrame:
    """Partial counts of phrases of k words (kind 0) and, if more, of buckets of k + 1 words (kind 1). texts: lang, text."""
    cut = np.uint64(64 - bits)

    @tidied
    def run(batches):
        seen = np.zeros(1 << bits if more else 0, np.uint8)
        for language, part in _by_language(batches):
            own = Slice(part, language)
            if not len(own.codes):
                continue
            bucket = lambda i: (own.gram_hashes(i) >> cut).astype(np.int64)
            keep = own.within(k)
            if k > 1:
                shorter = _held(known.value, bucket(k - 1))
                keep[:-1] &= shorter[:-1] & shorter[1:]
                keep &= _held(likely.value, bucket(k))
            at = np.flatnonzero(keep)
            if len(at):
                phrases, n = own.counted(at, k)
                yield _rows(0, pa.array([language]).take(pa.array(np.zeros(len(n), np.int32))), phrases, n, [], None)
            if more:
                longer = own.within(k + 1)
                longer[:-1] &= keep[:-1] & keep[1:]
                _add(seen, bucket(k + 1)[longer], least)
        if more:
            yield from _blocks(seen)

    return texts.mapInArrow(run, PASS)


def _known(counts: DataFrame, bits: int, least: int) -> DataFrame:
    """Partial bucket counts that mark the phrases of counts (lang, phrase), all of one length."""
    cut = np.uint64(64 - bits)

    @tidied
    def run(batches):
        seen = np.zeros(1 << bits, np.uint8)
        for language, part in _by_language(batches):
            own = Slice(part, language)
            first = words(part, _APART).first
            k = int(np.diff(first).max(initial=0))
            if k:
                seen[(own.gram_hashes(k)[first[:-1]] >> cut).astype(np.int64)] = least
        yield from _blocks(seen)

    return counts.select("lang", "phrase").mapInArrow(run, PASS).where("kind = 1")


def frequent(docs: DataFrame, text: str = "text", language: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, f of every phrase of up to `longest` words that occurs `least` times in its language; lang and n of all words."""
    if not 0 < least < 256:
        raise ValueError("the least frequency must fit a byte")
    texts = docs.select(F.coalesce(F.col(language), F.lit(LANGUAGE)).alias("lang"), F.col(text).alias("phrase"))
    size = texts.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(size / 6 + 1))))
    sc = docs.sparkSession.sparkContext
    known = likely = totals = None
    levels = []
    for k in range(1, longest + 1):
        more = k < longest
        partial = staged(_pass(texts, k, bits, least, known, likely, more), f"pass{k}")
        counts = partial.where("kind = 0").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if k == 1:
            totals = staged(partial.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        levels.append(staged(counts.where(F.col("f") >= least).withColumn("words", F.lit(k)), f"level{k}"))
        if more:
            known = sc.broadcast(bitmap(_known(levels[-1], bits, least), bits, least))
            likely = sc.broadcast(bitmap(partial.where("kind = 1"), bits, least))
        discard(partial)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found, totals


def collocations(docs: DataFrame, text: str = "text", language: str = "lang", longest: int = LONGEST, least: int = LEAST, absorbed: int = ABSORBED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases."""
    counts, totals = frequent(docs, text, language, longest, least)
    own = counts.where("words > 1")
    split = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice("_w", start, length), " ")
    cuts = own.withColumn("_w", split).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "_k", part(F.lit(1), F.col("_k")).alias("_first"), part(F.col("_k") + 1, F.col("words") - F.col("_k")).alias("_rest"))
    of = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    sided = cuts.join(of("_first", "l"), ["lang", "_first"]).join(of("_rest", "r"), ["lang", "_rest"])
    # 15 digits each, so that a * a * 1000000 has 38 at most; `div` keeps the quotient whole.
    digits = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    scored = sided.withColumn("score", F.call_function("div", digits["a"] * digits["a"] * F.lit(1_000_000).cast("decimal(7,0)"), digits["l"] * digits["r"]).cast("long"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "_k", "a", "l", "r")).alias("_c"))
    lengths = F.sequence(F.lit(2), F.col("words") - 1)
    parts = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda s: F.array_join(F.slice("_w", s, m), " "))))
    inside = own.where("words > 2").withColumn("_w", split).select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_f"))
    kept = worst.join(inside, ["lang", "phrase"], "left").where(F.coalesce(F.col("_f") * 100 < F.col("_c.a") * absorbed, F.lit(True)))
    rows = kept.select("lang", "phrase", "_c.a", "_c.l", "_c.r", "_c.score", F.lit(1).cast("long").alias("_one"))
    ranked = running(rows, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], {"_before": "_one"}).where(F.col("_before") < top)
    return ranked.join(totals, "lang").select("lang", (F.col("_before") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k)
), c AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10
), n AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang HAVING sum(len(ws)) > 0
), cuts AS (
  SELECT lang, k, phrase, f, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS x, array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS y
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c WHERE k > 1)
), s AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, cuts.f AS a, a.f AS l, b.f AS r, cut, (1000000::HUGEINT * cuts.f * cuts.f // (a.f::HUGEINT * b.f))::BIGINT AS score
  FROM cuts JOIN c a ON a.lang = cuts.lang AND a.phrase = x JOIN c b ON b.lang = cuts.lang AND b.phrase = y
), one AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), kept AS (
  SELECT * FROM one WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.k = 3 AND one.k = 2 AND c.lang = one.lang AND 100 * c.f >= 50 * one.a
    AND one.phrase IN (array_to_string(string_split(c.phrase, ' ')[1:2], ' '), array_to_string(string_split(c.phrase, ' ')[2:3], ' ')))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
