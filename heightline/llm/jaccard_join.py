"""N-gram Jaccard join: a size-aware heavy-light join of sets of word shingles.

Small sets enumerate their subsets of the fixed size that a linked pair must share, so two small sets link
exactly if they meet in one subset. Subsets meet by two independent hashes, and every such pair is checked on its words. Large sets are found by scanning inverted lists, of the rarest part of
each set that any linked partner must touch. The boundary between small and large is where enumerating
costs more postings than scanning and checking. Sets near the boundary take both ways, for partners on
either side.

Rarity comes from counts of all shingles of the corpus in 2**BITS buckets; any order would give the same
links, a good one gives short lists. A posting has the place of its shingle in the set's order: two sets
whose first common shingle is this one have at most what follows it in common, so pairs for which that is
too little are never made. Nor are those that differ in too many of SKETCH bits, each the parity of a set's
shingles in one bucket, for sets differ in at least as many shingles. Equal sets are one class: their keys and a second,
independent hash agree, and a key that several sets share by chance is split. In a list, every set is first checked against HEADS
sets of the list, the same ones in all lists that hold them; sets that these links join need no further
check, and only pairs of different components that still share a list are checked in a second round. So no
list emits all its pairs unless they are all apart and alike, and no link between components is lost.
Components come from alternating star contractions of the links, in the shared folder.

Defined results: null and empty texts have no shingles and link with nothing. Fewer words than SHINGLE are
one shingle. Rows that repeat a doc_id are one document with the links of all; a row without doc_id links
with nothing and has no component. Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased, of
texts of any length. An empty table gives an empty result; other columns are carried by `one_of_each` alone.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heightline.llm.substring_dedup import compressed
from heightline.llm.text import Words, buffers, grams, mix, slices, tidied, words
from heightline.operators.graph import components
from heightline.staging import discard, extended, staged

SHINGLE = 5
BITS = 18
#: What checking one candidate costs, in postings.
CHECK_COST = 40
SLICE = 4 << 20
SKETCH = 512
#: Sets of a list that all others are checked against first.
HEADS = 16
LOW, HIGH, SAME = 0, 1, 2


def least_overlap(n: int, m: int) -> int:
    """Smallest intersection of linked sets of n and m: 100 * i >= 80 * (n + m - i)."""
    return -(-4 * (n + m) // 9)


def partners(n: int) -> range:
    return range(-(-4 * n // 5), 5 * n // 4 + 1)


def subset_sizes(n: int, boundary: int) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, subset size) for each size of small partner; equal sets need none."""
    out = []
    for m in partners(n):
        c = least_overlap(n, m)
        if m <= boundary and c <= min(n, m) and not c == n == m:
            out.append((min(n, m), max(n, m), c))
    return out


def boundary() -> int:
    """Largest set size at which enumerating subsets is no dearer than scanning lists."""
    n = 1
    while sum(math.comb(n + 1, c) for *_, c in subset_sizes(n + 1, n + 1)) <= prefix(n + 1) + CHECK_COST:
        n += 1
    return n


def prefix(n: int) -> int:
    """Length of the part of a set that every linked partner's part touches."""
    return n - -(-4 * n // 5) + 1


def shingles(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle, and of each text the index of its first one; with repeats."""
    h = found.hashes(fold=True)
    sizes = np.diff(found.first)
    short = (sizes > 0) & (sizes < SHINGLE)
    full = np.arange(len(h)) + SHINGLE <= np.repeat(found.first[1:], sizes)
    g = grams(h, SHINGLE, 5)
    for k in range(1, SHINGLE):
        at = found.first[:-1][short & (sizes == k)]
        if len(at):
            g[at] = grams(h, k, 10 + k)[at]
            full[at] = True
    counts = np.where(short, 1, np.maximum(sizes - SHINGLE + 1, 0))
    return g[full], np.concatenate([[0], np.cumsum(counts)])


def _texts(batch, column: str):
    for a, b in slices(np.diff(buffers(batch.column(column))[1]), SLICE):
        yield a, b, *shingles(words(batch.column(column).slice(a, b - a)))


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket of shingles occurs in all documents."""

    @tidied
    def run(batches):
        seen = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for *_, g, _ in _texts(batch, "text"):
                seen += np.bincount((g >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[used])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2**BITS rows
    out = np.zeros(1 << BITS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def signatures(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """doc_id, n (set size), key and check (of the set), tokens for the inverted lists, subsets of small sets.

    key_bits: of keys of sets and subsets, so that tests can make them meet by chance.
    """
    rank = np.argsort(np.argsort(bucket_counts(docs), kind="stable"), kind="stable").astype(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(rank)  # 2 MB at any size
    most = boundary()
    source = docs.select("doc_id", F.col("text").alias("_text"))
    schema = extended(source.select("doc_id"), "n long, key long, check long, bits array<long>, tokens array<long>, subsets array<long>, seconds array<long>")
    few = (1 << key_bits) - 1

    @tidied
    def run(batches):
        for batch in batches:
            for a, b, g, first in _texts(batch, "_text"):
                sizes, keys, checks, bits, tokens, subsets, seconds = [], [], [], [], [], [], []
                for i in range(b - a):
                    own = np.unique(g[first[i] : first[i + 1]])
                    n = len(own)
                    sizes.append(n)
                    keys.append(set_key(own, few) if n else None)
                    checks.append(set_key(mix(own ^ _OTHER)) if n else None)
                    bits.append(sketch(own))
                    lists = n and 5 * n // 4 > most
                    if lists:
                        order = np.lexsort((own, shared.value[(own >> np.uint64(64 - BITS)).astype(np.int64)]))
                        tokens.append(own[order[: prefix(n)]].view(np.int64))
                    else:
                        tokens.append(np.empty(0, np.int64))
                    both = small_keys(own, most, few) if 0 < n <= most else (np.empty(0, np.int64),) * 2
                    subsets.append(both[0])
                    seconds.append(both[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(checks, pa.int64()), _lists(bits), _lists(tokens), _lists(subsets), _lists(seconds)], schema.names
                )

    return source.mapInArrow(run, schema)


_OTHER = np.uint64(0x5851F42D4C957F2D)
_ALL = (1 << 64) - 1


def set_key(own: np.ndarray, few: int = _ALL) -> int:
    """One hash of a set, whatever its order."""
    both = np.bitwise_xor.reduce(mix(own + np.uint64(1)), keepdims=True) ^ own.sum(dtype=np.uint64, keepdims=True) * np.uint64(3)
    return int((mix(both) & np.uint64(few)).view(np.int64)[0])


def sketch(own: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of SKETCH buckets, packed into longs."""
    odd = np.bincount((own & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def small_keys(own: np.ndarray, most: int, few: int = _ALL) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the subsets of a small set, with its role in the two low bits: LOW and HIGH for the smaller
    and larger of two sizes, SAME for equal ones; and a second key of each. Sets link that meet in both keys, but for two of
    one role that is not SAME."""
    out, more = [], []
    spread = mix(own)
    for low, high, c in subset_sizes(len(own), most):
        picks = np.array(list(itertools.combinations(range(len(own)), c)), np.int64)
        role = SAME if low == high else LOW if len(own) == low else HIGH
        kind = np.uint64(low << 40 | high << 20 | c)
        keys = mix(spread[picks].sum(axis=1, dtype=np.uint64) + kind)
        out.append(keys & np.uint64(few) & ~np.uint64(3) | np.uint64(role))
        more.append(mix(mix(own ^ _OTHER)[picks].sum(axis=1, dtype=np.uint64) ^ kind))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    both = np.unique(np.column_stack([np.concatenate(out), np.concatenate(more)]), axis=0)
    return both[:, 0].copy().view(np.int64), both[:, 1].copy().view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


#: What two postings (n, rest) and (_m, _rest) of a list need for a link whose first common shingle is the list's.
_FITS = "9 * least(rest, _rest) >= 4 * (n + _m) and 5 * least(n, _m) >= 4 * greatest(n, _m)"
#: What two sketches need for a link.
_NEAR = f"n + _m >= 9 * ({' + '.join(f'bit_count(bits[{i}] ^ _bits[{i}])' for i in range(SKETCH // 64))})"


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets link. texts: key, packed."""
    left, right = texts.select(F.col("key").alias("a"), F.col("packed").alias("_l")), texts.select(F.col("key").alias("b"), F.col("packed").alias("_r"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "_l", "_r")

    @tidied
    def run(batches):
        coder = zstandard.ZstdDecompressor()
        last: dict[int, np.ndarray] = {}

        def own(key, packed):
            if key not in last:
                if len(last) > 64:
                    last.clear()
                last[key] = np.unique(shingles(words(pa.array([coder.decompress(packed)], pa.binary())))[0])
            return last[key]

        for batch in batches:
            keep = []
            for a, b, l, r in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = own(a, l), own(b, r)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (signatures) with base, the key that they had, and a key that is one set's alone; and one row a key."""
    rows = rows.withColumn("base", F.col("key"))
    while True:
        groups = rows.where("doc_id is not null and n > 0").groupBy("key")
        kept = [F.first(c).alias(c) for c in ("base", "check", "n", "bits", "tokens", "subsets", "seconds")]
        sets = staged(groups.agg(F.min("doc_id").alias("doc_id"), F.min("check").alias("_lo"), F.max("check").alias("_hi"), *kept), "sets")
        shared = sets.where("_lo <> _hi").select("key", F.lit(True).alias("_shared"))
        if shared.isEmpty():
            return rows, sets
        split = rows.join(shared, "key", "left").withColumn("key", F.when(F.col("_shared"), F.xxhash64("key", "check")).otherwise(F.col("key"))).drop("_shared")
        rows = staged(split, "signatures")
        discard(sets)


def links(docs: DataFrame, key_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """All rows with n and key; and links between keys, enough of them for all components."""
    rows, sets = classes(staged(signatures(docs, key_bits), "signatures"))
    small = sets.select(F.explode(F.arrays_zip("subsets", "seconds")).alias("_s"), "key").select(F.expr("_s.subsets & ~3L").alias("subset"), F.col("_s.seconds").alias("second"), F.expr("_s.subsets & 3L").alias("role"), "key")
    lowest = lambda role: F.min(F.when(F.col("role") != role, F.col("key")))
    ends = small.groupBy("subset", "second").agg(lowest(HIGH).alias("lo"), lowest(LOW).alias("hi"), F.count("*").alias("_n")).where("_n > 1 and lo is not null and hi is not null").drop("_n")
    ends = staged(ends, "ends")
    by_subset = small.join(ends, ["subset", "second"]).select(F.col("key").alias("a"), F.when(F.col("role") == LOW, F.col("hi")).otherwise(F.col("lo")).alias("b")).where("a <> b")
    by_subset = staged(by_subset.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "subset-pairs")
    discard(ends)

    # A posting has what its set holds from the shingle on: rest = n - place.
    posted = sets.select("n", "key", F.posexplode("tokens").alias("place", "token")).select("token", F.col("n").cast("int"), (F.col("n") - F.col("place")).cast("int").alias("rest"), "key")
    met = staged(posted.groupBy("token").agg(F.count("*").alias("_n")).where("_n > 1").select("token"), "met")
    lists = staged(posted.join(met, "token"), "lists")
    discard(met)
    order = Window.partitionBy("token").orderBy(F.xxhash64("key"))
    heads = lists.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= HEADS).select("token", F.col("n").alias("_m"), F.col("rest").alias("_rest"), F.col("key").alias("head"))
    heads = staged(heads, "heads")  # so that a join with them can split a list which a third of all sets are in
    near = lists.join(heads, "token").where(f"key <> head and {_FITS}").select(F.least("key", "head").alias("a"), F.greatest("key", "head").alias("b")).distinct()
    one, two = sets.select(F.col("key").alias("a"), "n", "bits"), sets.select(F.col("key").alias("b"), F.col("n").alias("_m"), F.col("bits").alias("_bits"))
    near = staged(near.join(one, "a").join(two, "b").where(_NEAR).select("a", "b"), "near")
    discard(heads)

    listed = lists.select("key").union(by_subset.select("a")).union(by_subset.select("b")).distinct().join(sets.select("key", "base", "check", "doc_id"), "key")
    texts = staged(_packed(docs, listed, key_bits), "texts")
    found = staged(checked(near.union(by_subset).distinct(), texts), "links")
    discard(by_subset)

    # Second round: lists that still hold several components, of which any two might have a link.
    of = components(found)
    placed = lists.join(of, lists["key"] == of["node"], "left").select("token", "n", "rest", "key", F.coalesce("component", "key").alias("component"))
    placed = staged(placed, "placed")  # two joins read it
    discard(lists)
    apart = staged(placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token"), "apart")
    open_ = staged(placed.join(apart, "token").join(sets.select("key", "bits"), "key"), "open")
    discard(placed, sets, apart)
    kinds = open_.groupBy("token", "component").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.max("rest").alias("rest"), F.count("*").alias("size"))
    others = kinds.select("token", F.col("component").alias("other"), F.col("n").alias("_m"), F.col("most").alias("_most"), F.col("rest").alias("_rest"), F.col("size").alias("_size"))
    # The smaller side is laid out first; the larger one then meets it under the full condition.
    meet = kinds.join(others, "token").where("(size < _size or size = _size and component < other) and 5 * most >= 4 * _m and 5 * _most >= 4 * n and 9 * least(rest, _rest) >= 4 * (n + _m)").select("token", "component", "other")
    left = open_.select("token", "component", F.col("key").alias("a"), "n", "rest", "bits")
    right = open_.select("token", F.col("component").alias("other"), F.col("key").alias("b"), F.col("n").alias("_m"), F.col("rest").alias("_rest"), F.col("bits").alias("_bits"))
    cross = meet.join(left, ["token", "component"]).join(right, ["token", "other"]).where(f"{_FITS} and {_NEAR}")
    rest = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(near, ["a", "b"], "left_anti")
    late = staged(checked(rest, texts), "links")
    discard(near, texts, open_)
    return rows, found.unionByName(late)


def _packed(docs: DataFrame, listed: DataFrame, key_bits: int) -> DataFrame:
    """key and packed text of the sets in listed (key, base, check, doc_id); another text of that id is left out."""
    found = compressed(docs.where("doc_id is not null")).join(listed.hint("shuffle_hash"), "doc_id").select("key", "base", "check", "packed")
    few = (1 << key_bits) - 1

    @tidied
    def run(batches):
        coder = zstandard.ZstdDecompressor()
        for batch in batches:
            raw = pa.array([coder.decompress(p) for p in batch.column("packed").to_pylist()], pa.binary())
            g, first = shingles(words(raw))
            own = [np.unique(g[i:j]) for i, j in zip(first[:-1], first[1:])]
            alike = np.array([set_key(x, few) for x in own], np.int64) == batch.column("base").to_numpy()
            alike &= np.array([set_key(mix(x ^ _OTHER)) for x in own], np.int64) == batch.column("check").to_numpy()
            yield batch.select(["key", "packed"]).filter(pa.array(alike))

    return found.mapInArrow(run, "key long, packed binary").groupBy("key").agg(F.first("packed").alias("packed"))


def joined(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """Of each row of docs: doc_id, n_shingles and component_id."""
    rows, found = links(docs, key_bits)
    thin = rows.select("doc_id", "n", "key")
    known = thin.where("doc_id is not null and n > 0")
    first = staged(known.groupBy("key").agg(F.min("doc_id").alias("rep")), "representatives")
    named = found.join(first.withColumnRenamed("key", "a"), "a").select("b", F.col("rep").alias("_a")).join(first.withColumnRenamed("key", "b"), "b").select(F.col("_a").alias("a"), F.col("rep").alias("b"))
    members = known.join(first, "key").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.collect_set("rep").alias("reps"))
    repeated = members.where("lo < hi").select(F.explode("reps").alias("a"), F.col("lo").alias("b"))
    of = components(named.unionByName(repeated))
    ids = members.select("doc_id", "lo").join(of, F.col("lo") == of["node"], "left").select("doc_id", F.coalesce("component", "lo").alias("component_id"))
    return thin.join(ids, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the documents that link, also by way of others, with one of a smaller doc_id."""
    kept = joined(docs.select("doc_id", "text")).where("component_id = doc_id or doc_id is null").select("doc_id").distinct()
    return docs.join(kept.where("doc_id is not null"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), keyed AS (
  SELECT doc_id, md5(string_agg(g, chr(31) ORDER BY g)) AS k FROM s GROUP BY doc_id
), rep AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS r FROM keyed
), rs AS (
  SELECT s.doc_id, g, n FROM s JOIN rep ON s.doc_id = rep.doc_id AND rep.r = rep.doc_id JOIN n ON n.doc_id = s.doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM rs x JOIN rs y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), e AS (
  SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), c(node, comp) AS (
  SELECT r, r FROM (SELECT DISTINCT r FROM rep) UNION SELECT e.b, c.comp FROM c JOIN e ON c.node = e.a WHERE c.comp < e.b
), m AS (
  SELECT node, min(comp) AS comp FROM c GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.comp, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN m ON m.node = rep.r
"""
