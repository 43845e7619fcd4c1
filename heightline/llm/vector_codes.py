"""Vector code compression: product codes whose nearest entries are found by annular norm pruning.

Vectors become integers and are cut into equal parts. Each part position has a codebook that ROUNDS rounds of exact integer
k-means move. The nearest entry of a part: entries are sorted by norm; a distance to an entry is at least the difference of both norms,
so the best distance so far allows an interval of norms, bounds included, that binary search finds. From the entry nearest in norm on,
the search goes outwards and evaluates, in integers, what lies in that annulus alone, while each better distance narrows it.

A round is one job over the vectors, whose tasks hand back sums and counts of each entry; those are the codebooks' size whatever the
number of vectors, so no group of vectors meets in a task. Sums over tasks are decimals, which can't overflow.

Defined results: rows whose vector is null or holds null, NaN or infinite components are dropped, as are those of another length than
the smallest kept id's vector; zero vectors stay. Rows without id are coded and shape the codebooks but don't start them; of rows that repeat a
starting id the smallest vector does. Repeated rows all count. With fewer ids than ENTRIES the codebooks are as small. Labels sum up
with nulls together. A table without such rows gives an empty result. Components of 2**15 and more in size, whose squares don't add up within 64
bits, and lengths that PARTS doesn't divide raise ValueError. Columns other than id, vector and label are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heightline.llm.text import tidied
from heightline.staging import staged

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Integers stay below this size, so that squared distances of 512 components fit 64 bits.
BOUND = 1 << 27
#: Vectors searched at once.
ROWS = 1 << 14


def sound(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


class Codebook:
    """Entries of one part position (integers), with their order by norm."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry of each row, ties to the lower index; how many distances that took."""
        n, last = len(x), len(self.norms)
        own = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        right = np.searchsorted(self.norms, own)  # the next entry outwards, on either side
        left = right - 1
        best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, last)
        evaluated = 0
        live = np.arange(n)
        while len(live):
            norm, radius = own[live], np.sqrt(best[live].astype(np.float64))
            slack = 1e-9 * (1 + norm + np.minimum(radius, norm + self.norms[-1]))  # far above the error of norms
            low = np.searchsorted(self.norms, norm - radius - slack, "left")
            high = np.searchsorted(self.norms, norm + radius + slack, "right")
            can_left, can_right = left[live] >= low, right[live] < high
            more = can_left | can_right
            live, norm, can_left, can_right = live[more], norm[more], can_left[more], can_right[more]
            if not len(live):
                break
            below = norm - self.norms[np.maximum(left[live], 0)]
            above = self.norms[np.minimum(right[live], last - 1)] - norm
            down = can_left & (~can_right | (below <= above))
            at = self.order[np.where(down, left[live], right[live])]
            left[live] -= down
            right[live] += ~down
            d = ((x[live] - self.entries[at]) ** 2).sum(1)
            evaluated += len(live)
            better = (d < best[live]) | (d == best[live]) & (at < index[live])
            best[live[better]], index[live[better]] = d[better], at[better]
        return index, best, evaluated


def _integers(column: pa.Array, length: int) -> np.ndarray:
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length) * float(SCALE))
    if len(x) and np.abs(x).max() >= BOUND:
        raise ValueError(f"a component of {BOUND // SCALE} or more in size")
    return x.astype(np.int64)


def _slices(batches, place: int, length: int):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield part, _integers(part.column(place), length)


def _vectors(rows: DataFrame, key: str, column: str, *others: str) -> DataFrame:
    return rows.where(sound(F.col(column))).select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v"), *others)


def fit(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks: integers by part, entry, position. Without vectors an array of no entries."""
    rows = _vectors(vectors, key, column)
    starting = rows.where("id is not null").select("id").distinct().orderBy("id").limit(entries)
    begin = rows.join(F.broadcast(starting), "id").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()  # at most `entries` rows
    if not begin:
        return np.empty((parts, 0, 0), np.int64)
    length = len(begin[0]["v"])
    if length % parts:
        raise ValueError(f"{parts} parts don't divide {length} components")
    alike = rows.where(F.size("v") == length).select("v")
    first = _integers(pa.array([r["v"] for r in begin if len(r["v"]) == length], pa.list_(pa.float64())), length)
    books = np.ascontiguousarray(first.reshape(len(first), parts, length // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(books)
        total = alike.mapInArrow(_summing(shared, length), "part int, entry int, place int, total long, n long")
        found = total.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n")).collect()  # the codebooks' size
        books = books.copy()
        for r in found:
            books[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
        shared.destroy()
    return books


def _summing(shared, length: int):
    @tidied
    def run(batches):
        books = shared.value
        parts, entries, width = books.shape
        tables = [Codebook(b) for b in books]
        totals, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for _, x in _slices(batches, 0, length):
            for p, table in enumerate(tables):
                own = x[:, p * width : (p + 1) * width]
                index = table.nearest(own)[0]
                order = np.argsort(index, kind="stable")
                used, start, n = np.unique(index[order], return_index=True, return_counts=True)
                totals[p, used] += np.add.reduceat(own[order], start, axis=0)
                counts[p, used] += n
        p, e = np.nonzero(counts)
        each = lambda a: pa.array(np.repeat(a, width))
        yield pa.RecordBatch.from_arrays([each(p.astype(np.int32)), each(e.astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(p))), pa.array(totals[p, e].reshape(-1)), each(counts[p, e])], ["part", "entry", "place", "total", "n"])

    return run


def encode(vectors: DataFrame, books: np.ndarray, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """key, label, code (a byte a part, in hexadecimal) and error of every sound vector of the codebooks' length."""
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("a code has one byte a part")
    rows = _vectors(vectors, key, column, F.col(label).alias("label"))
    kinds = rows.select(F.col("id").alias(key), F.col("label").alias(label)).withColumns({"code": F.lit("").cast("string"), "error": F.lit(0).cast("long")})
    if not entries:
        return kinds.limit(0)
    shared, schema = vectors.sparkSession.sparkContext.broadcast(books), kinds.schema

    @tidied
    def run(batches):
        tables = [Codebook(b) for b in shared.value]
        for batch, x in _slices(batches, 1, parts * width):
            found = [t.nearest(x[:, p * width : (p + 1) * width]) for p, t in enumerate(tables)]
            digits = np.column_stack([f[0] for f in found]).astype(np.uint8)
            codes = [row.tobytes().hex() for row in digits]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.string()), pa.array(sum(f[1] for f in found), pa.int64())], schema.names)

    return rows.where(F.size("v") == parts * width).mapInArrow(run, schema)


def decode(codes: DataFrame, books: np.ndarray, code: str = "code", out: str = "vector") -> DataFrame:
    """codes with the integers that each code stands for, from the broadcast codebooks."""
    parts, entries, width = books.shape
    table = F.lit(books.reshape(parts * entries, width).tolist()) if entries else F.array().cast("array<array<bigint>>")
    digit = lambda p: F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("_books", table).withColumn(out, F.concat(*(F.get("_books", digit(p) + p * entries) for p in range(parts)))).drop("_books")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components as decimal texts, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """key, code, error, label_error (errors of all rows of that label) and codebooks_sha256 of every row that is kept."""
    books = fit(vectors, key, column, parts, entries, rounds)
    coded = staged(encode(vectors, books, key, column, label), "coded")
    # Written, so that a join with it can split a label that very many rows have.
    sums = staged(coded.groupBy(label).agg(F.sum("error").alias("label_error")).withColumnRenamed(label, "_label"), "label-errors")
    return coded.join(sums, F.col(label).eqNullSafe(F.col("_label"))).select(key, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rounds one after the other; floors of negative quotients are made from remainders."""

    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT rid, part, x, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM (
    SELECT p.rid, p.part, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{k} b ON b.part = p.part
  ) GROUP BY rid, part, x
)"""

    def moved(k: int) -> str:
        return f"""b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS x
    FROM (SELECT part, entry, place, sum(x[place])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k}, (SELECT unnest(generate_series(1, (SELECT max(len(x)) FROM p))) AS place) GROUP BY ALL)
    GROUP BY part, entry
  ) m ON m.part = b.part AND m.entry = b.entry
)"""

    steps = ",\n".join(f"{assigned(k)},\n{moved(k)}" for k in range(rounds))
    return f"""WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q, row_number() OVER () AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT rid, part, q[part * (len(q) // {parts}) + 1:(part + 1) * (len(q) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS part)
), f AS (
  SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT {entries}
), b0 AS MATERIALIZED (
  SELECT part, entry, x FROM p JOIN f USING (rid)
), {steps}, {assigned(rounds)}, e AS (
  SELECT rid, string_agg(lower(lpad(hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN e USING (rid)"""


ORACLE = _oracle()
