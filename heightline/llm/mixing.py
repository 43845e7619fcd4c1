"""Mixing sources to target weights by systematic sampling.

Every source gets a target: its share, by weight, of the words that the mix shall have, but at most MOST times
its own size; what it can't take is shared again by weight. A document's expected copies are its source's target over
its source's size, in units of 2**-UNITS. Within a source they are summed up, in the order of a hash of the ids, one random
offset is added, and a document is emitted once for each integer that its own part of the sum crosses. The offset is that one of TRIES random
ones whose words come nearest to the target, so that a source of few and uneven documents comes near it too. Functions of Spark
alone; a source that holds a third of all rows is summed in pieces (`prefix.running`).

Defined results: a null text has size 0 and is emitted like others. A null source is a source of its own, the last one. A
source without words has the target 0 and emits nothing. Rows that repeat a doc_id are documents by themselves. The offset
comes from hashes of seed and source, so reruns agree. An empty table gives an empty result; texts of any length
count whole; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heightline.llm.prefix import running
from heightline.staging import discard, staged

WEIGHTS = (5, 2, 1)
#: Size of the mix as a fraction of the size of all sources.
SHARE = (3, 2)
#: Times its size that a source may give.
MOST = 2
#: Binary digits after the point of expected copies.
UNITS = 24
SEED = "mix"
#: Random offsets of a source, of which the one counts whose words come nearest to the target, the first of equally near ones.
TRIES = 64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """sources (source, size) with number (from 0, by code point, null last), weight and target.

    A level x gives each source the smaller of its cap and weight * x. Sources in order of cap over weight reach their
    caps one after the other, so the level is that of the first prefix whose next source stays below its cap.
    """
    counted = sources.select("source", "size", F.lit(1).cast("long").alias("_one"))
    ordered = running(counted, [], [F.col("source").asc_nulls_last()], {"number": "_one"})
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("long")
    weighed = ordered.drop("_one").withColumn("weight", weight).withColumn("_cap", F.col("size") * most)
    # Integers order as cap / weight does: every weight divides the least common multiple.
    place = [(F.col("_cap") * F.expr(f"{math.lcm(*weights)} div weight")).asc(), F.col("number").asc()]
    summed = staged(running(weighed, [], place, {"_full": "_cap", "_spent": "weight"}), "levels")
    whole = summed.agg(F.sum("size").alias("_all"), F.sum("weight").alias("_weights"))
    # The level if all before this source are at their caps: (share * all - caps before) / (weights from here on).
    up = F.col("_all") * share[0] - F.col("_full") * share[1]
    down = (F.col("_weights") - F.col("_spent")) * share[1]
    with_level = summed.join(F.broadcast(whole)).withColumns({"_up": up, "_down": down})  # one row
    fits = with_level.where("_cap * _down >= weight * _up")
    level = fits.agg(F.min_by(F.struct("_up", "_down"), F.struct("_spent", "_full", "number")).alias("_level"))
    own = F.least(F.col("_cap").cast("double"), F.col("weight") * F.col("_level._up") / F.col("_level._down"))
    return summed.join(F.broadcast(level)).withColumn("target", F.coalesce(own, F.col("_cap").cast("double"))).select("source", "number", "size", "weight", "target")


def offset(source: Column, seed: str, attempt: int) -> Column:
    """A number below 2**UNITS, fixed by seed, attempt and source."""
    name = F.when(source.isNull(), F.lit(f"{seed}{attempt}")).otherwise(F.concat(F.lit(f"{seed}{attempt}:"), source))
    return F.conv(F.substring(F.sha2(name, 256), 1, UNITS // 4), 16, 10).cast("long")


def _copies(at: Column) -> Column:
    """Integers that a document's part of the sum crosses, if its source's sum begins at `at`."""
    start = F.col("_sum") + at
    return F.shiftright(start + F.col("_expected"), UNITS) - F.shiftright(start, UNITS)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """key, source, size, source_size, target and copies of every document."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = staged(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), F.monotonically_increasing_id().alias("_row")), "sized")
    sums = staged(sized.groupBy("source").agg(F.sum("size").alias("size")), "sources")
    aims = staged(targets(sums, weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") * (1 << UNITS) / F.col("source_size"))).otherwise(0).cast("long")
    named = aims.select(F.col("source").alias("_source"), "number", F.col("size").alias("source_size"), "target")
    joined = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_expected", rate)
    place = [F.col("_hash").asc_nulls_last(), F.col("key").asc_nulls_last(), F.col("size").asc(), F.col("_row").asc()]
    summed = running(joined.withColumn("_hash", F.substring(F.sha2(F.col("key").cast("string"), 256), 1, 16)), ["number"], place, {"_sum": "_expected"})
    discard(sized, sums)
    tries = staged(aims.select("number", F.array(*(offset(F.col("source"), seed, i) for i in range(TRIES))).alias("_drawn")), "tries")
    words = F.array(*(F.sum(F.col("size") * _copies(F.col("_drawn")[i])) for i in range(TRIES)))
    tried = summed.join(tries, "number").groupBy("number").agg(F.max("target").alias("_t"), words.alias("_words")).join(tries, "number")
    best = F.array_min(F.transform("_words", lambda w, i: F.struct(F.abs(w - F.col("_t")).alias("off"), i.alias("i"))))
    chosen = staged(tried.select("number", F.get("_drawn", best["i"]).alias("_at")), "offsets")  # so that a join with it can split a source
    taken = summed.join(chosen, "number")
    return taken.select(F.col("key").alias(key), "source", "size", "source_size", "target", _copies(F.col("_at")).alias("copies"))


def mixture(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is emitted. key must tell rows apart."""
    taken = mix(docs, key, **options).where("copies > 0").select(F.col(key), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return docs.join(taken.drop("_copy"), key)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM s
), p AS (
  SELECT *, coalesce(sum(2 * size) OVER o, 0) AS before, coalesce(sum(weight) OVER o, 0) AS spent, sum(size) OVER () AS whole, sum(weight) OVER () AS weights
  FROM w WINDOW o AS (ORDER BY 2 * size * (10 // weight), number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT (whole * 3 - before * 2)::BIGINT AS up, ((weights - spent) * 2)::BIGINT AS down FROM p
  WHERE 2 * size * (weights - spent) * 2 >= weight * (whole * 3 - before * 2) ORDER BY spent, before, number LIMIT 1
), t AS (
  SELECT source, size AS source_size, least((2 * size)::DOUBLE, (weight * up)::DOUBLE / down::DOUBLE) AS target FROM w, l
), e AS (
  SELECT d.doc_id, d.source, d.size, source_size, target, CASE WHEN source_size > 0 THEN floor(target * 16777216 / source_size)::BIGINT ELSE 0 END AS expected FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (
  SELECT *, coalesce(sum(expected) OVER (PARTITION BY source ORDER BY substr(sha256(doc_id::VARCHAR), 1, 16) NULLS LAST, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM e
), o AS (
  SELECT source, i, ('0x' || substr(sha256('{SEED}' || i || CASE WHEN source IS NULL THEN '' ELSE ':' || source END), 1, 6))::BIGINT AS offs FROM s, (SELECT unnest(range({TRIES})) AS i)
), w16 AS (
  SELECT r.source, i, offs, abs(sum((((start + offs + expected) >> 24) - ((start + offs) >> 24)) * size)::DOUBLE - max(target)) AS off
  FROM r JOIN o ON r.source IS NOT DISTINCT FROM o.source GROUP BY r.source, i, offs
), c AS (
  SELECT source, offs FROM w16 QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, i) = 1
)
SELECT doc_id, size, source_size, target, (((start + offs + expected) >> 24) - ((start + offs) >> 24)) * size AS taken FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source
"""
