"""Historical reads of a ledger: points, ranges, as-of lookups, latest rows and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heightline.operators.pieces import nearest
from heightline.staging import staged


def exact(ledger: DataFrame, account, height: int) -> DataFrame:
    return ledger.where((F.col("account") == account) & (F.col("height") == height))


def in_range(ledger: DataFrame, account, start: int, end: int) -> DataFrame:
    """Half-open in height; empty for an empty range."""
    return ledger.where((F.col("account") == account) & (F.col("height") >= start) & (F.col("height") < end))


def latest(ledger: DataFrame, start=None) -> DataFrame:
    """The last row of each account, zero balances included; with a start, of the accounts up to it, from where a scan goes down."""
    return (ledger if start is None else ledger.where(F.col("account") <= start)).groupBy("account").agg(F.max_by(F.struct("height", "delta", "balance"), "height").alias("r")).select("account", "r.*")


def as_of(ledger: DataFrame, height: int) -> DataFrame:
    """The last row of each account at or before a height, zero balances included."""
    return latest(ledger.where(F.col("height") <= height))


def holders_at(ledger: DataFrame, height: int) -> DataFrame:
    """As as_of, for positive balances only; the filter follows the choice of the row."""
    return as_of(ledger, height).where("balance > 0")


def as_of_keys(ledger: DataFrame, keys: DataFrame, height: int) -> DataFrame:
    """One row for each row of keys (account, and pos to order by), repeats included; misses are zero."""
    found = as_of(ledger, height).withColumnRenamed("account", "_a")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return keys.join(found, keys["account"] == found["_a"], "left").select(*keys.columns, zero("height"), zero("delta"), zero("balance"))


def as_of_many(ledger: DataFrame, points: DataFrame) -> DataFrame:
    """points (account, at, and others) with the last ledger row at or before `at`, zeros where there is none.

    Ledger rows and the distinct (account, at) are looked along together in pieces of heights; points then meet their answers by an
    equi join, whose larger side adaptive execution can split. So no account and no height is one task's work.
    """
    kind = "struct<height:bigint,delta:bigint,balance:bigint>"
    rows = ledger.select("account", F.col("height").alias("at"), F.lit(0).alias("side"), F.struct("height", "delta", "balance").cast(kind).alias("row"))
    asked = points.select("account", F.col("at").cast("bigint"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("row")).distinct()
    line = staged(rows.unionByName(asked).where("account is not null and at is not null"), "as-of")
    found = nearest(line, ["account"], ["at", "side"], {"_found": F.col("row")}, height="at").where("side = 1").select("account", "at", "_found")
    extra = [c for c in points.columns if c not in ("account", "at")]
    zero = lambda c: F.coalesce(F.col(f"_found.{c}"), F.lit(0)).alias(c)
    return points.join(found, ["account", "at"], "left").select("account", "at", *extra, zero("height"), zero("delta"), zero("balance"))


def keyset_page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(limit)


def offset_page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def ordered_lookup(keys: list, rows: DataFrame, key: str) -> DataFrame:
    """Rows for a short list of keys in its order, with nulls for misses; pos is the place in the list."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], f"pos int, {key} {rows.schema[key].dataType.simpleString()}")
    return asked.join(rows, key, "left")


def missing_heights(rows: DataFrame, first: int, last: int) -> DataFrame:
    spark = rows.sparkSession
    return spark.range(first, last + 1).toDF("height").join(rows.select("height"), "height", "left_anti")


def first_missing(rows: DataFrame, first: int, last: int) -> DataFrame:
    """The lowest height between the bounds that has no row, null if all have one."""
    return missing_heights(rows, first, last).agg(F.min("height").alias("height"))


def undo_window(rows: DataFrame, tip: int, retention: int = 64) -> DataFrame:
    """Heights that can still be rolled back."""
    return rows.where(F.col("height") >= max(0, tip - (retention - 1)))
