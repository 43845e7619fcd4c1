"""Adapters from the star-schema test tables to the engine's tables, in Spark and in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str):
    return F.datediff(F.col(column), F.lit(EPOCH).cast("date")).cast("bigint")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an output to its customer, in cents, on its day."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("outpoint"), F.col("o_custkey").alias("account"), day("o_orderdate").alias("height"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("value"))


def spends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output is spent on the first day, not before its own, on which one of its lines came back."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("outpoint"), day("l_shipdate").alias("day"))
    return outputs(spark, sf_dir).join(returned, "outpoint").where("day >= height").groupBy("outpoint", "account", "value").agg(F.min("day").alias("height")).select("outpoint", "account", "height", "value")


def signed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, height, delta of outputs and of their spends, with one look at either table."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("outpoint"), day("l_shipdate").alias("_day"))
    both = outputs(spark, sf_dir).join(returned, "outpoint", "left").groupBy("outpoint", "account", "height", "value").agg(F.min(F.when(F.col("_day") >= F.col("height"), F.col("_day"))).alias("_spent"))
    moved = F.array(F.struct("height", F.col("value").alias("delta")), F.struct(F.col("_spent").alias("height"), (-F.col("value")).alias("delta")))
    return both.select("account", F.explode(moved).alias("_m")).where("_m.height is not null").select("account", "_m.height", "_m.delta")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of passes: one pass a user, a state for each kind of event."""
    state = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("event_type"))
    hours = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("inscription_id"), hours.cast("bigint").alias("block_height"), F.col("event_type"), state.alias("new_state"), F.concat(F.lit("o"), (F.col("user_id") * 7 % 211).cast("string")).alias("new_owner"),
    )


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of each pass from its first event."""
    return history(spark, sf_dir).groupBy("inscription_id").agg(F.min("block_height").alias("mint_block_height"), F.min("id").alias("inscription_number"))


KINDS = {"view": "active", "signup": "dormant", "purchase": "consumed", "click": "burned", "error": "invalid"}

SQL_LEDGER = f"""
outs AS (
  SELECT o_orderkey AS outpoint, o_custkey AS account, date_diff('day', DATE '{EPOCH}', CAST(o_orderdate AS DATE))::BIGINT AS height, CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders
), spends AS (
  SELECT outpoint, account, min(day)::BIGINT AS height, value
  FROM outs JOIN (SELECT l_orderkey, date_diff('day', DATE '{EPOCH}', CAST(l_shipdate AS DATE)) AS day FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = outpoint AND day >= height
  GROUP BY outpoint, account, value
), deltas AS (
  SELECT account, height, sum(delta)::BIGINT AS delta FROM (SELECT account, height, value AS delta FROM outs UNION ALL SELECT account, height, -value FROM spends) GROUP BY account, height
), ledger AS (
  SELECT account, height, delta, (sum(delta) OVER (PARTITION BY account ORDER BY height ROWS UNBOUNDED PRECEDING))::BIGINT AS balance FROM deltas
)"""

SQL_HISTORY = """
history AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS inscription_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS BIGINT) AS block_height, event_type,
         CASE event_type WHEN 'view' THEN 'active' WHEN 'signup' THEN 'dormant' WHEN 'purchase' THEN 'consumed' WHEN 'click' THEN 'burned' WHEN 'error' THEN 'invalid' END AS new_state,
         'o' || CAST(user_id * 7 % 211 AS VARCHAR) AS new_owner
  FROM events
), passes AS (
  SELECT inscription_id, min(block_height) AS mint_block_height, min(id) AS inscription_number FROM history GROUP BY inscription_id
)"""


def sql_snapshot(height: int, name: str = "snap") -> str:
    return f"{name} AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY inscription_id ORDER BY id DESC) AS n FROM history WHERE block_height <= {height}) WHERE n = 1)"


def sql_as_of(height: int, name: str = "upto") -> str:
    return f"{name} AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY height DESC) AS n FROM ledger WHERE height <= {height}) WHERE n = 1)"
