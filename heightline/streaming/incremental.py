"""Incremental ledger: micro-batches of blocks, append-only facts, a version published last, rollback.

Each batch writes its signed rows in a directory of its own version and then publishes (version, tip). A
batch that failed half-way was never published; its repetition overwrites the same directory. A rollback
only publishes a lower tip: a fact counts if its height is within the lowest tip published from its own
version on, so nothing is rewritten and replayed blocks come in as new versions. Rows beyond the stable height
of the last version are kept and not shown; they count once a version with a higher stable height is published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heightline.operators import chain, ledger

FACTS = "account bigint, height bigint, delta bigint, version bigint"
VERSIONS = "version bigint, tip bigint, epoch bigint, stable bigint"


class LedgerStore:
    def __init__(self, spark: SparkSession, path: str, retention: int = 64):
        self.spark, self.path, self.retention = spark, path.rstrip("/"), retention

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def versions(self) -> DataFrame:
        path = f"{self.path}/versions"
        return self.spark.read.schema(VERSIONS).parquet(path) if self._exists(path) else self.spark.createDataFrame([], VERSIONS)

    def _last(self):
        return self.versions().agg(F.max_by(F.struct("version", "tip", "stable"), "version").alias("r"), F.max("epoch").alias("epoch")).first()

    def tip(self) -> int:
        """The highest height that readers see."""
        last = self._last()["r"]
        return -1 if last is None else last["tip"] if last["stable"] is None else min(last["tip"], last["stable"])

    def _publish(self, version: int, tip: int, epoch: int | None, stable: int | None) -> None:
        self.spark.createDataFrame([(version, tip, epoch, stable)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def append(self, rows: DataFrame, last: int, epoch: int | None = None, stable: int | None = None) -> None:
        """Writes the signed rows of the next heights up to `last`, then publishes them.

        Without `stable` they are stable themselves.
        """
        now = self._last()["r"]
        version = now["version"] + 1 if now else 0
        if stable is None and now and now["stable"] is not None:
            stable = max(now["stable"], last)
        rows.select("account", "height", "delta").write.mode("overwrite").parquet(f"{self.path}/facts/version={version}")
        self._publish(version, last, epoch, stable)

    def facts(self) -> DataFrame:
        later = Window.orderBy("version").rowsBetween(Window.currentRow, Window.unboundedFollowing)  # a row a batch
        bound = F.last("stable").over(later)
        limits = self.versions().select("version", F.least(F.min("tip").over(later), bound).alias("_limit"))
        if not self._exists(f"{self.path}/facts"):
            return self.spark.createDataFrame([], FACTS).drop("version")
        return self.spark.read.schema(FACTS).parquet(f"{self.path}/facts").join(limits, "version").where("height <= _limit").select("account", "height", "delta")

    def ledger(self) -> DataFrame:
        return ledger.running_balance(ledger.deltas(self.facts()))

    def rollback(self, ancestor: int) -> None:
        """Refused beyond the retained window, before any change. Rows that waited beyond the ancestor are gone too."""
        tip, now = self.tip(), self._last()["r"]
        chain.check_rollback(tip, ancestor, self.retention)
        if now and ancestor < now["tip"]:
            self._publish(now["version"] + 1, ancestor, None, now["stable"])

    def catch_up(self, stream: DataFrame, stable: int, checkpoint: str) -> None:
        """Runs a stream of signed rows to its present end and shows all rows up to `stable`.

        A batch that was already published is skipped. Rows above `stable` are stored and wait.
        """

        def write(batch: DataFrame, epoch: int) -> None:
            now = self._last()
            if now["epoch"] is not None and epoch <= now["epoch"]:
                return
            last = batch.agg(F.max("height")).first()[0]
            if last is not None:
                self.append(batch, max(last, now["r"]["tip"] if now["r"] else -1), epoch, stable)

        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        now = self._last()["r"]
        if now and now["stable"] != stable:
            self._publish(now["version"] + 1, now["tip"], None, stable)


def stable_target(tip: int, lag: int = 0, most: int | None = None) -> int:
    target = max(0, tip - lag)
    return target if most is None else min(most, target)
