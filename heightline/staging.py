"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_KEY = "spark.checkpoint.dir"


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of df followed by the columns of ddl."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A local one of our own where that is unset and all runs on one machine."""
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{_KEY} must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-heightline-", dir="/tmp")
        spark.conf.set(_KEY, base)
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage.

    The files survive the loss of any executor, so later stages never recompute what stands before. They
    stay until `discard` or `clear`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


_written: dict[str, list[str]] = {}


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables of which no reader is left."""
    for df in tables:
        _delete(df.sparkSession, df.staged_at)


def clear(spark: SparkSession, kept: tuple[DataFrame, ...] = (), since: int = 0) -> None:
    """Deletes the tables that this application has staged, once no result of them is read any more.

    Not those of kept, nor the first `since` of them, which is what `mark` gave before the others were staged.
    """
    left = {df.staged_at for df in kept}
    for path in _written.get(spark.sparkContext.applicationId, [])[since:]:
        if path not in left:
            _delete(spark, path)


def mark(spark: SparkSession) -> int:
    """How many staged tables this application has now."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    own = _written.get(spark.sparkContext.applicationId, [])
    if path in own:
        own.remove(path)


#: Rows in an Arrow batch where rows hold whole documents.
DOCUMENTS_A_BATCH = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def document_batches(spark: SparkSession) -> None:
    """Sets Arrow batches for rows that hold documents, unless the session has a size of its own.

    Spark's 10,000 rows are tens of megabytes of text in each buffer between the JVM and its Python workers.
    """
    if spark.conf.get(_BATCH) == "10000" and spark.sparkContext.getConf().get(_BATCH) is None:
        spark.conf.set(_BATCH, str(DOCUMENTS_A_BATCH))


def apart(spark: SparkSession, rows: int, each: int = 250_000) -> SparkSession:
    """A session of its own for eager steps over so many rows, whose shuffles take no more partitions than those fill."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    key = "spark.sql.shuffle.partitions"
    own.conf.set(key, max(1, min(int(spark.conf.get(key)), -(-rows // each))))
    return own
