"""Results written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder a cluster names in ``spark.checkpoint.dir``; a temporary one only where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="logweave-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it back: what was computed stays, and plans built on it are short."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes that a Python worker is given at once where rows may be long: what it holds does not grow with the table.
BATCH_ROWS, BATCH_BYTES = 1_000, 2 << 20
_UNSET = "67108864b"


def stored_in_batches(df: DataFrame, label: str) -> DataFrame:
    """``stored``; meanwhile Python is given rows in small batches, unless the session's user chose still smaller ones."""
    conf, rows, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {k: conf.get(k, None) for k in (rows, size)}
    if not 0 < int(before[rows] or 0) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    if before[size] in (None, _UNSET):
        conf.set(size, str(BATCH_BYTES))
    try:
        return stored(df, label)
    finally:
        for k, value in before.items():
            conf.unset(k) if value is None else conf.set(k, value)
