"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset, as in local tests, a
    temporary folder is made and set as the checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, so that a lost executor costs only the tasks at hand, and keeps what was
    computed once from being computed for each consumer.
    """
    return stored_at(df, fresh_dir(df.sparkSession, label))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """``stored`` under a path that the caller knows and may remove."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder written by ``stored`` or a store through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def released(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of DataFrames that nothing refers to any more; it does so when both sides collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What a Python worker is given at once; rows differ so much in length that a number of rows bounds nothing.
BATCH_BYTES = 4 << 20
_UNSET = "67108864b"


def bounded(df: DataFrame) -> DataFrame:
    """``df``; from now on its session hands rows to Python in batches of about BATCH_BYTES, unless its user chose otherwise."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, _UNSET) == _UNSET:
        conf.set(key, str(BATCH_BYTES))
    return df


_held: dict[str, dict] = {}


def held(owner: str) -> dict:
    """What the operator ``owner`` keeps in this Python worker between tasks.

    Workers outlive stages, and a pipeline runs one operator after another in the same workers. So they keep
    the things of one operator at a time: where another one begins, those of the last are dropped.
    """
    if owner not in _held:
        _held.clear()
        given_back()
        _held[owner] = {}
    return _held[owner]


def given_back() -> None:
    """Hand memory that this process has freed back to the machine; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library has no such call everywhere
        ctypes.CDLL(None).malloc_trim(0)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it; Spark does not tell capitals apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def maybe_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast if its counted rows are few enough, otherwise leave it to a shuffled join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
