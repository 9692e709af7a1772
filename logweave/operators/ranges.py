"""Counts of rows within ranges: one sort of the rows and the ends of the ranges together, no pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .storage import stored

SEED = 42


def counted(asked: DataFrame, held: DataFrame) -> DataFrame:
    """id, near: for each id of ``asked`` (id, part, low, high), how many rows of ``held`` (part, value) lie in its ranges, both ends included; ids with none are absent.

    All are dealt by ranges of part and value, so that a task holds a run of them, whatever one value's rows are. A task counts the
    rows before each end within its run, and the driver learns one count for each task; what lies between two ends is the difference.
    """
    spark = asked.sparkSession
    kind = asked.schema["id"].dataType
    of = to_arrow_type(kind)
    # Of equal values low ends stand first, then rows, then high ends.
    low, high = (asked.select("part", F.col(c).alias("value"), F.lit(at).alias("at"), "id") for c, at in (("low", 0), ("high", 2)))
    rows = held.select("part", "value", F.lit(1).alias("at"), F.lit(None).cast(kind).alias("id"))
    marks = low.unionByName(rows).unionByName(high).where("part is not null and value is not null").withColumn("tie", F.rand(SEED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, task = 0, TaskContext.get().partitionId()
        told = lambda ids, side, number: pa.RecordBatch.from_arrays([ids, pa.array(side, pa.int32()), pa.array(number, pa.int64()), pa.array(np.full(len(side), task), pa.int32())], ["id", "side", "number", "task"])
        for batch in batches:
            at = batch["at"].to_numpy()
            number = before + np.cumsum(at == 1)
            before = int(number[-1]) if len(number) else before
            ends = np.flatnonzero(at != 1)
            yield told(pc.take(batch["id"], pa.array(ends)), at[ends] - 1, number[ends])
        yield told(pa.nulls(1, of), [0], [before])

    ordered = marks.orderBy("part", "value", "at", "tie").select("at", "id")
    told = stored(ordered.mapInArrow(run, f"id {kind.simpleString()}, side int, number bigint, task int"), "ends")
    before, starts = 0, []
    for r in sorted(told.where("side = 0").select("task", "number").collect()):
        starts.append((r["task"], before))
        before += r["number"]
    base = F.broadcast(spark.createDataFrame(starts, "task int, base bigint"))  # a row for each task
    near = told.where("side <> 0").join(base, "task").groupBy("id").agg(F.sum(F.col("side") * (F.col("number") + F.col("base"))).alias("near"))
    return near.where("near > 0")
