"""Idempotent merges of a batch into a table, as DataFrames: the result is the whole new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last by ``order``."""
    return keep_first(df, keys, [F.desc(c) for c in order])


def _met(existing: DataFrame, incoming: DataFrame, order: list[str], dealt: list[str] | None) -> DataFrame:
    """Rows of both with ``_seq``, their order: those that exist come first. ``dealt``: columns of the keys to shuffle both by, once."""
    old = existing.withColumn("_seq", F.struct(F.lit(0).alias("era"), *[F.lit(None).cast(incoming.schema[c].dataType).alias(c) for c in order]))
    new = incoming.withColumn("_seq", F.struct(F.lit(1).alias("era"), *[F.col(c) for c in order]))
    columns = [*existing.columns, "_seq"]
    both = old.select(*columns).unionByName(new.select(*columns))
    return both.repartition(*dealt) if dealt else both


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], dealt: list[str] | None = None) -> DataFrame:
    """Rows of new keys are added, the first of each in the batch; what is there stays."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_seq"))
    both = _met(existing, incoming, order, dealt).withColumn("_rank", rank)
    return both.where("_seq.era = 0 or _rank = 1").select(*existing.columns)


def update_all(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], dealt: list[str] | None = None) -> DataFrame:
    """Rows of the batch, the last of each key, replace those of the same key; the others are added."""
    last = Window.partitionBy(*keys).orderBy(F.desc("_seq"))
    both = _met(existing, incoming, order, dealt).withColumns({"_rank": F.row_number().over(last), "_newest": F.first("_seq.era").over(last)})
    return both.where("(_seq.era = 1 and _rank = 1) or _newest = 0").select(*existing.columns)


def update_some(existing: DataFrame, incoming: DataFrame, keys: list[str], mutable: list[str], order: list[str], dealt: list[str] | None = None) -> DataFrame:
    """Mutable columns take the batch's last value, null or not; all others keep the first value seen."""
    frozen = [c for c in existing.columns if c not in (*keys, *mutable)]
    grouped = _met(existing, incoming, order, dealt).groupBy(*keys)
    first, last = ({c: f(F.struct(c), "_seq")[c].alias(c) for c in cols} for f, cols in ((F.min_by, frozen), (F.max_by, mutable)))
    merged = first | last
    return grouped.agg(*[merged[c] for c in existing.columns if c in merged]).select(*existing.columns)


def set_status(chunks: DataFrame, embedded: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Chunks with the given ids are embedded; those whose text changed since are pending again."""
    out = chunks.join(embedded.select("chunk_id").distinct().withColumn("_done", F.lit(True)), "chunk_id", "left")
    status = F.when(F.col("_done"), F.lit("embedded")).otherwise(F.col("embedding_status"))
    if changed is not None:
        out = out.join(changed.select("chunk_id").distinct().withColumn("_new", F.lit(True)), "chunk_id", "left")
        status = F.when(F.coalesce("_new", F.lit(False)), F.lit("pending")).otherwise(status)
    return out.withColumn("embedding_status", status).select(*chunks.columns)


def bounds(state: DataFrame, batch: DataFrame) -> DataFrame:
    """channel_id, oldest, newest, complete: sync bounds that only widen; ``batch`` has channel_id, message_id."""
    seen = batch.groupBy("channel_id").agg(F.min("message_id").alias("lo"), F.max("message_id").alias("hi"))
    both = state.join(seen, "channel_id", "full_outer")
    return both.select("channel_id", F.least("oldest", "lo").alias("oldest"), F.greatest("newest", "hi").alias("newest"), F.coalesce("complete", F.lit(False)).alias("complete"))


def with_known_parents(channels: DataFrame) -> DataFrame:
    """Channels whose parent is null unless it is a channel of the table."""
    known = channels.select(F.col("channel_id").alias("_id")).distinct()
    joined = channels.join(known, channels["parent_id"] == known["_id"], "left")
    return joined.withColumn("parent_id", F.col("_id")).drop("_id").select(*channels.columns)
