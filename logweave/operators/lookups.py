"""Small queries that a front end asks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def guilds_with_projection(guilds: DataFrame, projections: DataFrame) -> DataFrame:
    """guild_id (text), name of guilds that have a projection, by name."""
    return guilds.join(projections.select("guild_id").distinct(), "guild_id", "left_semi").orderBy(F.asc_nulls_last("name"), "guild_id").select(F.col("guild_id").cast("string").alias("guild_id"), "name")


def channels_of(channels: DataFrame, guild_id: int) -> DataFrame:
    return channels.where(F.col("guild_id") == guild_id).orderBy(F.asc_nulls_last("position"), F.asc_nulls_last("name"), "channel_id").select(F.col("channel_id").cast("string").alias("channel_id"), "name", "type", "position", F.col("parent_id").cast("string").alias("parent_id"))


def chunk_detail(chunks: DataFrame, texts: DataFrame, channels: DataFrame, chunk_id: int) -> DataFrame:
    found = chunks.where(F.col("chunk_id") == chunk_id).join(texts, "chunk_id")
    return found.join(channels.select("channel_id", F.col("name").alias("channel_name")), "channel_id", "left")


def by_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows in the order asked for; ``ids`` has key and ``pos``. Asked rows that are missing are absent."""
    return df.join(ids, key).orderBy("pos")


def missing(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    return ids.join(df.select(key), key, "left_anti")


def channels_with_messages(channels: DataFrame, messages: DataFrame) -> DataFrame:
    return channels.join(messages.select("channel_id"), "channel_id", "left_semi")


def chunks_of(chunks: DataFrame, kind: str | None = None, channel_id: int | None = None, state: str | None = None) -> DataFrame:
    """Chunks of a kind, a channel, a state, as far as these are given."""
    for column, value in (("chunk_type", kind), ("channel_id", channel_id), ("chunk_state", state)):
        if value is not None:
            chunks = chunks.where(F.col(column) == value)
    return chunks


def pending_stats(chunks: DataFrame, texts: DataFrame, max_tokens: int) -> DataFrame:
    """embeddable, total_tokens, oversized of pending chunks, in one pass."""
    rows = chunks.where("embedding_status = 'pending'").join(texts, "chunk_id")
    fits = F.col("token_count") <= max_tokens
    return rows.agg(F.count_if(fits).alias("embeddable"), F.coalesce(F.sum(F.when(fits, F.col("token_count"))), F.lit(0)).alias("total_tokens"), F.count_if(~fits).alias("oversized"))


def page_after(rows: DataFrame, after: tuple[int, int] | None, limit: int) -> DataFrame:
    """The next rows by (token_count, chunk_id): keyset paging as a top-k."""
    if after is not None:
        rows = rows.where(f"struct(token_count, chunk_id) > struct(cast({int(after[0])} as bigint) as token_count, cast({int(after[1])} as bigint) as chunk_id)")
    return rows.orderBy("token_count", "chunk_id").limit(limit)


def refreshed_urls(attachments: DataFrame, message_id: int, refresher: Callable[[list[str]], dict[str, str]]) -> DataFrame:
    """Attachments of one message with ``refreshed_url``: what the refresher gives, or the old one."""
    spark = attachments.sparkSession
    own = attachments.where(F.col("message_id") == message_id)
    given = refresher([r["url"] for r in own.select("url").distinct().collect()])  # of one message
    table = spark.createDataFrame(list(given.items()) or [("", "")], "url string, new_url string")
    return own.join(F.broadcast(table), "url", "left").withColumn("refreshed_url", F.coalesce("new_url", "url")).drop("new_url")
