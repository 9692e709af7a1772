"""API payloads (JSON text) to table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from . import permissions as P
from .scalars import emoji_key, iso_to_time, to_id, without_nul


def _parsed(payloads: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """``payloads(raw, ...)`` with NULs removed and a struct ``d``; a payload without a required field fails."""
    clean = payloads.withColumn("raw", without_nul("raw"))
    parsed = clean.withColumn("d", F.from_json("raw", schema))
    for name in required:
        parsed = parsed.withColumn("d", F.when(F.col(f"d.{name}").isNotNull(), F.col("d")).otherwise(F.raise_error(F.concat(F.lit(f"payload without {name}: "), F.substring("raw", 1, 200)))))
    return parsed


def messages(payloads: DataFrame, guild_id: int | None = None, *kept: str) -> DataFrame:
    """``payloads(raw)`` as messages, with columns of ``payloads`` to be kept; a guild in the payload comes before ``guild_id``."""
    d = _parsed(payloads, schemas.API_MESSAGE, ["id", "channel_id", "author.id", "timestamp"])
    ids: list[Column] = [to_id("d.id").alias("message_id"), to_id("d.channel_id").alias("channel_id"), to_id("d.author.id").alias("author_id")]
    return d.select(
        *ids,
        F.coalesce(to_id("d.guild_id"), F.lit(guild_id).cast("bigint")).alias("guild_id"),
        F.coalesce("d.content", F.lit("")).alias("content"),
        iso_to_time("d.timestamp").alias("created_at"),
        iso_to_time("d.edited_timestamp").alias("edited_at"),
        F.coalesce("d.type", F.lit(0)).alias("type"),
        F.coalesce("d.flags", F.lit(0)).alias("flags"),
        F.coalesce("d.pinned", F.lit(False)).alias("pinned"),
        F.coalesce(F.transform("d.mentions", lambda u: to_id(u["id"])), F.array().cast("array<bigint>")).alias("mentions"),
        F.coalesce(F.transform("d.mention_roles", lambda r: to_id(r)), F.array().cast("array<bigint>")).alias("mention_roles"),
        to_id("d.message_reference.message_id").alias("referenced_message_id"),
        to_id("d.webhook_id").alias("webhook_id"),
        F.coalesce("d.embeds", F.array().cast(f"array<{schemas.EMBED}>")).alias("embeds"),
        "raw",
        *kept,
    )


def attachments(payloads: DataFrame) -> DataFrame:
    d = _parsed(payloads, schemas.API_MESSAGE, ["id"]).select(to_id("d.id").alias("message_id"), F.explode("d.attachments").alias("a"))
    return d.select(to_id("a.id").alias("attachment_id"), "message_id", "a.filename", "a.content_type", "a.size", "a.url", "a.width", "a.height")


def reactions(payloads: DataFrame) -> DataFrame:
    d = _parsed(payloads, schemas.API_MESSAGE, ["id"]).select(to_id("d.id").alias("message_id"), F.explode("d.reactions").alias("r"))
    return d.select("message_id", emoji_key("r.emoji.id", "r.emoji.name").alias("emoji_key"), to_id("r.emoji.id").alias("emoji_id"), F.col("r.emoji.name").alias("emoji_name"), F.col("r.emoji.animated").alias("emoji_animated"), F.coalesce("r.count", F.lit(1)).alias("count"))


def users_of_messages(payloads: DataFrame) -> DataFrame:
    """message_id, at, user columns: the author, then who is mentioned; repeats are kept."""
    d = _parsed(payloads, schemas.API_MESSAGE, ["id"])
    told = F.concat(F.array("d.author"), F.coalesce("d.mentions", F.array().cast(f"array<{schemas.API_USER}>")))
    return d.select(to_id("d.id").alias("message_id"), F.posexplode(told).alias("at", "u")).select("message_id", "at", to_id("u.id").alias("user_id"), "u.username", "u.global_name", F.coalesce("u.bot", F.lit(False)).alias("bot"))


def users(payloads: DataFrame) -> DataFrame:
    return _parsed(payloads, schemas.API_USER, ["id"]).select(to_id("d.id").alias("user_id"), "d.username", "d.global_name", F.coalesce("d.bot", F.lit(False)).alias("bot"), "raw")


def channels(payloads: DataFrame) -> DataFrame:
    d = _parsed(payloads, schemas.API_CHANNEL, ["id", "type"])
    return d.select(
        to_id("d.id").alias("channel_id"), to_id("d.guild_id").alias("guild_id"), "d.type", "d.name", "d.topic", "d.position", to_id("d.parent_id").alias("parent_id"),
        to_id("d.last_message_id").alias("last_message_id"), "d.message_count", "d.nsfw", F.transform("d.applied_tags", lambda t: to_id(t)).alias("applied_tags"), "d.permission_overwrites", "raw",
    )


def guilds(payloads: DataFrame) -> DataFrame:
    d = _parsed(payloads, schemas.API_GUILD, ["id", "name"])
    return d.select(to_id("d.id").alias("guild_id"), "d.name", "d.icon", to_id("d.owner_id").alias("owner_id"), F.coalesce("d.features", F.array().cast("array<string>")).alias("features"), "raw")


def roles(payloads: DataFrame, guild_id: int) -> DataFrame:
    d = _parsed(payloads, schemas.API_ROLE, ["id", "name"])
    return d.select(to_id("d.id").alias("role_id"), F.lit(guild_id).cast("bigint").alias("guild_id"), "d.name", F.coalesce("d.color", F.lit(0)).alias("color"), F.coalesce("d.position", F.lit(0)).alias("position"), P.unsigned(P.bits_of("d.permissions")).alias("permissions"), "raw")


def emojis(payloads: DataFrame, guild_id: int) -> DataFrame:
    d = _parsed(payloads, schemas.API_EMOJI, ["id"])
    return d.select(to_id("d.id").alias("emoji_id"), F.lit(guild_id).cast("bigint").alias("guild_id"), "d.name", "d.animated", "d.available", F.transform("d.roles", lambda r: to_id(r)).alias("roles"), "raw")


def stickers(payloads: DataFrame, guild_id: int) -> DataFrame:
    d = _parsed(payloads, schemas.API_STICKER, ["id"])
    return d.select(to_id("d.id").alias("sticker_id"), F.lit(guild_id).cast("bigint").alias("guild_id"), "d.name", "d.description", "d.format_type", "d.available", "raw")


def scheduled_events(payloads: DataFrame) -> DataFrame:
    d = _parsed(payloads, schemas.API_EVENT, ["id"])
    return d.select(to_id("d.id").alias("event_id"), to_id("d.guild_id").alias("guild_id"), to_id("d.channel_id").alias("channel_id"), "d.name", "d.status", iso_to_time("d.scheduled_start_time").alias("starts_at"), "raw")
