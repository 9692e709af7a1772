"""Taking in guilds: accounts and their guilds in turn; of a guild its entities, channels with archived threads, and messages.

What an API answers in one request is asked by the driver and becomes rows at once. Threads and messages,
which come in pages, are read on executors, channels side by side. Each step is merged before the next begins, by the
rule of its table, so a run that breaks off goes on where it ended.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from .functions import mappers
from .functions import permissions as P
from .operators import merge
from .operators.storage import stored
from .sources import rest
from .warehouse import Warehouse

#: Answers that mean: not for this account.
DENIED = (401, 403, 404)
#: Tasks that ask at once, at most.
READERS = 64


@dataclass(frozen=True)
class Account:
    name: str
    fetch: rest.Fetcher
    guilds: tuple[int, ...]

    @classmethod
    def of(cls, settings: dict) -> Account:
        """From an entry of the settings: name, url, token, user_agent, guilds."""
        fetch = rest.HttpFetcher(settings["url"], settings["token"], settings.get("user_agent", "logweave"))
        return cls(settings.get("name", ""), rest.Patient(fetch), tuple(int(g) for g in settings.get("guilds", ())))


@dataclass(frozen=True)
class Viewer:
    """Who asks, and what the roles of that user allow in the guild."""

    guild_id: int
    user_id: int
    roles: tuple[int, ...]
    base: int

    def bits(self):
        """The permissions in each channel of a DataFrame of channels."""
        overwrites = F.coalesce("permission_overwrites", F.array())
        roles = F.array(*map(F.lit, self.roles)).cast("array<bigint>")
        return P.in_channel(F.lit(self.base).cast("bigint"), overwrites, F.lit(self.user_id), roles, F.lit(self.guild_id))


def rows(wh: Warehouse, payloads: Iterable[dict]) -> DataFrame:
    return wh.spark.createDataFrame([(json.dumps(p),) for p in payloads], "raw string")


def viewer(wh: Warehouse, fetch: rest.Fetcher, guild: dict) -> Viewer:
    guild_id, me = int(guild["id"]), fetch(rest.ENDPOINTS["me"], {})
    try:
        roles = tuple(int(r) for r in fetch(rest.ENDPOINTS["me_in_guild"].format(guild_id), {}).get("roles", []))
    except rest.ApiError:  # nothing is known of the member: what everyone may do
        roles = ()
    own = mappers.roles(rows(wh, guild.get("roles", [])), guild_id).where(F.col("role_id").isin([guild_id, *roles]))
    bits = own.agg(P.base(F.coalesce(F.bit_or(P.bits_of("permissions")), F.lit(0).cast("bigint"))).alias("base")).head()["base"]
    return Viewer(guild_id, int(me["id"]), roles, bits)


def entities(wh: Warehouse, fetch: rest.Fetcher, guild: dict) -> dict[str, int | None]:
    """Guild, roles, emojis, stickers and events into their tables; how many of each, None for those that may not be read."""
    guild_id = int(guild["id"])
    wh.merge("guilds", mappers.guilds(rows(wh, [guild])), ["guild_id"])
    told: dict[str, int | None] = {"roles": len(guild.get("roles", []))}
    if told["roles"]:
        wh.merge("roles", mappers.roles(rows(wh, guild["roles"]), guild_id), ["role_id"])
    mapped = {"emojis": (mappers.emojis, "emoji_id"), "stickers": (mappers.stickers, "sticker_id"), "events": (lambda raw, _: mappers.scheduled_events(raw), "event_id")}
    for name, (mapper, key) in mapped.items():
        try:
            found = fetch(rest.ENDPOINTS[name].format(guild_id), {})
        except rest.ApiError as e:
            if e.status != 403:
                raise
            told[name] = None
            continue
        told[name] = len(found)
        if found:
            wh.merge(name, mapper(rows(wh, found), guild_id), [key])
    return told


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt one by one over the tasks that ask."""
    return df.repartition(READERS)


def threads(fetch: rest.Fetcher, channels: DataFrame, who: Viewer) -> DataFrame:
    """raw: archived threads of the channels that can have some and may be viewed; private ones where the user manages threads."""
    asked = channels.withColumn("_bits", who.bits()).where(F.col("type").isin(*P.FETCHABLE) & P.can_view("_bits"))
    private = F.col("type").isin(0, 5) & P.can_manage_threads("_bits") & P.can_read_history("_bits")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for channel, both in zip(pdf["channel_id"].tolist(), pdf["private"].tolist(), strict=True):
                for kind in (False, True) if both else (False,):
                    found = []
                    try:
                        for t in rest.archived_threads(fetch, channel, kind):
                            found.append(json.dumps(t))
                    except rest.ApiError:  # what came before stays
                        pass
                    yield pd.DataFrame({"raw": pd.Series(found, dtype=object)})

    return _spread(asked.select("channel_id", private.alias("private"))).mapInPandas(read, "raw string")


def pages(fetch: rest.Fetcher):
    """Pages of messages for ``runs.ingest``, read on executors; a null raw for a channel that may not be read."""

    def of(direction: str, bounds: DataFrame) -> DataFrame:
        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for channel, edge in zip(pdf["channel_id"].tolist(), pdf["message_id"].tolist(), strict=True):
                    at = None if pd.isna(edge) else int(edge)
                    messages = rest.backfill(fetch, channel, at) if direction == "before" else rest.after(fetch, channel, at or 0)
                    page: list[str | None] = []
                    try:
                        for m in messages:
                            page.append(json.dumps(m))
                            if len(page) == rest.PAGE:
                                yield pd.DataFrame({"channel_id": channel, "raw": page})
                                page = []
                    except rest.ApiError as e:
                        if e.status != 403:
                            raise
                        page.append(None)
                    yield pd.DataFrame({"channel_id": channel, "raw": pd.Series(page, dtype=object)})

        return _spread(bounds.select("channel_id", F.col("message_id").cast("string").alias("message_id"))).mapInPandas(read, "channel_id bigint, raw string")

    return of


def guild(wh: Warehouse, fetch: rest.Fetcher, guild_id: int) -> dict[str, int | None]:
    """One guild: entities, channels with their archived threads (parents only if they are known), then the messages of
    all text channels that may be viewed. What came, by kind."""
    payload = fetch(rest.ENDPOINTS["guild"].format(guild_id), {})
    told = entities(wh, fetch, payload)
    who = viewer(wh, fetch, payload)
    listed = mappers.channels(rows(wh, fetch(rest.ENDPOINTS["channels"].format(guild_id), {})))
    found = stored(listed.unionByName(mappers.channels(threads(fetch, listed, who))), "channels")
    found = found.withColumn("guild_id", F.coalesce("guild_id", F.lit(guild_id).cast("bigint")))
    wh.merge("channels", merge.with_known_parents(found), ["last_message_id"])
    readable = found.where(P.is_text_based("type") & P.can_access(who.bits(), "type")).select("channel_id").distinct()
    counts = runs.ingest(wh, pages(fetch), [r["channel_id"] for r in readable.collect()], guild_id)
    return told | {"channels": found.count(), "channels_read": len(counts), "messages": sum(counts.values())}


def run(wh: Warehouse, accounts: Iterable[Account], guild_id: int | None = None, channel_id: int | None = None) -> dict[int, dict]:
    """All guilds of all accounts, or one guild; an error ends the run. Or one channel, by the first account that may see it."""
    if channel_id is not None:
        return _channel(wh, accounts, channel_id)
    return {g: guild(wh, a.fetch, g) for a in accounts for g in a.guilds if guild_id is None or g == guild_id}


def _channel(wh: Warehouse, accounts: Iterable[Account], channel_id: int) -> dict[int, dict]:
    for account in accounts:
        try:
            found = account.fetch(rest.ENDPOINTS["channel"].format(channel_id), {})
        except rest.ApiError as e:
            if e.status in DENIED:
                continue
            raise
        if owner := int(found.get("guild_id") or 0):
            counts = runs.ingest(wh, pages(account.fetch), [channel_id], owner)
            return {owner: {"channels_read": 1, "messages": sum(counts.values())}}
    return {}
