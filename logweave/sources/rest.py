"""Pages of a chat API: a client, the rules of retrying and paging, and a batch and a streaming source that read on executors.

A fetcher is a picklable callable (path, params) -> JSON that raises ``ApiError`` for an answer that is none.
``HttpFetcher`` is one over HTTP; callers may bring another.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGE = 100
#: Fixed values of the policy: seconds to wait before the tries after a failure that may pass.
WAITS = (1, 2, 4, 8, 16, 32, 64)
TRIES = 5

#: Paths of the API by name; {}: ids.
ENDPOINTS = {
    "guild": "/guilds/{}", "channels": "/guilds/{}/channels", "roles": "/guilds/{}/roles", "emojis": "/guilds/{}/emojis", "stickers": "/guilds/{}/stickers",
    "events": "/guilds/{}/scheduled-events", "members": "/guilds/{}/members", "me_in_guild": "/users/@me/guilds/{}/member", "active_threads": "/guilds/{}/threads/active",
    "public_archived": "/channels/{}/threads/archived/public", "private_archived": "/channels/{}/threads/archived/private", "channel": "/channels/{}", "messages": "/channels/{}/messages",
    "user": "/users/{}", "me": "/users/@me",
}

Fetcher = Callable[[str, dict], Any]


class ApiError(Exception):
    """An answer with a status that is no success."""

    def __init__(self, status: int, message: str = "", retry_after: float | None = None):
        super().__init__(status, message, retry_after)
        self.status, self.retry_after = status, retry_after


@dataclass(frozen=True)
class HttpFetcher:
    """Asks ``url`` with a token; it travels to the executors, and keeps nothing open between requests."""

    url: str
    token: str
    user_agent: str = "logweave"
    timeout: float = 30.0

    def __call__(self, path: str, params: dict) -> Any:
        query = f"?{urllib.parse.urlencode(params)}" if params else ""
        request = urllib.request.Request(self.url.rstrip("/") + path + query, headers={"Authorization": self.token, "User-Agent": self.user_agent})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                body = answer.read()
        except urllib.error.HTTPError as e:
            after = e.headers.get("Retry-After")
            raise ApiError(e.code, e.reason, None if after is None else float(after)) from None
        return json.loads(body) if body else None


@dataclass(frozen=True)
class Patient:
    """A fetcher that tries again by ``next_step``."""

    fetch: Fetcher
    wait: Callable[[float], None] = time.sleep

    def __call__(self, path: str, params: dict | None = None) -> Any:
        tried = 0
        while True:
            try:
                return self.fetch(path, params or {})
            except ApiError as e:
                error, step = e, next_step(e.status, tried, e.retry_after)
            except OSError as e:  # no answer
                error, step = e, next_step(None, tried)
            if step.action != "wait":
                raise error
            self.wait(step.seconds)
            tried += step.counts


@dataclass(frozen=True)
class Decision:
    action: str  # ok, fail, wait
    seconds: float = 0.0
    counts: bool = False  # whether the try is used up


def next_step(status: int | None, tried: int, retry_after: float | None = None) -> Decision:
    """What to do after an answer (None: no answer). ``tried``: tries used up so far."""
    if status is not None and 200 <= status < 300:
        return Decision("ok")
    if status == 429:
        return Decision("wait", retry_after if retry_after is not None else 1.0)
    if status is not None and status < 500:
        return Decision("fail")
    if tried + 1 >= TRIES:
        return Decision("fail", counts=True)
    return Decision("wait", float(WAITS[min(tried, len(WAITS) - 1)]), counts=True)


def backfill(fetch: Fetcher, channel_id: int, before: int | None = None, size: int = PAGE) -> Iterator[dict]:
    """All messages older than ``before``, page by page, until one is empty or short."""
    while True:
        page = fetch(ENDPOINTS["messages"].format(channel_id), {"limit": min(size, PAGE)} | ({"before": before} if before else {}))
        yield from page
        if len(page) < min(size, PAGE):
            return
        before = min(int(m["id"]) for m in page)


def newer(fetch: Fetcher, channel_id: int, after: int, size: int = PAGE) -> list[dict]:
    """One page of messages after an id; a short one is the last."""
    return fetch(ENDPOINTS["messages"].format(channel_id), {"limit": min(size, PAGE), "after": after})


def archived_threads(fetch: Callable[[str, dict], dict], channel_id: int, private: bool = False) -> Iterator[dict]:
    """Threads page by page while there are more, from the time the last one was archived."""
    before = None
    while True:
        page = fetch(ENDPOINTS["private_archived" if private else "public_archived"].format(channel_id), {"limit": PAGE} | ({"before": before} if before else {}))
        yield from page.get("threads", [])
        if not page.get("has_more") or not page.get("threads"):
            return
        before = page["threads"][-1]["thread_metadata"]["archive_timestamp"]


def after(fetch: Fetcher, channel_id: int, start: int, upto: int | None = None, size: int = PAGE) -> Iterator[dict]:
    """All messages newer than ``start``, and not newer than ``upto``, page by page until one is short."""
    while True:
        page = newer(fetch, channel_id, start, size)
        yield from (m for m in page if upto is None or int(m["id"]) <= upto)
        start = max([start, *(int(m["id"]) for m in page)])
        if len(page) < min(size, PAGE) or (upto is not None and start >= upto):
            return


@dataclass
class _Span(InputPartition):
    """A channel, and the ids to read: newer than the first, not newer than the second."""

    channel: int
    start: int | None
    upto: int | None


def _fetcher(options) -> Fetcher:
    return Patient(HttpFetcher(options["url"], options.get("token", ""), options.get("user_agent", "logweave")))


def _rows(messages: Iterator[dict], channel: int) -> Iterator[tuple]:
    """A channel that may not be read has none."""
    try:
        for message in messages:
            yield channel, json.dumps(message)
    except ApiError as e:
        if e.status != 403:
            raise


class _Backfill(DataSourceReader):
    def __init__(self, options):
        self.options, self.channels = dict(options), [int(c) for c in options["channels"].split(",")]
        self.before = int(options["before"]) if options.get("before") else None

    def partitions(self):
        return [_Span(c, None, self.before) for c in self.channels]

    def read(self, partition):
        yield from _rows(backfill(_fetcher(self.options), partition.channel, partition.upto), partition.channel)


class _Forward(DataSourceStreamReader):
    """Messages after the newest id of each channel. The driver asks each channel for its last id, which is the end of a
    micro-batch; executors read the pages up to it, each a channel or one of ``ranges`` equal parts of its ids."""

    def __init__(self, options):
        self.options, self.channels = dict(options), options["channels"].split(",")
        self.ranges, self.start = int(options.get("ranges", 1)), int(options.get("after", 0))
        self.known: dict[str, int] = {}

    def initialOffset(self):
        return dict.fromkeys(self.channels, self.start)

    def latestOffset(self):
        fetch = _fetcher(self.options)
        for c in self.channels:
            try:
                last = fetch(ENDPOINTS["channel"].format(c)).get("last_message_id")
            except ApiError as e:
                if e.status != 403:
                    raise
                last = None
            self.known[c] = max(self.known.get(c, self.start), int(last or 0))
        return dict(self.known)

    def partitions(self, start, end):
        spans = []
        for c in self.channels:
            lo, hi = int(start.get(c, self.start)), int(end.get(c, 0))
            edges = sorted({lo + (hi - lo) * k // self.ranges for k in range(self.ranges + 1)}) if hi > lo else []
            spans += [_Span(int(c), a, b) for a, b in zip(edges, edges[1:])]  # noqa: B905
        return spans

    def read(self, partition):
        yield from _rows(after(_fetcher(self.options), partition.channel, partition.start, partition.upto), partition.channel)


class ChatPages(DataSource):
    """format("chat_pages"): channel_id, raw. Options: url, token, user_agent, channels (comma-joined ids), before or after, ranges."""

    @classmethod
    def name(cls):
        return "chat_pages"

    def schema(self):
        return "channel_id bigint, raw string"

    def reader(self, schema):
        return _Backfill(self.options)

    def streamReader(self, schema):
        return _Forward(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChatPages)
