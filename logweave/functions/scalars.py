"""Column functions for ids, times, JSON and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First millisecond of the id clock (fixed value), and where the clock begins in an id.
ID_EPOCH_MS, ID_SHIFT = 1420070400000, 22


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def id_to_time(message_id) -> Column:
    return F.timestamp_millis(F.shiftright(_c(message_id), ID_SHIFT) + F.lit(ID_EPOCH_MS))


def time_to_id(time) -> Column:
    """The smallest id of the millisecond of ``time``."""
    return F.shiftleft(F.unix_millis(_c(time)) - F.lit(ID_EPOCH_MS), ID_SHIFT)


def iso_to_time(text) -> Column:
    """ISO 8601 with ``Z``, an offset or neither (UTC); null for null or empty text."""
    return F.to_timestamp(F.nullif(_c(text), F.lit("")))


def to_id(text) -> Column:
    """Ids as bigint, quotes around them ignored; null for null or empty text."""
    return F.expr("cast(nullif(trim(BOTH '\"''' FROM x), '') as bigint)") if text is None else F.nullif(F.regexp_replace(_c(text), "^[\"']+|[\"']+$", ""), F.lit("")).cast("bigint")


def without_nul(text) -> Column:
    """Text without NUL characters, and JSON text without their escapes."""
    bare = F.translate(_c(text), "\u0000", "")
    return F.replace(bare, F.lit("\\u0000"), F.lit(""))


def compact_map(values) -> Column:
    return F.map_filter(_c(values), lambda _, v: v.isNotNull())


def emoji_key(emoji_id, name) -> Column:
    """custom:<id> for an id other than 0, else unicode:<name>."""
    given = to_id(emoji_id)
    return F.when(F.coalesce(given, F.lit(0)) != 0, F.concat(F.lit("custom:"), given.cast("string"))).otherwise(F.concat(F.lit("unicode:"), F.coalesce(_c(name), F.lit("None"))))


def preview(text, n: int = 150) -> Column:
    return F.substring(_c(text), 1, n)


def stable_hue(text) -> Column:
    """Hue in [0, 1) of a 32-bit hash h = 31 h + code point."""
    codes = F.transform(F.split(_c(text), ""), lambda c: F.ascii(c))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda s, c: F.pmod(s * 31 + c, F.lit(1 << 32)))
    signed = F.when(h >= (1 << 31), h - F.lit(1 << 32)).otherwise(h)
    return F.pmod(signed, F.lit(360)) / F.lit(360.0)


def hit_hue(distance, least, most) -> Column:
    """Hue from green to yellow by where a distance lies between the least and the most."""
    spread = F.when(_c(most) == _c(least), F.lit(1.0)).otherwise(_c(most) - _c(least))
    return F.lit(0.33) - F.lit(0.25) * (_c(distance) - _c(least)) / spread
