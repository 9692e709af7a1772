"""Permission bits as 64-bit columns; the bit pattern of all permissions is -1 as a bigint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the API.
ADMINISTRATOR, VIEW_CHANNEL, READ_MESSAGE_HISTORY, CONNECT, MANAGE_THREADS = 1 << 3, 1 << 10, 1 << 16, 1 << 20, 1 << 34
ALL = -1
TEXT_BASED, THREADS, VOICE, FETCHABLE = (0, 1, 2, 3, 5, 10, 11, 12, 13), (10, 11, 12), (2, 13), (0, 5, 15, 16)
TYPE_NAMES = {
    0: "text", 1: "dm", 2: "voice", 3: "group_dm", 4: "category", 5: "announcement", 10: "announcement_thread", 11: "public_thread",
    12: "private_thread", 13: "stage", 14: "directory", 15: "forum", 16: "media",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has(bits, flag: int) -> Column:
    return _c(bits).bitwiseAND(F.lit(flag).cast("bigint")) != 0


def _number(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def bits_of(text) -> Column:
    """Bits from a decimal string; null and empty are none. Values from 2**63 wrap to negative bigints."""
    number = F.coalesce(F.nullif(_c(text).cast("string"), F.lit("")), F.lit("0")).cast("decimal(20,0)")
    return F.when(number >= _number(1 << 63), number - _number(1 << 64)).otherwise(number).cast("bigint")


def unsigned(bits) -> Column:
    number = _c(bits).cast("decimal(20,0)")
    return F.when(number < 0, number + _number(1 << 64)).otherwise(number).cast("decimal(20,0)")


def base(bits) -> Column:
    """Of the OR of all roles' bits: everything for an administrator."""
    return F.when(has(bits, ADMINISTRATOR), F.lit(ALL).cast("bigint")).otherwise(_c(bits))


def in_channel(base_bits, overwrites, user_id, roles, everyone) -> Column:
    """Bits in a channel: overwrites of everyone, of the user's roles together, then of the user."""
    base_bits, overwrites, user_id, roles, everyone = map(_c, (base_bits, overwrites, user_id, roles, everyone))

    def gathered(field: str, which) -> Column:
        return F.aggregate(F.filter(overwrites, which), F.lit(0).cast("bigint"), lambda s, o: s.bitwiseOR(bits_of(o[field])))

    def is_everyone(o):
        return (o["type"] == 0) & (o["id"].cast("bigint") == everyone)

    def is_role(o):
        return (o["type"] == 0) & (o["id"].cast("bigint") != everyone) & F.array_contains(roles, o["id"].cast("bigint"))

    def is_user(o):
        return (o["type"] == 1) & (o["id"].cast("bigint") == user_id)

    out = base_bits
    for which in (is_everyone, is_role, is_user):
        out = out.bitwiseAND(F.bitwise_not(gathered("deny", which))).bitwiseOR(gathered("allow", which))
    return F.when(has(base_bits, ADMINISTRATOR), F.lit(ALL).cast("bigint")).otherwise(out)


def can_view(bits) -> Column:
    return has(bits, VIEW_CHANNEL)


def can_access(bits, channel_type) -> Column:
    """View, and connect where the channel is a voice one."""
    return can_view(bits) & (~_c(channel_type).isin(*VOICE) | has(bits, CONNECT))


def can_read_history(bits) -> Column:
    return has(bits, READ_MESSAGE_HISTORY)


def can_manage_threads(bits) -> Column:
    return has(bits, MANAGE_THREADS)


def is_text_based(channel_type) -> Column:
    return _c(channel_type).isin(*TEXT_BASED)


def is_thread(channel_type) -> Column:
    return _c(channel_type).isin(*THREADS)


def type_name(channel_type) -> Column:
    names = F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, _c(channel_type).cast("int")), F.concat(F.lit("unknown("), _c(channel_type).cast("string"), F.lit(")")))
