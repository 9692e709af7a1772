"""Queries of rendering, tokens, ingest mappers, merges and permissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mappers, scalars
from ..functions import permissions as P
from ..functions import rendering as R
from ..operators import lookups, merge
from ..sources import adapters as A
from .chunking import LOG


#: A tokenizer file; any other of the kind may be named in its place.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def token_counts_by_tokenizer(spark, sf_dir):
    """Tokens of every text by a tokenizer beside the estimate from its length."""
    texts = A.chunk_texts(spark, sf_dir)
    return texts.select("chunk_id", R.tokenizer_counter(TOKENIZER)("text").alias("tokens"), F.col("token_count").alias("estimate"))


def truncated_by_tokenizer(spark, sf_dir):
    """Every text cut after its first 60 tokens."""
    cut = R.tokenizer_truncator(TOKENIZER, R.DESCRIPTION_TOKENS)("text")
    return A.chunk_texts(spark, sf_dir).select("chunk_id", cut.alias("text"))


def token_estimates(spark, sf_dir):
    return A.messages(spark, sf_dir).select("message_id", "cost")


def message_format(spark, sf_dir):
    return A.messages(spark, sf_dir).select("message_id", "line")


def attachment_labels(spark, sf_dir):
    """File names made of part names: short and long, with known and unknown extensions, and with none."""
    ends = F.element_at(F.array(*[F.lit(x) for x in (".png", ".TXT", ".tar.gz", "", ".weird", ".")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.when(F.col("p_partkey") % 4 == 0, F.repeat(F.lit("long-name-"), 12)).otherwise(F.lit("")), ends)
    return A.table(spark, sf_dir, "part").select("p_partkey", R.label(name).alias("label"), R.attachment_line(name).alias("line"))


def embed_format(spark, sf_dir):
    """Orders as embeds: the clerk's priority as author, a long description, fields and a footer."""
    o = A.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    field = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    embed = F.struct(
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("Order "), key)).alias("title"),
        F.when(F.col("o_orderkey") % 5 != 0, F.repeat(F.concat(key, F.lit(" ")), (F.col("o_orderkey") % 70).cast("int"))).alias("description"),
        F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("name")).alias("author"),
        F.array(field("status", F.col("o_orderstatus")), field("", key), field("none", F.lit("")), field("customer", F.repeat(F.col("o_custkey").cast("string"), 40)), field("d", key), field("sixth", key)).alias("fields"),
        F.struct(F.when(F.col("o_orderkey") % 7 == 0, F.lit("end")).alias("text")).alias("footer"),
    )
    return o.select("o_orderkey", R.embed_line(embed).alias("line"))


def preview_150(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", scalars.preview("text").alias("preview"))


def stable_hue(spark, sf_dir):
    return A.table(spark, sf_dir, "customer").select("c_custkey", F.round(scalars.stable_hue("c_name"), 9).alias("hue"))


def search_hit_hue(spark, sf_dir):
    """Colour of hits by their distance among all."""
    span = A.table(spark, sf_dir, "supplier").agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    return A.table(spark, sf_dir, "supplier").join(F.broadcast(span)).select("s_suppkey", F.round(scalars.hit_hue("s_acctbal", "lo", "hi"), 9).alias("hue"))  # span is one row


def snowflake_roundtrip(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.withColumn("id", scalars.time_to_id("t")).select("event_id", "id", F.unix_millis(scalars.id_to_time("id")).alias("ms"))


def iso_parse(spark, sf_dir):
    """ISO times with Z, an offset, nothing, or empty text."""
    e = A.table(spark, sf_dir, "events")
    local = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.element_at(F.array(F.concat(local, F.lit("Z")), F.concat(local, F.lit("+02:00")), local, F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", F.unix_seconds(scalars.iso_to_time(text)).alias("seconds"))


def props_json_extract(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def null_byte_sanitize(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    dirty = F.concat(F.substring("text", 1, 20), F.lit("\u0000"), F.substring("text", 21, 20), F.lit("\\u0000x"))
    return c.select("conv_id", "turn", scalars.without_nul(dirty).alias("clean"))


def emoji_key(spark, sf_dir):
    n = A.table(spark, sf_dir, "nation")
    return n.select("n_nationkey", scalars.emoji_key((F.col("n_nationkey") % 6).cast("string"), F.lower("n_name")).alias("emoji_key"))


def id_parsing(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    text = F.element_at(F.array(F.col("c_custkey").cast("string"), F.concat(F.lit('"'), F.col("c_custkey").cast("string"), F.lit('"')), F.lit("")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return c.select("c_custkey", scalars.to_id(text).alias("id"))


def message_mapping(spark, sf_dir):
    """Messages as API payloads, and back through the mapper."""
    log = A.messages(spark, sf_dir)
    s = lambda c: F.col(c).cast("string")
    user = F.struct(s("author_id").alias("id"), F.col("username"))
    payload = F.struct(
        s("message_id").alias("id"), s("channel_id").alias("channel_id"), F.when(F.col("message_id") % 2 == 0, s("guild_id")).alias("guild_id"), user.alias("author"), F.concat(F.lit("\u0000"), F.col("content")).alias("content"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.transform("mentions", lambda u: F.struct(u.cast("string").alias("id"))).alias("mentions"), F.struct(s("ref_id").alias("message_id")).alias("message_reference"),
    )
    got = mappers.messages(log.select(F.to_json(payload).alias("raw")), guild_id=77)
    return got.select("message_id", "channel_id", "author_id", "guild_id", F.length("content").alias("n_chars"), F.unix_seconds("created_at").alias("created_s"), "type", F.size("mentions").alias("n_mentions"), "referenced_message_id")


def users_of_messages(spark, sf_dir):
    """Authors and mentioned users of payloads, one row a user, the first seen."""
    log = A.messages(spark, sf_dir)
    user = F.struct(F.col("author_id").cast("string").alias("id"), F.col("username"))
    payload = F.struct(F.col("message_id").cast("string").alias("id"), user.alias("author"), F.transform("mentions", lambda u: F.struct(u.cast("string").alias("id"), F.concat(F.lit("m"), u.cast("string")).alias("username"))).alias("mentions"))
    told = mappers.users_of_messages(log.select(F.to_json(payload).alias("raw")))
    return merge.keep_first(told, ["user_id"], ["message_id", "at"]).select("user_id", "username", "message_id")


def _halves(spark, sf_dir):
    """Customers as a table and a batch that overlap; the batch has repeats."""
    c = A.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    old = c.where("c_custkey % 3 <> 0")
    new = c.where("c_custkey % 2 = 0").withColumns({"seq": F.lit(1), "c_name": F.concat("c_name", F.lit("+"))})
    again = new.where("c_custkey % 5 = 0").withColumns({"seq": F.lit(2), "c_name": F.concat("c_name", F.lit("+")), "c_mktsegment": F.lit(None).cast("string")})
    return old, new.unionByName(again)


def merge_insert_ignore(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return merge.insert_ignore(old, new, ["c_custkey"], ["seq"])


def merge_update_all(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return merge.update_all(old, new, ["c_custkey"], ["seq"])


def merge_partial_columns(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return merge.update_some(old, new.withColumn("c_acctbal", F.col("c_acctbal") + 1000), ["c_custkey"], ["c_name", "c_mktsegment"], ["seq"])


def user_dedup_keep_first(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    return merge.keep_first(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


def channel_bounds_monotone(spark, sf_dir):
    e = A.event_messages(spark, sf_dir)
    state = e.where("message_id % 4 = 1 and channel_id <> 'click'").groupBy("channel_id").agg(F.min("message_id").alias("oldest"), F.max("message_id").alias("newest")).withColumn("complete", F.col("channel_id") < "m")
    return merge.bounds(state, e.where("message_id % 4 = 2 and channel_id <> 'view'").select("channel_id", "message_id"))


def incremental_after_checkpoint(spark, sf_dir):
    """Messages of each channel after its checkpoint, here two thirds of its ids."""
    e = A.event_messages(spark, sf_dir)
    at = e.groupBy("channel_id").agg(F.floor(F.max("message_id") * 2 / 3).alias("checkpoint"))
    return e.join(F.broadcast(at), "channel_id").where("message_id > checkpoint").groupBy("channel_id").agg(F.count("*").alias("pending"), F.min("message_id").alias("next"))  # a row for each of five event types


def short_page_completion(spark, sf_dir):
    """Pages of 100 that a backfill of each channel takes, and whether the last one is short."""
    n = A.event_messages(spark, sf_dir).groupBy("channel_id").agg(F.count("*").alias("n"))
    return n.select("channel_id", (F.floor(F.col("n") / 100) + 1).cast("bigint").alias("pages"), (F.col("n") % 100).alias("last_page"))


def known_parents(spark, sf_dir):
    return merge.with_known_parents(A.channels(spark, sf_dir)).select("channel_id", "parent_id")


def base_permissions_bit_or(spark, sf_dir):
    """A role for each order: bits from its key, by customer."""
    o = A.table(spark, sf_dir, "orders").select("o_custkey", F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("o_orderkey") % 41).cast("int")).alias("bits"))
    return o.groupBy("o_custkey").agg(F.bit_or("bits").alias("bits")).select("o_custkey", P.unsigned(P.base("bits")).cast("string").alias("permissions"))


def _overwritten(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    bit = lambda by, at: F.call_function("shiftleft", F.lit(1).cast("bigint"), (k % by + at).cast("int")).cast("string")
    row = lambda i, t, allow, deny: F.struct(i.cast("string").alias("id"), F.lit(t).alias("type"), allow.alias("allow"), deny.alias("deny"))
    overwrites = F.array(row(F.lit(0), 0, F.lit(None).cast("string"), bit(12, 0)), row(k % 5 + 1, 0, bit(7, 8), F.lit("1024")), row(F.lit(3), 0, bit(9, 10), F.lit("")), row(k - k % 2, 1, F.lit("65536"), bit(3, 10)))
    bits = F.lit(1024 + 65536).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), (k % 22).cast("int")))
    return c.select("c_custkey", P.in_channel(P.base(bits), overwrites, k, F.array(F.lit(3).cast("bigint"), k % 5 + 1), F.lit(0)).alias("bits"), (k % 17).cast("int").alias("type"))


def channel_permissions_overwrites(spark, sf_dir):
    return _overwritten(spark, sf_dir).select("c_custkey", P.unsigned("bits").cast("string").alias("permissions"))


def accessible_channels(spark, sf_dir):
    c = _overwritten(spark, sf_dir)
    return c.select("c_custkey", P.can_view("bits").alias("view"), P.can_access("bits", "type").alias("access"), P.can_read_history("bits").alias("history"), (P.is_text_based("type") & P.can_access("bits", "type")).alias("readable"), (F.col("type").isin(*P.FETCHABLE) & P.can_view("bits")).alias("fetchable"))


def channel_type_names(spark, sf_dir):
    return A.channels(spark, sf_dir).select("channel_id", P.type_name("type").alias("type_name"), P.is_text_based("type").alias("text_based"), P.is_thread("type").alias("thread"))


def pending_stats(spark, sf_dir):
    t = A.chunk_texts(spark, sf_dir)
    return lookups.pending_stats(t.select("chunk_id", "embedding_status"), t.select("chunk_id", "token_count"), 1000)


def pending_page_keyset(spark, sf_dir):
    """The page after the first: rows by token count from a given row on."""
    return lookups.page_after(A.chunk_texts(spark, sf_dir).where("embedding_status = 'pending'").select("token_count", "chunk_id"), (200, 0), 500)


def status_after_embed(spark, sf_dir):
    t = A.chunk_texts(spark, sf_dir).select("chunk_id", "embedding_status")
    return merge.set_status(t, t.where("chunk_id % 5 = 0"), t.where("chunk_id % 20 = 0"))


_BITS = (
    "b as (select c_custkey k, (1024+65536) | (cast(1 as bigint) << cast(c_custkey%22 as integer)) b from customer),"
    " e as (select k, b, (b & ~(cast(1 as bigint) << cast(k%12 as integer))) p from b),"
    " r as (select k, b, (p & ~(1024)) | (cast(1 as bigint) << cast(k%7+8 as integer)) | (cast(1 as bigint) << cast(k%9+10 as integer)) p from e),"
    " u as (select k, case when (b & 8) <> 0 then -1 when k%2 = 0 then (p & ~(cast(1 as bigint) << cast(k%3+10 as integer))) | 65536 else p end p, k%17 as type from r)"
)
_HALVES = (
    "old as (select c_custkey, c_name, c_acctbal, c_mktsegment from customer where c_custkey % 3 <> 0), new as (select c_custkey, c_name || '+' c_name, c_acctbal, c_mktsegment, 1 seq from customer where c_custkey % 2 = 0"
    " union all select c_custkey, c_name || '++', c_acctbal, null, 2 from customer where c_custkey % 10 = 0)"
)
_NAME = "replace(p_name, ' ', '-') || case when p_partkey%4 = 0 then repeat('long-name-', 12) else '' end || case p_partkey%6 when 0 then '.png' when 1 then '.TXT' when 2 then '.tar.gz' when 3 then '' when 4 then '.weird' else '.' end"
_LABEL = "case when p_partkey%6 = 0 then 'Image' when p_partkey%6 = 1 then 'Document' when p_partkey%6 = 2 then 'Archive' else 'File' end"
_SHORT = "case when length(f) <= 100 then f when p_partkey%6 = 0 then f[:93] || '....png' when p_partkey%6 = 1 then f[:93] || '....TXT' when p_partkey%6 = 2 then f[:94] || '....gz' when p_partkey%6 = 3 then f[:97] || '...' when p_partkey%6 = 4 then f[:91] || '....weird' else f[:96] || '....' end"

SQL = {
    "token_estimates": f"with {LOG} select message_id, cost from log",
    "message_format": f"with {LOG} select message_id, line from log",
    "attachment_labels": f"with a as (select p_partkey, {_NAME} f from part), s as (select p_partkey, {_SHORT} s, {_LABEL} label from a) select p_partkey, case when p_partkey%6 = 3 then 'File' else label end as label, '[' || case when p_partkey%6 = 3 and contains(s, '.') then 'File' else label end || ': ' || s || ']' as line from s",
    "embed_format": "with e as (select o_orderkey k, case when o_orderkey%3 <> 0 then '\"Order ' || o_orderkey || '\"' end t, case when o_orderkey%2 = 0 then 'by ' || o_orderpriority end a, nullif(case when o_orderkey%5 <> 0 then repeat(o_orderkey || ' ', cast(o_orderkey%70 as integer)) end, '') d, 'status: ' || o_orderstatus f1, repeat(cast(o_custkey as varchar), 40) f2, case when o_orderkey%7 = 0 then 'end' end g from orders)"
    " select k o_orderkey, '[Embed: ' || concat_ws(' - ', t, a, case when (length(d)+3)//4 > 60 then d[:240] || '...' else d end, f1, 'customer: ' || case when (length(f2)+3)//4 > 30 then f2[:120] || '...' else f2 end, 'd: ' || k, g) || ']' as line from e",
    "preview_150": "select doc_id, substring(text, 1, 150) preview from documents",
    "stable_hue": "with h as (select c_custkey, list_reduce(list_prepend(cast(0 as hugeint), list_transform(string_split(c_name, ''), lambda c: cast(unicode(c) as hugeint))), lambda s, c: (s*31 + c) % 4294967296) h from customer), g as (select c_custkey, case when h >= 2147483648 then h - 4294967296 else h end h from h) select c_custkey, round(((h % 360) + 360) % 360 / 360.0, 9) hue from g",
    "search_hit_hue": "select s_suppkey, round(0.33 - 0.25 * (s_acctbal - min(s_acctbal) over ()) / case when max(s_acctbal) over () = min(s_acctbal) over () then 1 else max(s_acctbal) over () - min(s_acctbal) over () end, 9) hue from supplier",
    "snowflake_roundtrip": "select event_id, (epoch_us(ts)//1000 - 1420070400000) << 22 as id, epoch_us(ts)//1000 ms from events",
    "iso_parse": "select event_id, case event_id%4 when 3 then null when 1 then cast(epoch(date_trunc('second', ts)) as bigint) - 7200 else cast(epoch(date_trunc('second', ts)) as bigint) end as seconds from events",
    "props_json_extract": "with e as (select event_type, cast(json_extract_string(props, '$.k') as bigint) k from events) select event_type, count(k) n, cast(sum(k) as bigint) total, max(k) most from e group by event_type",
    "null_byte_sanitize": "select conv_id, turn, substring(text, 1, 40) || 'x' clean from conversations",
    "emoji_key": "select n_nationkey, case when n_nationkey%6 <> 0 then 'custom:' || n_nationkey%6 else 'unicode:' || lower(n_name) end emoji_key from nation",
    "id_parsing": "select c_custkey, case when c_custkey%3 = 2 then null else c_custkey end as id from customer",
    "message_mapping": f"with {LOG} select message_id, channel_id, author_id, case when message_id%2 = 0 then guild_id else 77 end guild_id, length(content) n_chars, created_s, 0 as type, case when message_id%4 = 0 then 2 else 0 end n_mentions, ref_id referenced_message_id from log",
    "users_of_messages": f"with {LOG}, u as (select author_id user_id, 'user' || author_id username, message_id, 0 as pos from log union all select author_id + 1, 'm' || (author_id + 1), message_id, 1 from log where message_id%4 = 0 union all select author_id - 1, 'm' || (author_id - 1), message_id, 2 from log where message_id%4 = 0), r as (select *, row_number() over (partition by user_id order by message_id, pos) k from u) select user_id, username, message_id from r where k = 1",
    "merge_insert_ignore": f"with {_HALVES} select * from old union all select c_custkey, c_name, c_acctbal, c_mktsegment from new where seq = 1 and c_custkey not in (select c_custkey from old)",
    "merge_update_all": f"with {_HALVES}, l as (select *, row_number() over (partition by c_custkey order by seq desc) k from new) select * from old where c_custkey not in (select c_custkey from new) union all select c_custkey, c_name, c_acctbal, c_mktsegment from l where k = 1",
    "merge_partial_columns": f"with {_HALVES}, l as (select *, row_number() over (partition by c_custkey order by seq desc) k from new) select coalesce(o.c_custkey, l.c_custkey) c_custkey, case when l.c_custkey is null then o.c_name else l.c_name end c_name, coalesce(o.c_acctbal, l.c_acctbal + 1000) c_acctbal, case when l.c_custkey is null then o.c_mktsegment else l.c_mktsegment end c_mktsegment from old o full join (select * from l where k = 1) l on o.c_custkey = l.c_custkey",
    "user_dedup_keep_first": "with r as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) k from orders) select o_custkey, o_orderkey, o_totalprice from r where k = 1",
    "channel_bounds_monotone": "with s as (select event_type channel_id, min(event_id) oldest, max(event_id) newest, event_type < 'm' complete from events where event_id%4 = 1 and event_type <> 'click' group by event_type), b as (select event_type channel_id, min(event_id) lo, max(event_id) hi from events where event_id%4 = 2 and event_type <> 'view' group by event_type) select coalesce(s.channel_id, b.channel_id) channel_id, least(oldest, lo) oldest, greatest(newest, hi) newest, coalesce(complete, false) complete from s full join b on s.channel_id = b.channel_id",
    "incremental_after_checkpoint": "with c as (select event_type channel_id, floor(max(event_id)*2/3) cp from events group by event_type) select event_type channel_id, count(*) pending, min(event_id) as next from events join c on c.channel_id = event_type where event_id > cp group by event_type",
    "short_page_completion": "select event_type channel_id, count(*)//100 + 1 pages, count(*)%100 last_page from events group by event_type",
    "known_parents": "select cast(n_nationkey as bigint) channel_id, case when n_nationkey%4 = 0 and n_nationkey + 3 in (select n_nationkey from nation) then cast(n_nationkey + 3 as bigint) end parent_id from nation",
    "base_permissions_bit_or": "with b as (select o_custkey, bit_or(cast(1 as bigint) << cast(o_orderkey%41 as integer)) b from orders group by o_custkey) select o_custkey, case when (b & 8) <> 0 then '18446744073709551615' else cast(b as varchar) end permissions from b",
    "channel_permissions_overwrites": f"with {_BITS} select k c_custkey, case when p < 0 then '18446744073709551615' else cast(p as varchar) end permissions from u",
    "accessible_channels": f"with {_BITS}, v as (select k, type, (p & 1024) <> 0 view, (p & 1024) <> 0 and (type not in (2, 13) or (p & 1048576) <> 0) access, (p & 65536) <> 0 history from u) select k c_custkey, view, access, history, access and type in (0,1,2,3,5,10,11,12,13) readable, view and type in (0,5,15,16) fetchable from v",
    "channel_type_names": "with t as (select cast(n_nationkey as bigint) channel_id, [0,2,4,5,10,11,13,15,99][n_nationkey%9+1] t from nation) select channel_id, case t when 0 then 'text' when 2 then 'voice' when 4 then 'category' when 5 then 'announcement' when 10 then 'announcement_thread' when 11 then 'public_thread' when 13 then 'stage' when 15 then 'forum' else 'unknown(' || t || ')' end type_name, t in (0,2,5,10,11,13) text_based, t in (10,11) thread from t",
    "pending_stats": "with t as (select (n+3)//4 t from (select length(text) n from documents where doc_id%3 <> 0)) select count(*) filter (where t <= 1000) embeddable, cast(coalesce(sum(t) filter (where t <= 1000), 0) as bigint) total_tokens, count(*) filter (where t > 1000) oversized from t",
    "pending_page_keyset": "with t as (select (length(text)+3)//4 token_count, doc_id chunk_id from documents where doc_id%3 <> 0) select * from t where token_count > 200 or (token_count = 200 and chunk_id > 0) order by 1, 2 limit 500",
    "status_after_embed": "select doc_id chunk_id, case when doc_id%20 = 0 then 'pending' when doc_id%5 = 0 or doc_id%3 = 0 then 'embedded' else 'pending' end embedding_status from documents",
}
QUERIES = {
    f.__name__: f
    for f in (
        token_estimates, token_counts_by_tokenizer, truncated_by_tokenizer, message_format, attachment_labels, embed_format, preview_150, stable_hue, search_hit_hue, snowflake_roundtrip, iso_parse, props_json_extract, null_byte_sanitize, emoji_key, id_parsing,
        message_mapping, users_of_messages, merge_insert_ignore, merge_update_all, merge_partial_columns, user_dedup_keep_first, channel_bounds_monotone, incremental_after_checkpoint, short_page_completion,
        known_parents, base_permissions_bit_or, channel_permissions_overwrites, accessible_channels, channel_type_names, pending_stats, pending_page_keyset, status_after_embed,
    )
}
