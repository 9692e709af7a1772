"""Queries of the chunkers over the message log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rendering as R
from ..operators import chunking as C
from ..operators import segments as S
from ..sources import adapters as A

def _listed(ids="message_ids"):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias(ids)



def sliding_window_chunks(spark, sf_dir):
    return C.sliding_windows(A.messages(spark, sf_dir)).select("channel_id", "start_message_id", "end_message_id", "n_messages", _listed(), "chunk_state")


def sliding_window_membership(spark, sf_dir):
    chunks = C.sliding_windows(A.messages(spark, sf_dir))
    return chunks.select("channel_id", "start_message_id", F.posexplode("message_ids").alias("at", "message_id")).select("channel_id", "start_message_id", F.col("at").cast("bigint").alias("at"), "message_id")


def author_group_chunks_60s(spark, sf_dir):
    return C.author_groups(A.messages(spark, sf_dir)).select("channel_id", "author_id", "start_message_id", "end_message_id", "n_messages", _listed(), "chunk_state")


def author_group_events_1h(spark, sf_dir):
    groups = C.author_groups(A.event_messages(spark, sf_dir), S.Budget(max_cost=40, max_gap_s=3600, hard_cost=C.HARD_COST))
    return groups.select("channel_id", "author_id", "start_message_id", "end_message_id", "n_messages", "chunk_state")


def author_sessions_gap_only(spark, sf_dir):
    return C.author_sessions(A.event_messages(spark, sf_dir), 3600)


def reply_chains(spark, sf_dir):
    return C.reply_chains(A.messages(spark, sf_dir)).select("leaf_message_id", "channel_id", _listed(), "n_messages", "cross_channel_ref")


def reply_chain_depth_hist(spark, sf_dir):
    return C.reply_chains(A.messages(spark, sf_dir)).groupBy("n_messages").agg(F.count("*").alias("chains"))


def chunk_metadata_sets(spark, sf_dir):
    log = A.messages(spark, sf_dir)
    return C.describe(C.sliding_windows(log), log).select("channel_id", "start_message_id", _listed("author_ids"), _listed("mentioned_user_ids"), "has_attachments", "first_message_s", "last_message_s")


def chunk_texts_sequential(spark, sf_dir):
    log = A.messages(spark, sf_dir)
    texts = C.texts(C.sliding_windows(log), log, ["channel_id", "start_message_id"])
    return texts.select("*", R.count_tokens("text").alias("token_count"))


def chunk_texts_reply(spark, sf_dir):
    log = A.messages(spark, sf_dir)
    return C.texts(C.reply_chains(log), log, ["leaf_message_id"], reply_chain=True)


def _every_chunk(spark, sf_dir):
    log = A.messages(spark, sf_dir)
    windows, groups = (f(log).select("chunk_type", "channel_id", "start_message_id", "chunk_state") for f in (C.sliding_windows, C.author_groups))
    chains = C.reply_chains(log).select(F.lit("reply_chain").alias("chunk_type"), "channel_id", F.col("leaf_message_id").alias("start_message_id"), F.lit("closed").alias("chunk_state"))
    return windows.unionByName(groups).unionByName(chains)


def chunk_count_by_type(spark, sf_dir):
    return _every_chunk(spark, sf_dir).groupBy("chunk_type").agg(F.count("*").alias("chunks"))


def open_chunks(spark, sf_dir):
    return _every_chunk(spark, sf_dir).where("chunk_state = 'open'").groupBy("chunk_type").agg(F.count("*").alias("chunks"), F.max("start_message_id").alias("latest"))


def chunk_natural_key_dedup(spark, sf_dir):
    """How many chunks share a natural key; none may."""
    return _every_chunk(spark, sf_dir).groupBy("chunk_type", "channel_id", "start_message_id").count().groupBy("chunk_type").agg(F.max("count").alias("most_of_a_key"))


# SQL of the comparing engine.
LOG = (
    "m0 as (" + A.MESSAGES.format(conversations="conversations") + "), m as (select *, '[user' || author_id || '] ' || strftime(make_timestamp(created_s*1000000), '%Y-%m-%d')"
    " || case when content <> '' then chr(10) || content else '' end || case when filename is null then '' else chr(10) || '[' || case message_id%7 when 0 then 'Image' when 1 then 'Video' when 2 then 'Audio' when 3 then 'Document' when 4 then 'Code' when 5 then 'Archive' else 'File' end"
    " || ': ' || filename || ']' end as line from m0), log as (select *, (length(line)+3)//4+2 as cost from m)"
)
_WINDOWS = (
    f"with recursive {LOG}, r as (select channel_id ch, message_id id, row_number() over (partition by channel_id order by message_id) i, cost t from log where type <> 21 and cost <= 32768),"
    " c as (select *, sum(t) over (partition by ch order by i rows unbounded preceding) c from r),"
    " f as (select ch, i, c, cast(1 as bigint) s from c where i = 1 union all select n.ch, n.i, n.c, case when n.c - coalesce(p.c, 0) > 500 then n.i - least(greatest(1, (n.i - f.s)//4), 10) else f.s end"
    " from f join c n on n.ch = f.ch and n.i = f.i + 1 left join c p on p.ch = f.ch and p.i = f.s - 1),"
    " w as (select ch, s, max(i) e, s = max(s) over (partition by ch) as is_open from f group by ch, s),"
    " x as (select w.ch, w.s, w.is_open, c.i, c.id from w join c on c.ch = w.ch and c.i between w.s and w.e)"
)


def _groups(source: str, gap: int, most: int) -> str:
    return (
        f"r as (select channel_id ch, author_id a, message_id id, created_s cs, cost t, row_number() over (partition by channel_id, author_id order by message_id) i from {source} where type <> 21),"
        " c as (select *, sum(t) over (partition by ch, a order by i rows unbounded preceding) c from r),"
        f" f as (select ch, a, i, id, cs, c, cast(1 as bigint) s from c where i = 1 union all select n.ch, n.a, n.i, n.id, n.cs, n.c, case when n.cs - f.cs > {gap} or n.c - coalesce(p.c, 0) > {most} then n.i else f.s end"
        " from f join c n on n.ch = f.ch and n.a = f.a and n.i = f.i + 1 left join c p on p.ch = f.ch and p.a = f.a and p.i = f.s - 1)"
    )


_AUTHORS = f"with recursive {LOG}, {_groups('log', 60, 1000)}, g as (select ch, a, s, min(id) first_id, max(id) last_id, count(*) n, string_agg(cast(id as varchar), ',' order by id) ids, s = max(s) over (partition by ch, a) is_open from f group by ch, a, s)"
_EVENTS = "ev as (select event_id message_id, event_type channel_id, user_id author_id, 0 as type, cast(epoch(ts) as bigint) created_s, (length(props)+3)//4 as cost from events)"
_CHAINS = (
    f"with recursive {LOG}, w as (select message_id leaf, channel_id ch, message_id id, ref_id, type, content, 1 d, cost tot, ',' || message_id || ',' path from log where ref_id is not null and ref_id <> 0 and type <> 21"
    " union all select w.leaf, w.ch, p.message_id, p.ref_id, p.type, p.content, w.d + 1, w.tot + p.cost, w.path || p.message_id || ',' from w join log p on p.message_id = w.ref_id"
    " where w.d < 20 and w.tot < 5000 and p.channel_id = w.ch and not contains(w.path, ',' || p.message_id || ',')),"
    " x as (select w.leaf, min(p.message_id) cross_ref from w join log p on p.message_id = w.ref_id where w.d < 20 and w.tot < 5000 and p.channel_id <> w.ch group by w.leaf),"
    " k as (select leaf, any_value(ch) ch, max(tot) mt, string_agg(cast(id as varchar), ',' order by d desc) filter (where type <> 21) ids, count(*) filter (where type <> 21) n, max(case when type <> 21 and content <> '' then 1 else 0 end) said from w group by leaf),"
    " chains as (select k.leaf, k.ch, k.ids, k.n, x.cross_ref from k left join x on x.leaf = k.leaf where mt <= 32768 and said = 1)"
)
_EVERY = (
    _WINDOWS
    + f", {_groups('log', 60, 1000).replace('r as', 'r2 as').replace('from r)', 'from r2)').replace('c as', 'c2 as').replace('from c where', 'from c2 where').replace('join c n', 'join c2 n').replace('join c p', 'join c2 p').replace('f as (select ch, a', 'f2 as (select ch, a').replace('from f join', 'from f2 join').replace('f.', 'f2.')},"
    + " g as (select ch, s, min(id) first_id, string_agg(cast(id as varchar), ',' order by id) ids, s = max(s) over (partition by ch, a) is_open from f2 group by ch, a, s),"
    + _CHAINS.split(LOG + ", ", 1)[1].replace("w as", "w3 as").replace("from w ", "from w3 ").replace("w.", "w3.").replace("x as", "x3 as").replace("join x on x.leaf", "join x3 x on x.leaf").replace("k as", "k3 as").replace("from k ", "from k3 k ")
    + ", every as (select 'sliding_window' chunk_type, ch channel_id, min(id) start_message_id, is_open, string_agg(cast(id as varchar), ',' order by i) message_ids from x group by ch, s, is_open union all select 'author_group', ch, first_id, is_open, ids from g union all select 'reply_chain', ch, leaf, false, ids from chains)"
)

_TEXTS = (
    _EVERY + ", members as (select chunk_type, start_message_id, message_ids, unnest(string_split(message_ids, ',')) mid, generate_subscripts(string_split(message_ids, ','), 1) pos from every),"
    " told as (select chunk_type, start_message_id, message_ids, string_agg(case when chunk_type = 'reply_chain' and pos > 1 then '↳ ' else '' end || line, chr(10) || chr(10) order by pos) txt from members join log on message_id = cast(mid as bigint) group by all)"
    " select every.chunk_type, channel_id, every.start_message_id, case when is_open then 'open' else 'closed' end chunk_state, every.message_ids, txt as text from every join told on told.chunk_type = every.chunk_type and told.start_message_id = every.start_message_id and told.message_ids = every.message_ids"
)

SQL = {
    "sliding_window_chunks": _WINDOWS + " select ch channel_id, min(id) start_message_id, max(id) end_message_id, count(*) n_messages, string_agg(cast(id as varchar), ',' order by i) message_ids, case when is_open then 'open' else 'closed' end chunk_state from x group by ch, s, is_open",
    "sliding_window_membership": _WINDOWS + " select ch channel_id, min(id) over (partition by ch, s) start_message_id, i - s as at, id message_id from x",
    "author_group_chunks_60s": _AUTHORS + " select ch channel_id, a author_id, first_id start_message_id, last_id end_message_id, n n_messages, ids message_ids, case when is_open then 'open' else 'closed' end chunk_state from g",
    "author_group_events_1h": f"with recursive {_EVENTS}, {_groups('ev', 3600, 40)} select ch channel_id, a author_id, min(id) start_message_id, max(id) end_message_id, count(*) n_messages, case when s = max(s) over (partition by ch, a) then 'open' else 'closed' end chunk_state from f group by ch, a, s",
    "author_sessions_gap_only": f"with {_EVENTS}, d as (select *, case when created_s - lag(created_s) over w <= 3600 then 0 else 1 end new from ev window w as (partition by channel_id, author_id order by message_id)), s as (select *, sum(new) over (partition by channel_id, author_id order by message_id rows unbounded preceding) run from d) select channel_id, author_id, min(message_id) start_message_id, max(message_id) end_message_id, count(*) n_messages from s group by channel_id, author_id, run",
    "reply_chains": _CHAINS + " select leaf leaf_message_id, ch channel_id, ids message_ids, n n_messages, cross_ref cross_channel_ref from chains",
    "reply_chain_depth_hist": _CHAINS + " select n n_messages, count(*) chains from chains group by n",
    "chunk_metadata_sets": _WINDOWS
    + ", y as (select x.*, l.author_id, l.filename, l.created_s from x join log l on l.message_id = x.id), z as (select ch, s, unnest([author_id + 1, author_id - 1]) u from y where id % 4 = 0)"
    + " select ch channel_id, min(id) start_message_id, (select string_agg(cast(a as varchar), ',' order by a) from (select distinct author_id a from y y2 where y2.ch = y.ch and y2.s = y.s)) author_ids,"
    + " coalesce((select string_agg(cast(u as varchar), ',' order by u) from (select distinct u from z where z.ch = y.ch and z.s = y.s)), '') mentioned_user_ids, bool_or(filename is not null) has_attachments, arg_min(created_s, i) first_message_s, arg_max(created_s, i) last_message_s from y group by ch, s",
    "chunk_texts_sequential": _WINDOWS + ", y as (select x.ch, x.s, min(x.id) start_id, string_agg(l.line, chr(10) || chr(10) order by x.i) txt from x join log l on l.message_id = x.id group by x.ch, x.s) select ch channel_id, start_id start_message_id, txt as text, (length(txt)+3)//4 token_count from y",
    "chunk_texts_reply": _CHAINS + ", y as (select leaf, message_id, line, pos from (select leaf, unnest(string_split(ids, ',')) mid, generate_subscripts(string_split(ids, ','), 1) pos from chains) join log on message_id = cast(mid as bigint)) select leaf leaf_message_id, string_agg(case when pos > 1 then '↳ ' else '' end || line, chr(10) || chr(10) order by pos) as text from y group by leaf",
    "chunk_count_by_type": _EVERY + " select chunk_type, count(*) chunks from every group by chunk_type",
    "open_chunks": _EVERY + " select chunk_type, count(*) chunks, max(start_message_id) latest from every where is_open group by chunk_type",
    "chunk_natural_key_dedup": _EVERY + ", n as (select chunk_type, channel_id, start_message_id, count(*) c from every group by all) select chunk_type, max(c) most_of_a_key from n group by chunk_type",
}
QUERIES = {f.__name__: f for f in (sliding_window_chunks, sliding_window_membership, author_group_chunks_60s, author_group_events_1h, author_sessions_gap_only, reply_chains, reply_chain_depth_hist, chunk_metadata_sets, chunk_texts_sequential, chunk_texts_reply, chunk_count_by_type, open_chunks, chunk_natural_key_dedup)}
