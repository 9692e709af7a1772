"""Queries of merges by table, of runs that go on where the last one ended, of search with its filters, and of components."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import runs, warehouse
from ..operators import chunking as C
from ..operators import lookups, projection
from ..operators.storage import fresh_dir
from ..sources import adapters as A
from ..warehouse import Warehouse
from . import chunking
from .vectors import _DISTANCE, _QUERY_ID, _asked

#: Of each table that a batch changes in part: what it may change, and one column that it may not.
_FROZEN = {"guilds": "owner_id", "channels": "type", "roles": "permissions", "emojis": "animated", "stickers": "format_type", "events": "starts_at", "reactions": "emoji_name"}


def _merge_query(name: str, frozen: str):
    """Parts as the table, every third and some new ones as the batch, with a null in a column that may change."""
    rule = warehouse.RULES[name]

    def run(spark, sf_dir):
        parts = A.table(spark, sf_dir, "part")
        keys = [F.col("k").alias(rule.keys[0]), *(F.concat(F.lit("e"), (F.col("k") % 3).cast("string")).alias(k) for k in rule.keys[1:])]
        columns = lambda tag: [F.concat(F.lit(f"{c}-{tag}"), (F.col("k") % 7).cast("string")).alias(c) for c in (*rule.mutable, frozen)]
        table = parts.select(F.col("p_partkey").alias("k")).select(*keys, *columns("old"))
        batch = parts.where("p_partkey % 3 = 0").select((F.col("p_partkey") * 2).alias("k")).select(*keys, *columns("new"))
        batch = batch.withColumn(rule.mutable[-1], F.when(F.col(rule.keys[0]) % 4 != 0, F.col(rule.mutable[-1])))
        return warehouse.merged(name, table, batch, [rule.keys[0]])

    return run


def _merge_sql(name: str, frozen: str) -> str:
    rule = warehouse.RULES[name]
    key = "coalesce(n.k, o.k)"
    text = lambda c, tag, k: f"'{c}-{tag}' || ({k}%7)"
    columns = [f"{key} {rule.keys[0]}", *(f"'e' || ({key}%3) {k}" for k in rule.keys[1:])]
    for c in rule.mutable:
        new = text(c, "new", "n.k") if c != rule.mutable[-1] else f"case when n.k%4 <> 0 then {text(c, 'new', 'n.k')} end"
        columns.append(f"case when n.k is null then {text(c, 'old', 'o.k')} else {new} end as {c}")
    columns.append(f"case when o.k is null then {text(frozen, 'new', 'n.k')} else {text(frozen, 'old', 'o.k')} end as {frozen}")
    return f"with o as (select p_partkey k from part), n as (select p_partkey*2 k from part where p_partkey%3 = 0) select {', '.join(columns)} from o full join n on n.k = o.k"


#: The log comes in two appends: the first messages of every channel, then the others.
_APPENDS = ("message_id % 1000 <= 3", "message_id % 1000 > 3")


def _run_twice(spark, sf_dir) -> tuple[Warehouse, dict[str, int]]:
    """Chunks and embeds after the first append, and chunks again after the second; no append is in order."""
    wh, counts = Warehouse(spark, fresh_dir(spark, "warehouse")), {}
    log = A.messages(spark, sf_dir)
    for k, part in enumerate(_APPENDS):
        log.where(part).repartition(6).sortWithinPartitions(F.xxhash64("message_id")).write.mode("append").parquet(f"{wh.root}/log")
        counts = runs.chunk(wh)
        if not k:
            runs.embed(wh)
    return wh, counts


def _chunks_and_texts(wh: Warehouse):
    chunks = wh.read("chunks").join(wh.read("chunk_texts").select("chunk_id", "text"), "chunk_id", "left")
    ids = F.array_join(F.transform("message_ids", lambda x: x.cast("string")), ",")
    return chunks.select("chunk_type", "channel_id", F.col("anchor_id").alias("start_message_id"), "chunk_state", ids.alias("message_ids"), "text")


def chunks_resumed(spark, sf_dir):
    """Chunks, members and texts of a log that came in two parts, chunked after each: the same as of the whole log."""
    return _chunks_and_texts(_run_twice(spark, sf_dir)[0])


def chunks_of_unordered_log(spark, sf_dir):
    """The same of a log that came at once, some of it twice, in no order."""
    wh = Warehouse(spark, fresh_dir(spark, "warehouse"))
    log = A.messages(spark, sf_dir)
    log.unionByName(log.where("message_id % 5 = 0")).repartition(7).sortWithinPartitions(F.xxhash64("message_id")).write.parquet(f"{wh.root}/log")
    runs.chunk(wh)
    return _chunks_and_texts(wh)


def chunk_one_guild(spark, sf_dir):
    """Only one guild's channels are chunked, then one channel of another."""
    wh = Warehouse(spark, fresh_dir(spark, "warehouse"))
    A.messages(spark, sf_dir).write.parquet(f"{wh.root}/log")
    runs.chunk(wh, guild_id=_CHUNKED_GUILD)
    runs.chunk(wh, channel_id=_CHUNKED_CHANNEL)
    return _chunks_and_texts(wh).drop("text")


def merge_attachments(spark, sf_dir):
    """Attachments that are known keep all they have."""
    parts = A.table(spark, sf_dir, "part")
    table = parts.select(F.col("p_partkey").alias("attachment_id"), F.lit("old").alias("filename"), F.col("p_size").alias("size"))
    batch = parts.where("p_partkey % 3 = 0").select((F.col("p_partkey") * 2).alias("attachment_id"), F.lit("new").alias("filename"), F.lit(None).cast("int").alias("size"))
    return warehouse.merged("attachments", table, batch.withColumn("size", F.col("size").cast(table.schema["size"].dataType)), ["attachment_id"])


def merge_rewrites_one_bucket(spark, sf_dir):
    """Orders merged as a table, then one order that changed: counts by status, and how many buckets the second merge wrote."""
    wh = Warehouse(spark, fresh_dir(spark, "warehouse"), buckets=8)
    rule = warehouse.Rule(("o_orderkey",), ("o_orderstatus",))
    orders = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    wh.merge("orders", orders, ["o_orderkey"], rule)
    one = orders.where(F.col("o_orderkey") == orders.agg(F.min("o_orderkey")).head()[0])
    wh.merge("orders", one.withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"], rule)
    wh.vacuum("orders")
    return wh.read("orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("buckets_written", F.lit(len(wh.rewritten("orders"))))


def embedding_resumed(spark, sf_dir):
    """What waits for its embedding after the second part: new chunks and those that changed; and all is embedded after a further run."""
    wh, _ = _run_twice(spark, sf_dir)
    waiting = wh.read("chunks").groupBy("chunk_type").agg(F.count_if(F.col("embedding_status") == "pending").alias("waiting"))
    runs.embed(wh)
    done = wh.read("chunks").join(wh.read("vectors").select("chunk_id"), "chunk_id").groupBy("chunk_type").agg(F.count_if(F.col("embedding_status") == "embedded").alias("embedded"))
    return waiting.join(done, "chunk_type")


def open_chunks_by_author(spark, sf_dir):
    """Where the open group of each author of a channel begins."""
    found = lookups.chunks_of(C.author_groups(A.messages(spark, sf_dir)), "author_group", state="open")
    return found.select("channel_id", "author_id", "start_message_id")


def chunks_of_a_channel(spark, sf_dir):
    found = lookups.chunks_of(C.sliding_windows(A.messages(spark, sf_dir)), "sliding_window", channel_id=7)
    return found.select("start_message_id", "n_messages", "chunk_state")


def chunking_counters(spark, sf_dir):
    """What one run over the whole log says that it wrote, by kind."""
    wh = Warehouse(spark, fresh_dir(spark, "warehouse"))
    A.messages(spark, sf_dir).write.parquet(f"{wh.root}/log")
    return spark.createDataFrame(list(runs.chunk(wh).items()), "chunk_type string, chunks bigint")


def semantic_search_filters(spark, sf_dir):
    """One guild, one author, a span of time, and the texts of the hits."""
    v = A.vectors(spark, sf_dir)
    hits = runs.semantic_search(v, _asked(v), 10, texts=A.chunk_texts(spark, sf_dir), guild_id=_QUERY_GUILD, author_id=3, after="2024-01-02", before="2024-01-20")
    return hits.select("chunk_id", "distance", "text")


_QUERY_GUILD = 1
_CHUNKED_GUILD, _CHUNKED_CHANNEL = 1, 8


def pca_components(spark, sf_dir):
    """Each component's variance share of all and its mean, where all components are kept: shares add up, means are zero."""
    v = A.vectors(spark, sf_dir)
    width = len(v.select("vector").head()["vector"])
    rows, share = projection.pca(v, width)
    each = rows.select(F.posexplode("projected").alias("at", "x")).groupBy("at").agg(F.var_samp("x").alias("v"), F.abs(F.avg("x")).alias("mean"))
    descending = all(a >= b - 1e-12 for a, b in zip(share, share[1:]))  # noqa: B905
    return each.agg(F.count("*").alias("components"), F.round(F.sum("v"), 6).alias("variance"), F.round(F.max("mean"), 6).alias("largest_mean")).withColumns({"share": F.lit(round(sum(share), 6)), "descending": F.lit(descending)})


def pca_keeps_distances(spark, sf_dir):
    """With all components kept the squared distances to one vector stay what they were."""
    v = A.vectors(spark, sf_dir)
    width = len(v.select("vector").head()["vector"])
    rows, _ = projection.pca(v, width)
    origin = [float(x) for x in rows.where(F.col("chunk_id") == _QUERY_ID).head()["projected"]]
    away = F.aggregate(F.zip_with("projected", F.array(*map(F.lit, origin)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("chunk_id", F.round(away, 5).alias("distance"))


def layout_properties(spark, sf_dir):
    """The layout by components: the farthest point is at the radius, the centroid in the middle, axes are not correlated."""
    points = projection.layout(A.vectors(spark, sf_dir), 16)
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return points.agg(F.count("*").alias("points"), F.round(F.max(r), 4).alias("radius"), *[F.round(F.abs(F.avg(c)), 4).alias(f"mean_{c}") for c in "xyz"], *[F.round(F.abs(F.corr(a, b)), 4).alias(f"corr_{a}{b}") for a, b in ("xy", "xz", "yz")])


_TYPED = chunking._EVERY + ", latest as (select 'sliding_window' chunk_type, ch channel_id, min(id) start_message_id, max(id) last_id from x group by ch, s union all select 'author_group', ch, min(id), max(id) from f2 group by ch, a, s union all select 'reply_chain', ch, leaf, leaf from chains)"

QUERIES = {f.__name__: f for f in (chunks_resumed, chunks_of_unordered_log, chunk_one_guild, merge_attachments, merge_rewrites_one_bucket, embedding_resumed, open_chunks_by_author, chunks_of_a_channel, chunking_counters, semantic_search_filters, pca_components, pca_keeps_distances, layout_properties)} | {f"merge_{n}": _merge_query(n, c) for n, c in _FROZEN.items()}

SQL = {
    "chunks_resumed": chunking._TEXTS,
    "chunks_of_unordered_log": chunking._TEXTS,
    "chunk_one_guild": chunking._EVERY + f" select chunk_type, channel_id, start_message_id, case when is_open then 'open' else 'closed' end chunk_state, message_ids from every where channel_id = {_CHUNKED_CHANNEL} or channel_id in (select channel_id from log where guild_id = {_CHUNKED_GUILD})",
    "merge_attachments": "with o as (select p_partkey k, p_size from part), n as (select p_partkey*2 k from part where p_partkey%3 = 0) select coalesce(o.k, n.k) attachment_id, case when o.k is null then 'new' else 'old' end filename, p_size as size from o full join n on n.k = o.k",
    "merge_rewrites_one_bucket": "select case when o_orderkey = (select min(o_orderkey) from orders) then 'X' else o_orderstatus end o_orderstatus, count(*) orders, round(sum(o_totalprice), 2) total, 1 buckets_written from orders group by 1",
    "embedding_resumed": _TYPED + " select chunk_type, count(*) filter (where last_id%1000 > 3) waiting, count(*) embedded from latest group by chunk_type",
    "open_chunks_by_author": chunking._AUTHORS + " select ch channel_id, a author_id, first_id start_message_id from g where is_open",
    "chunks_of_a_channel": chunking._WINDOWS + " select min(id) start_message_id, count(*) n_messages, case when is_open then 'open' else 'closed' end chunk_state from x where ch = 7 group by s, is_open",
    "chunking_counters": chunking._EVERY + " select chunk_type, count(*) chunks from every group by chunk_type",
    "semantic_search_filters": f"with q as (select embedding qv from embeddings where vec_id = {_QUERY_ID}), d as (select vec_id chunk_id, {_DISTANCE} distance from embeddings, q where label = {_QUERY_GUILD} and (vec_id%7 = 3 or vec_id%11 = 3) and 1704067200 + vec_id*3600 >= epoch(timestamp '2024-01-02') and 1704067200 + vec_id*3600 + 1800 <= epoch(timestamp '2024-01-20')) select d.chunk_id, distance, text from (select * from d order by distance, chunk_id limit 10) d left join documents on doc_id = chunk_id",
    "pca_components": "with u as (select unnest(embedding) x, generate_subscripts(embedding, 1) pos from embeddings), v as (select var_samp(cast(x as double)) v from u group by pos) select count(*) components, round(sum(v), 6) variance, cast(0 as double) largest_mean, cast(1 as double) as share, true descending from v",
    "pca_keeps_distances": f"with q as (select embedding qv from embeddings where vec_id = {_QUERY_ID}) select vec_id chunk_id, round({_DISTANCE.removeprefix('round(').removesuffix(', 6)')}, 5) distance from embeddings, q",
    "layout_properties": "select count(*) points, cast(100 as double) radius, cast(0 as double) mean_x, cast(0 as double) mean_y, cast(0 as double) mean_z, cast(0 as double) corr_xy, cast(0 as double) corr_xz, cast(0 as double) corr_yz from embeddings",
} | {f"merge_{n}": _merge_sql(n, c) for n, c in _FROZEN.items()}
