"""Queries of vector search, packing, lookups, layouts, passthrough SQL and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import layout, lists, lookups, neighbours, projection, ranges, search, sqlguard
from ..operators import segments as S
from ..operators.storage import fresh_dir, stored, stored_in_batches
from ..sources import adapters as A
from ..sources import glxy
from . import chunking

_QUERY_ID = 0


def _asked(vectors) -> list[float]:
    """The vector that is searched for: that of one row."""
    return [float(x) for x in vectors.where(F.col("chunk_id") == _QUERY_ID).head()["vector"]]


def vector_topk(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    return search.top_k(v, _asked(v), 20).select("chunk_id", "distance")


def vector_topk_filtered(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    return search.top_k(v, _asked(v), 20, guild_ids=[1, 2, 3]).select("chunk_id", "guild_id", "distance")


def vector_topk_author(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    return search.top_k(v, _asked(v), 20, author_id=3).select("chunk_id", "distance")


def vector_topk_time(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    hits = search.top_k(v, _asked(v), 20, channel_id=4, after="2024-01-03 00:00:00", before="2024-01-15 00:00:00")
    return hits.select("chunk_id", "distance")


def galaxy_search_fanout(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    return search.fan_out(v, _asked(v), [1, 2, 3, 4, 5, 6], 50).select("chunk_id", "guild_id", "distance")


def search_with_text(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    hits = search.top_k(v, _asked(v), 20)
    found = search.with_text(hits, A.chunk_texts(spark, sf_dir).select("chunk_id", "text"), A.channels(spark, sf_dir).select("channel_id", "name"))
    return found.select("chunk_id", "distance", "channel_name", "preview")


def knn_graph(spark, sf_dir):
    return search.knn_graph(A.vectors(spark, sf_dir), 5).groupBy("chunk_id").agg(F.count("*").alias("neighbors"), F.round(F.sum("distance"), 6).alias("total_distance"))


def knn_graph_descent(spark, sf_dir):
    """Neighbours by trees and descent: how many each row has, and whether at least nine in ten of the nearest of the asked rows are there."""
    v = A.vectors(spark, sf_dir)
    edges = neighbours.graph(v, 5)
    good = neighbours.recall(v, edges, 5) >= 0.9
    return edges.groupBy("chunk_id").agg(F.count("*").alias("neighbors")).withColumn("recall_reached", F.lit(good))


def _index(spark, sf_dir):
    v = A.vectors(spark, sf_dir).select("chunk_id", "guild_id", "vector")
    return lists.Index.build(v, fresh_dir(spark, "index")), _asked(v)


def vector_index_topk(spark, sf_dir):
    """The nearest rows by inverted lists, of which those that cannot matter are not read."""
    index, query = _index(spark, sf_dir)
    return index.top_k(query, 20)[0].select("chunk_id", "distance")


def vector_index_topk_filtered(spark, sf_dir):
    index, query = _index(spark, sf_dir)
    return index.top_k(query, 20, guild_ids=[1, 2, 3])[0].select("chunk_id", "guild_id", "distance")


def l2_normalize_check(spark, sf_dir):
    v = A.vectors(spark, sf_dir).select("chunk_id", F.transform(F.col("vector").cast("array<double>"), lambda x: x * 3.5).alias("vector"))
    unit = v.select("chunk_id", search.normalized("vector").alias("u"))
    return unit.select("chunk_id", F.round(F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"))


def encoded_documents(spark, sf_dir):
    """Documents through the stand-in encoder: the norms of their vectors."""
    t = A.chunk_texts(spark, sf_dir).select("chunk_id", search.hashing_encoder()("text").alias("v"))
    return stored_in_batches(t.select("chunk_id", F.round(F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)), 4).alias("norm")), "encoded")


def embedding_batches_packed(spark, sf_dir):
    """Documents packed for inference in pages of 5000: at most 32 rows, rows times longest at most 8000 tokens."""
    packed = S.packed_batches(A.chunk_texts(spark, sf_dir), "token_count", "chunk_id", S.Budget(max_cost=8000, max_rows=32, mode="max"))
    return packed.groupBy("page", "batch").agg(F.count("*").alias("n"), F.max("token_count").alias("max_tokens"), F.min("chunk_id").alias("min_chunk"))


def embedding_batches_paged(spark, sf_dir):
    """The same, packing anew at every page of 300 rows."""
    packed = S.packed_batches(A.chunk_texts(spark, sf_dir), "token_count", "chunk_id", S.Budget(max_cost=8000, max_rows=32, mode="max"), page_rows=300)
    return packed.groupBy("page", "batch").agg(F.count("*").alias("n"), F.max("token_count").alias("max_tokens"), F.min("chunk_id").alias("min_chunk"))


def chunk_detail(spark, sf_dir):
    t = A.chunk_texts(spark, sf_dir)
    chunks = t.select("chunk_id", (F.col("chunk_id") % 25).alias("channel_id"))
    found = lookups.chunk_detail(chunks, t.select("chunk_id", "text"), A.channels(spark, sf_dir).select("channel_id", "name"), 42)
    return found.select("chunk_id", "channel_id", "channel_name", "text")


def chunks_by_ids(spark, sf_dir):
    """Chunks in the order asked for; asked ids that do not exist are absent."""
    ids = spark.createDataFrame([(i, p) for p, i in enumerate((7, 3, 10**9, 5))], "chunk_id bigint, pos bigint")
    return lookups.by_ids(A.chunk_texts(spark, sf_dir).select("chunk_id", "token_count"), "chunk_id", ids)


def guilds_with_projection(spark, sf_dir):
    return lookups.guilds_with_projection(A.guilds(spark, sf_dir), A.vectors(spark, sf_dir).where("guild_id <> 2"))


def channels_listing(spark, sf_dir):
    return lookups.channels_of(A.channels(spark, sf_dir), 1)


def channels_with_messages(spark, sf_dir):
    log = A.messages(spark, sf_dir).where("type = 21")
    return lookups.channels_with_messages(A.channels(spark, sf_dir), log).select("channel_id", "name")


def message_counts(spark, sf_dir):
    return A.messages(spark, sf_dir).groupBy("channel_id").agg(F.count("*").alias("messages"))


def vector_mean(spark, sf_dir):
    m = projection.mean_vector(A.vectors(spark, sf_dir))
    return m.select(F.col("at").cast("bigint").alias("at"), F.round("mean", 6).alias("mean"))


def vector_total_variance(spark, sf_dir):
    return projection.total_variance(A.vectors(spark, sf_dir)).select(F.round("variance", 6).alias("variance"))


def pca_project(spark, sf_dir):
    rows, share = projection.pca(A.vectors(spark, sf_dir), 3)
    return rows.select("chunk_id", *[F.round(F.col("projected")[i], 4).alias(c) for i, c in enumerate("xyz")], F.lit(round(sum(share), 4)).alias("explained"))


def _points(spark, sf_dir):
    """The first three components as a layout."""
    v = A.vectors(spark, sf_dir)
    return projection.normalized_layout(v.select("chunk_id", "guild_id", "channel_id", *[F.col("vector")[i].cast("double").alias(c) for i, c in enumerate("xyz")]))


def layout_normalized(spark, sf_dir):
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return _points(spark, sf_dir).agg(F.round(F.max(r), 6).alias("radius"), *[F.round(F.abs(F.avg(c)), 6).alias(f"mean_{c}") for c in "xyz"])


def layout_by_pca(spark, sf_dir):
    return projection.layout(A.vectors(spark, sf_dir), 16).select("chunk_id", *[F.round(c, 3).alias(c) for c in "xyz"])


def layout_keeps_neighbours(spark, sf_dir):
    """The layout of all vectors: how many points, and whether it keeps neighbours better than three components, by the rows whose id 5 divides with all rows; equal vectors count once."""
    v = A.vectors(spark, sf_dir)
    width = v.where(search.sound()).agg(F.max(F.size("vector"))).head()[0] or 0
    rows = v.where(search.sound(width))
    near, flat = (x.select("chunk_id", F.array("x", "y", "z").alias(c)) for x, c in ((layout.layout(rows), "near"), (projection.layout(rows), "flat")))
    once = layout.different(rows.select("chunk_id", "vector")).where("chunk_id = first")
    both = stored(once.join(near, "chunk_id").join(flat, "chunk_id").select("chunk_id", "vector", "near", "flat"), "layouts")
    own, plain = layout.kept(both, ["near", "flat"], 5)
    return v.agg(F.count("*").alias("points")).withColumn("keeps_more", F.lit(own > plain))


def bounding_box(spark, sf_dir):
    return projection.bounding_box(_points(spark, sf_dir)).select(*[F.round(f"{m}_{c}", 6).alias(f"{m}_{c}") for c in "xyz" for m in ("min", "max")])


def glxy_roundtrip(spark, sf_dir):
    """Points of a layout, packed for each guild and read back."""
    back = glxy.decode(glxy.encode(_points(spark, sf_dir)))
    return back.groupBy("guild_id").agg(F.count("*").alias("points"), F.sum("chunk_id").alias("chunk_ids"), F.sum("channel_id").alias("channel_ids"), F.round(F.sum(F.col("x").cast("double")), 2).alias("sum_x"))


def glxy_files(spark, sf_dir):
    """Points of a layout, written as a file for each guild by many tasks and read back in ranges, with the files' sizes."""
    folder = fresh_dir(spark, "clouds")
    glxy.write_files(_points(spark, sf_dir), folder)
    sizes = spark.read.format("binaryFile").load(f"{folder}/*.bin").select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("bigint").alias("guild_id"), F.col("length").alias("bytes"))
    back = glxy.read_files(spark, folder).groupBy("guild_id").agg(F.count("*").alias("points"), F.min("chunk_id").alias("first_chunk"), F.sum("chunk_id").alias("chunk_ids"), F.sum("channel_id").alias("channel_ids"), F.round(F.sum(F.col("z").cast("double")), 2).alias("sum_z"))
    return back.join(sizes, "guild_id")


def _registered(spark, sf_dir) -> None:
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"):
        A.table(spark, sf_dir, name).createOrReplaceTempView(name)


def _passthrough(sql: str, limit: bool = False):
    def run(spark, sf_dir):
        _registered(spark, sf_dir)
        return sqlguard.query(spark, sql) if limit else spark.sql(sql)

    return run


# Statements that both engines read alike, one for each kind of SQL that a caller may send.
PASSTHROUGH = {
    "sql_join_agg": "select n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name",
    "sql_window_rank": "select o_custkey, o_orderkey, place from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) t where place <= 3",
    "sql_set_ops": "select c_nationkey as k from customer union select s_nationkey from supplier except select n_nationkey from nation where n_nationkey < 5",
    "sql_rollup": "select l_returnflag, l_linestatus, count(*) as lines, round(sum(l_quantity), 2) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)",
    "sql_cube_having": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority) having count(*) > 100",
    "sql_semi_anti": "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000) and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')",
    "sql_asof": "select u.user_id, u.event_id, max(p.event_id) as last_purchase from events u left join events p on p.user_id = u.user_id and p.event_type = 'purchase' and p.event_id <= u.event_id where u.event_type = 'click' group by u.user_id, u.event_id",
    "sql_range_join": "select s_suppkey, count(*) as near from supplier join customer on c_nationkey = s_nationkey and c_acctbal between s_acctbal - 500 and s_acctbal + 500 group by s_suppkey",
    "sql_recursive": "with recursive t(n) as (select 1 union all select n + 1 from t where n < 20) select n from t",
}


def sql_range_join(spark, sf_dir):
    """The statement's counts without its pairs, which grow with the product of both tables."""
    supplier, customer = A.table(spark, sf_dir, "supplier"), A.table(spark, sf_dir, "customer")
    asked = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("part"), (F.col("s_acctbal") - 500).alias("low"), (F.col("s_acctbal") + 500).alias("high"))
    near = ranges.counted(asked, customer.select(F.col("c_nationkey").alias("part"), F.col("c_acctbal").alias("value")))
    return near.select(F.col("id").alias("s_suppkey"), "near")


def sql_auto_limit(spark, sf_dir):
    """A statement without a limit gets 500 rows."""
    _registered(spark, sf_dir)
    return sqlguard.query(spark, "select o_orderkey from orders order by o_orderkey;").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


def _streamed(spark, sf_dir, keys, budget, **how):
    from ..streaming import stateful

    root = fresh_dir(spark, "stream")
    log = A.messages(spark, sf_dir).select("message_id", "channel_id", "author_id", "type", "cost", "created_s")
    # Three appends by ranges of the id, as a log grows; the stream reads the oldest files first.
    lo, hi = log.approxQuantile("message_id", [1 / 3, 2 / 3], 0.01)
    for part in (F.col("message_id") <= lo, (F.col("message_id") > lo) & (F.col("message_id") <= hi), F.col("message_id") > hi):
        # Rows of a key are in all files of an append, in the order of a hash.
        log.where(part).repartition(8).sortWithinPartitions(F.xxhash64("message_id")).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 8).parquet(f"{root}/in")
    return stateful.run_available(spark, stream, keys, budget, root, **how)


_ENDS = "message_ids[0] as start_message_id", "element_at(message_ids, -1) as end_message_id"


def stream_equals_batch_sliding(spark, sf_dir):
    """Windows from a stream of micro-batches."""
    got = _streamed(spark, sf_dir, ["channel_id"], C.WINDOW)
    return got.select(F.col("key").cast("bigint").alias("channel_id"), *map(F.expr, _ENDS), (F.col("seg_end") - F.col("seg_start") + 1).alias("n_messages"))


def stream_in_pieces(spark, sf_dir):
    """The same where a channel's rows of a micro-batch are folded in pieces of a few rows, all at once."""
    got = _streamed(spark, sf_dir, ["channel_id"], C.WINDOW, piece_rows=2)
    return got.select(F.col("key").cast("bigint").alias("channel_id"), *map(F.expr, _ENDS), F.col("state").alias("chunk_state"))


def stream_equals_batch_sessions(spark, sf_dir):
    """Author groups from a stream of micro-batches."""
    got = _streamed(spark, sf_dir, ["channel_id", "author_id"], C.AUTHOR)
    key = F.split("key", "/")
    return got.select(key[0].cast("bigint").alias("channel_id"), key[1].cast("bigint").alias("author_id"), *map(F.expr, _ENDS), (F.col("seg_end") - F.col("seg_start") + 1).alias("n_messages"))


_DISTANCE = "round(list_sum(list_transform(list_zip(embedding, qv), lambda z: (cast(z[1] as double) - cast(z[2] as double)) * (cast(z[1] as double) - cast(z[2] as double)))), 6)"
_Q = f"q as (select embedding qv from embeddings where vec_id = {_QUERY_ID}), d as (select vec_id chunk_id, label, vec_id%20 ch, vec_id%7 a1, vec_id%11 a2, 1704067200 + vec_id*3600 t, {_DISTANCE} distance from embeddings, q)"
_PAGES = "r as (select doc_id, (length(text)+3)//4 tok, row_number() over (order by (length(text)+3)//4, doc_id) - 1 g from documents)"
_LAYOUT = "p as (select vec_id, cast(label as bigint) guild, vec_id%20 ch, cast(embedding[1] as double) x, cast(embedding[2] as double) y, cast(embedding[3] as double) z from embeddings), c as (select avg(x) cx, avg(y) cy, avg(z) cz from p), m as (select vec_id, guild, ch, x - cx x, y - cy y, z - cz z from p, c), s as (select 100 / max(sqrt(x*x + y*y + z*z)) k from m), l as (select vec_id, guild, ch, x*k x, y*k y, z*k z from m, s)"

SQL = {
    "vector_topk": f"with {_Q} select chunk_id, distance from d order by distance, chunk_id limit 20",
    "vector_topk_filtered": f"with {_Q} select chunk_id, cast(label as bigint) guild_id, distance from d where label in (1, 2, 3) order by distance, chunk_id limit 20",
    "vector_index_topk": f"with {_Q} select chunk_id, distance from d order by distance, chunk_id limit 20",
    "vector_index_topk_filtered": f"with {_Q} select chunk_id, cast(label as bigint) guild_id, distance from d where label in (1, 2, 3) order by distance, chunk_id limit 20",
    "knn_graph_descent": "select vec_id chunk_id, 5 neighbors, true recall_reached from embeddings",
    "vector_topk_author": f"with {_Q} select chunk_id, distance from d where a1 = 3 or a2 = 3 order by distance, chunk_id limit 20",
    "vector_topk_time": f"with {_Q} select chunk_id, distance from d where ch = 4 and t >= epoch(timestamp '2024-01-03') and t + 1800 <= epoch(timestamp '2024-01-15') order by distance, chunk_id limit 20",
    "galaxy_search_fanout": f"with {_Q}, r as (select *, row_number() over (partition by label order by distance, chunk_id) k from d where label between 1 and 6) select chunk_id, cast(label as bigint) guild_id, distance from r where k <= 10 order by distance, chunk_id limit 50",
    "search_with_text": f"with {_Q}, h as (select * from d order by distance, chunk_id limit 20) select h.chunk_id, h.distance, n_name channel_name, coalesce(substring(text, 1, 150), '') preview from h left join documents on doc_id = h.chunk_id left join nation on n_nationkey = h.ch",
    "knn_graph": "with p as (select a.vec_id i, b.vec_id j, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (cast(z[1] as double) - cast(z[2] as double)) * (cast(z[1] as double) - cast(z[2] as double)))) d from embeddings a join embeddings b on a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by i order by round(d, 6), j) k from p) select i chunk_id, count(*) neighbors, round(sum(round(d, 6)), 6) total_distance from r where k <= 5 group by i",
    "l2_normalize_check": "with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double) * 3.5) v from embeddings), n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) n from v) select vec_id chunk_id, cast(1 as double) norm, round(v[1] / n, 6) as first from n",
    "embedding_batches_packed": f"with recursive {_PAGES}, n as (select *, g//5000 page, g%5000 + 1 i from r), f as (select page, i, doc_id, tok, cast(1 as bigint) s from n where i = 1 union all select n.page, n.i, n.doc_id, n.tok, case when (n.i - f.s + 1) * n.tok > 8000 or n.i - f.s + 1 > 32 then n.i else f.s end from f join n on n.page = f.page and n.i = f.i + 1) select page, s batch, count(*) n, max(tok) max_tokens, min(doc_id) min_chunk from f group by page, s",
    "embedding_batches_paged": f"with recursive {_PAGES}, n as (select *, g//300 page, g%300 + 1 i from r), f as (select page, i, doc_id, tok, cast(1 as bigint) s from n where i = 1 union all select n.page, n.i, n.doc_id, n.tok, case when (n.i - f.s + 1) * n.tok > 8000 or n.i - f.s + 1 > 32 then n.i else f.s end from f join n on n.page = f.page and n.i = f.i + 1) select page, s batch, count(*) n, max(tok) max_tokens, min(doc_id) min_chunk from f group by page, s",
    "chunk_detail": "select doc_id chunk_id, doc_id%25 channel_id, n_name channel_name, text from documents left join nation on n_nationkey = doc_id%25 where doc_id = 42",
    "chunks_by_ids": "select i.chunk_id, (length(text)+3)//4 token_count, i.pos from (values (7, 0), (3, 1), (1000000000, 2), (5, 3)) i(chunk_id, pos) join documents on doc_id = i.chunk_id",
    "guilds_with_projection": "select cast(r_regionkey as varchar) guild_id, r_name as name from region where r_regionkey in (select label from embeddings where label <> 2)",
    "channels_listing": "select cast(n_nationkey as varchar) channel_id, n_name as name, [0,2,4,5,10,11,13,15,99][n_nationkey%9+1] as type, case when n_nationkey%5 <> 0 then n_nationkey%3 end as position, case when n_nationkey%4 = 0 then cast(n_nationkey + 3 as varchar) end parent_id from nation where n_regionkey = 1",
    "channels_with_messages": f"with {chunking.LOG} select cast(n_nationkey as bigint) channel_id, n_name as name from nation where n_nationkey in (select channel_id from log where type = 21)",
    "message_counts": "select conv_id channel_id, count(*) messages from conversations group by conv_id",
    "vector_mean": "with u as (select unnest(embedding) x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) select cast(pos as bigint) as at, round(avg(cast(x as double)), 6) mean from u group by pos",
    "vector_total_variance": "with u as (select unnest(embedding) x, generate_subscripts(embedding, 1) pos from embeddings), v as (select var_samp(cast(x as double)) v from u group by pos) select round(sum(v), 6) variance from v",
    "layout_normalized": f"with {_LAYOUT} select round(max(sqrt(x*x + y*y + z*z)), 6) radius, round(abs(avg(x)), 6) mean_x, round(abs(avg(y)), 6) mean_y, round(abs(avg(z)), 6) mean_z from l",
    "layout_keeps_neighbours": "select count(*) points, true keeps_more from embeddings",
    "bounding_box": f"with {_LAYOUT} select round(min(x), 6) min_x, round(max(x), 6) max_x, round(min(y), 6) min_y, round(max(y), 6) max_y, round(min(z), 6) min_z, round(max(z), 6) max_z from l",
    "glxy_files": f"with {_LAYOUT} select guild guild_id, count(*) points, min(vec_id) first_chunk, cast(sum(vec_id) as bigint) chunk_ids, cast(sum(ch) as bigint) channel_ids, round(sum(cast(cast(z as float) as double)), 2) sum_z, 16 + 28 * count(*) bytes from l group by guild",
    "glxy_roundtrip": f"with {_LAYOUT} select guild guild_id, count(*) points, cast(sum(vec_id) as bigint) chunk_ids, cast(sum(ch) as bigint) channel_ids, round(sum(cast(cast(x as float) as double)), 2) sum_x from l group by guild",
    "sql_auto_limit": "with t as (select o_orderkey from orders order by o_orderkey limit 500) select count(*) n, max(o_orderkey) as last from t",
    "stream_equals_batch_sliding": chunking._WINDOWS + " select ch channel_id, min(id) start_message_id, max(id) end_message_id, count(*) n_messages from x group by ch, s",
    "stream_in_pieces": chunking._WINDOWS + " select ch channel_id, min(id) start_message_id, max(id) end_message_id, case when is_open then 'open' else 'closed' end chunk_state from x group by ch, s, is_open",
    "stream_equals_batch_sessions": chunking._AUTHORS + " select ch channel_id, a author_id, first_id start_message_id, last_id end_message_id, n n_messages from g",
} | PASSTHROUGH

QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_topk_filtered, vector_topk_author, vector_topk_time, galaxy_search_fanout, search_with_text, knn_graph, knn_graph_descent, vector_index_topk, vector_index_topk_filtered, l2_normalize_check, encoded_documents, embedding_batches_packed, embedding_batches_paged,
        chunk_detail, chunks_by_ids, guilds_with_projection, channels_listing, channels_with_messages, message_counts, vector_mean, vector_total_variance, pca_project, layout_normalized, layout_by_pca, layout_keeps_neighbours, bounding_box,
        glxy_roundtrip, glxy_files, sql_auto_limit, stream_equals_batch_sliding, stream_in_pieces, stream_equals_batch_sessions,
    )
} | {name: _passthrough(sql) for name, sql in PASSTHROUGH.items()} | {"sql_range_join": sql_range_join}
