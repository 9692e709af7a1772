"""The jobs over a warehouse: take in pages, chunk, embed, search. Each may run again at any time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .functions import mappers
from .functions import rendering as R
from .operators import chunking, merge, search
from .operators.segments import Budget
from .operators.storage import stored, stored_in_batches
from .streaming import stateful
from .warehouse import ENDED, NEW_CHAINS, STATUS, Warehouse


def persist_messages(wh: Warehouse, payloads: DataFrame, guild_id: int | None = None) -> int:
    """Merge pages of messages (raw) into users, messages, attachments and reactions; how many messages came."""
    told = Observation("payloads")
    payloads = payloads.observe(told, F.count("*").alias("messages"))
    users = mappers.users_of_messages(payloads)
    wh.merge("users", merge.keep_first(users, ["user_id"], ["message_id", "at"]).select("user_id", "username", "global_name", "bot"), ["user_id"])
    # Of a message that comes twice the first stays, as rows come in the order of their pages.
    wh.merge("messages", mappers.messages(payloads.select("raw", F.monotonically_increasing_id().alias("_at")), guild_id, "_at"), ["_at"])
    wh.merge("attachments", mappers.attachments(payloads), ["message_id"])
    wh.merge("reactions", mappers.reactions(payloads), ["message_id"])
    return told.get["messages"]


def ingest(wh: Warehouse, pages, channels: list[int], guild_id: int | None = None) -> dict[int, int]:
    """Bring channels up to date: those not complete are read backwards to their first message, then all forwards.

    ``pages(direction, bounds)`` gives a DataFrame (channel_id, raw), direction "before" or "after"; bounds has
    channel_id and the message id to go on from. A null raw tells that a channel may not be read: it is skipped, and its
    backfill is not complete. Bounds are written after the messages, so what a broken run has read is read
    again and merged.
    """
    spark = wh.spark
    empty = spark.createDataFrame([], "channel_id bigint, oldest bigint, newest bigint, complete boolean")
    counts = dict.fromkeys(channels, 0)
    wanted = spark.createDataFrame([(c,) for c in channels] or [(None,)], "channel_id bigint").where("channel_id is not null")
    for direction, edge in (("before", "oldest"), ("after", "newest")):
        state = wh.read("bounds") if wh.has("bounds") else empty
        rows = wanted.join(state, "channel_id", "left")
        rows = rows.where(~F.coalesce("complete", F.lit(False))) if direction == "before" else rows.where("newest is not null")
        found = stored(pages(direction, rows.select("channel_id", F.col(edge).alias("message_id"))).select("channel_id", "raw"), "landed")
        denied, found = found.where("raw is null").select("channel_id").distinct(), found.where("raw is not null")
        persist_messages(wh, found.select("raw"), guild_id)
        ids = found.select("channel_id", F.get_json_object("raw", "$.id").cast("bigint").alias("message_id"))
        for r in ids.groupBy("channel_id").count().collect():  # a row for each channel
            counts[r["channel_id"]] = counts.get(r["channel_id"], 0) + r["count"]
        after = merge.bounds(state, ids)
        if direction == "before":
            done = rows.select("channel_id").join(denied, "channel_id", "left_anti").withColumn("_done", F.lit(True))
            after = after.join(done, "channel_id", "full_outer").withColumn("complete", F.coalesce("complete", F.lit(False)) | F.coalesce("_done", F.lit(False))).drop("_done")
        after = wanted.join(after, "channel_id", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
        wh.merge("bounds", after, ["newest"])
    return counts


def incomplete_backfills(wh: Warehouse) -> DataFrame:
    return wh.read("bounds").where("not complete")


KINDS: dict[str, tuple[list[str], Budget]] = {"sliding_window": (["channel_id"], chunking.WINDOW), "author_group": (["channel_id", "author_id"], chunking.AUTHOR)}


def _chunk_rows(found: DataFrame, log: DataFrame) -> DataFrame:
    """Rows of the chunk table for chunks (chunk_type, channel_id, message_ids, anchor_id, chunk_state)."""
    owner = log.select("channel_id", "guild_id").dropDuplicates(["channel_id"])
    ids = found.select("chunk_type", "channel_id", "anchor_id", "message_ids", "chunk_state").join(owner, "channel_id")
    told = chunking.describe(ids, log).withColumn("chunk_id", F.xxhash64("chunk_type", "channel_id", "anchor_id")).withColumn("embedding_status", F.lit("pending"))
    return told.withColumn("n_messages", F.size("message_ids").cast("bigint"))


def scoped(df: DataFrame, guild_id: int | None, channel_id: int | None) -> DataFrame:
    """Rows of one guild or channel; the filters reach the scan."""
    for name, value in (("guild_id", guild_id), ("channel_id", channel_id)):
        df = df if value is None else df.where(F.col(name) == int(value))
    return df


def _keep(wh: Warehouse, found: DataFrame, log: DataFrame, told: dict[str, int]) -> None:
    """Merge chunks of all kinds and then their texts, all at once. Until the texts are there, nothing says that the chunks were made."""
    rows = stored(_chunk_rows(found, log), "chunk-rows")
    counted = rows.groupBy("chunk_type").count().collect()  # a row for each kind
    for r in counted:
        told[r["chunk_type"]] += r["count"]
    if not counted and wh.has("chunk_texts"):
        return
    chain = F.col("chunk_type") == "reply_chain"
    wh.merge("chunks", rows.where(~chain), ["n_messages"], None, True)
    wh.merge("chunks", rows.where(chain), ["n_messages"], NEW_CHAINS, True)
    texts = chunking.texts(rows, log, ["chunk_id", "chunk_type"], chain).drop("chunk_type")
    wh.merge("chunk_texts", texts.withColumn("token_count", R.count_tokens("text")), ["token_count"])


def _chains(wh: Warehouse, log: DataFrame, leaves: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Chains whose leaf is newer than its channel's checkpoint, and what writes the checkpoints once they are kept."""
    if wh.has("chunking_checkpoints"):
        known = leaves.join(wh.read("chunking_checkpoints"), "channel_id", "left")
        leaves = known.where("last_message_id is null or message_id > last_message_id").drop("last_message_id")
    leaves = stored(leaves.select("message_id", "channel_id"), "leaves")
    # Of a content a chain only asks whether there is any.
    said = log.select("message_id", "channel_id", "ref_id", "type", F.substring("content", 1, 1).alias("content"), "cost")
    said = stored(said.dropDuplicates(["message_id"]), "replies")
    chains = chunking.reply_chains(said, leaves=leaves).select(F.lit("reply_chain").alias("chunk_type"), "channel_id", F.col("leaf_message_id").alias("anchor_id"), "message_ids", F.lit("closed").alias("chunk_state"))
    newest = leaves.groupBy("channel_id").agg(F.max("message_id").alias("last_message_id"))
    return chains, lambda: wh.merge("chunking_checkpoints", newest, ["last_message_id"])


def chunk(wh: Warehouse, guild_id: int | None = None, channel_id: int | None = None) -> dict[str, int]:
    """Chunk what came to the log since the last run, of one guild or channel if asked; how many chunks were written, by kind.

    Windows and author groups go on from their states. Without a scope a stream over the log's files hands on
    those that are new; with one the log is read for what is newer than the states. Of reply chains those whose leaf is
    new are added. Chunks that changed wait for their embedding again. Chunks of all kinds are written first,
    then their texts, then the states and checkpoints that say so: a run that breaks off is made up for by the next.
    """
    spark, path = wh.spark, f"{wh.root}/log"
    log = spark.read.parquet(path)
    counts = dict.fromkeys([*KINDS, "reply_chain"], 0)
    chained: list[bool] = []

    def take(batch: DataFrame | None, number: int = 0) -> None:
        found, ended, writes = [], [], []
        for kind, (keys, budget) in KINDS.items() if batch is not None else ():
            chunks, write = stateful.ready(wh, f"states_{kind}", stateful.keyed(batch, keys), budget)
            told = chunks.select(F.lit(kind).alias("chunk_type"), F.split("key", "/")[0].cast("bigint").alias("channel_id"), F.col("message_ids")[0].alias("anchor_id"), "message_ids", F.col("state").alias("chunk_state"), "grown")
            found.append(told.where("grown").drop("grown"))
            ended.append(told.where("not grown").drop("grown"))
            writes.append(write)
        if not chained:  # once a run
            chains, write = _chains(wh, log, scoped(log, guild_id, channel_id))
            found.append(chains)
            writes.append(write)
        _keep(wh, reduce(DataFrame.unionByName, found), log, counts)
        over = reduce(DataFrame.unionByName, ended) if ended else None
        if over is not None and not over.isEmpty():  # their members and texts stay, and so does their embedding
            wh.merge("chunks", _chunk_rows(over, log), ["n_messages"], ENDED)
        for write in writes:
            write()
        chained.append(True)

    if guild_id is None and channel_id is None:
        stream = spark.readStream.schema(log.schema).parquet(path)
        stream.writeStream.option("checkpointLocation", f"{wh.root}/_checkpoints/chunks").trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    else:
        take(scoped(log, guild_id, channel_id))
    if not chained:
        take(None)
    return counts


def embed(wh: Warehouse, encoder=None, guild_id: int | None = None, channel_id: int | None = None) -> int:
    """Pending chunks with texts to vectors, in each task rows of like length together; then they are embedded. How many there were.

    Vectors are written before the status: a run that breaks off between is done again with the same outcome.
    """
    encoder = encoder or search.hashing_encoder()
    pending = scoped(wh.read("chunks").where("embedding_status = 'pending'"), guild_id, channel_id)
    rows = pending.join(wh.read("chunk_texts").select("chunk_id", "text", "token_count"), "chunk_id").where(F.col("token_count") <= chunking.HARD_COST)
    vectors = rows.sortWithinPartitions("token_count", "chunk_id").select("chunk_id", "guild_id", "channel_id", "author_ids", F.timestamp_seconds("first_message_s").alias("first_message_at"), F.timestamp_seconds("last_message_s").alias("last_message_at"), encoder("text").alias("vector"))
    done = stored_in_batches(vectors, "embedded")
    wh.merge("vectors", done, ["chunk_id"], None, True)
    wh.merge("chunks", pending.join(done.select("chunk_id"), "chunk_id", "left_semi").withColumn("embedding_status", F.lit("embedded")), ["chunk_id"], STATUS)
    return done.count()


def semantic_search(vectors: DataFrame, query: list[float], limit: int = 20, *, texts: DataFrame | None = None, guild_id=None, channel_id=None, author_id=None, after=None, before=None) -> DataFrame:
    """The nearest chunks that pass the filters, nearest first; with ``texts`` (chunk_id, text) their texts are joined to the hits."""
    hits = search.top_k(vectors, query, limit, guild_ids=None if guild_id is None else [guild_id], channel_id=channel_id, author_id=author_id, after=after, before=before)
    if texts is None:
        return hits
    return texts.select("chunk_id", "text").join(F.broadcast(hits), "chunk_id", "right").orderBy("distance", "chunk_id")  # as many hits as the limit
