"""Sliding windows, author groups and reply chains over a message log.

``messages`` has message_id, channel_id, author_id, type, ref_id, cost, created_s (seconds), content and
whatever a caller wants to join later. Messages of ``SKIPPED_TYPE`` are left out; so is a single message
that costs more than ``HARD_COST``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import segments as S
from .storage import stored

SKIPPED_TYPE, HARD_COST = 21, 32_768
WINDOW = S.Budget(max_cost=500, overlap=0.25, max_overlap=10, hard_cost=HARD_COST)
AUTHOR = S.Budget(max_cost=1000, max_gap_s=60, hard_cost=HARD_COST)


def _spoken(messages: DataFrame) -> DataFrame:
    return messages.where(F.coalesce("type", F.lit(0)) != SKIPPED_TYPE)


def _chunks(messages: DataFrame, keys: list[str], kind: str, budget: S.Budget) -> DataFrame:
    placed = S.greedy_segments(_spoken(messages), keys, ["message_id"], "cost", budget, "created_s")
    found = S.segments(placed, keys)
    rows = S.members(placed, found, keys, ["message_id"])
    by = [*keys, "seg_start", "state"]
    chunks = rows.groupBy(*by).agg(F.min("message_id").alias("start_message_id"), F.max("message_id").alias("end_message_id"), F.count("*").alias("n_messages"), F.array_sort(F.collect_list("message_id")).alias("message_ids"))
    return chunks.select(F.lit(kind).alias("chunk_type"), *keys, "start_message_id", "end_message_id", "n_messages", "message_ids", F.col("state").alias("chunk_state"))


def sliding_windows(messages: DataFrame, budget: S.Budget = WINDOW) -> DataFrame:
    """Windows over each channel; a full window is repeated in part by the next."""
    return _chunks(messages, ["channel_id"], "sliding_window", budget)


def author_groups(messages: DataFrame, budget: S.Budget = AUTHOR) -> DataFrame:
    """Runs of one author in a channel; what others write between does not end a run."""
    return _chunks(messages, ["channel_id", "author_id"], "author_group", budget)


def author_sessions(messages: DataFrame, gap_s: int) -> DataFrame:
    """Runs that only a gap ends, by window functions: a run begins where the gap to the row before is longer."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("channel_id", "author_id").orderBy("message_id")
    new = F.when(F.col("created_s") - F.lag("created_s").over(w) <= gap_s, 0).otherwise(1)
    # Counted by rows: a frame by range would take rows of one id at once.
    runs = _spoken(messages).withColumn("run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy("channel_id", "author_id", "run").agg(F.min("message_id").alias("start_message_id"), F.max("message_id").alias("end_message_id"), F.count("*").alias("n_messages")).drop("run")


def ancestors(messages: DataFrame, most: int) -> DataFrame:
    """message_id, channel_id, path: for messages that answer one of their channel, the ``most`` messages above them at least, if there are.

    Each round joins what is known of the last message on a path to it and so doubles the paths; only paths that are
    still full take part, and no round is made when there are none. Rounds grow with the logarithm of ``most``.
    """
    said = F.coalesce(F.length("content"), F.lit(0)) > 0
    told = stored(messages.select("message_id", "channel_id", F.coalesce("ref_id", F.lit(0)).alias("ref_id"), F.coalesce("type", F.lit(0)).alias("type"), said.alias("said"), "cost"), "replies")
    above = told.select(F.col("message_id").alias("ref_id"), "channel_id", F.array(F.struct("message_id", "ref_id", "type", "said", "cost")).alias("path"))
    found, reach, full = stored(told.where("ref_id <> 0").select("message_id", "channel_id", "ref_id").join(above, ["ref_id", "channel_id"]).drop("ref_id"), "ancestors"), 1, 1
    while reach < most and full:
        more = found.select(F.col("message_id").alias("_last"), F.col("path").alias("_more"))
        going = found.where(F.size("path") == reach).withColumn("_last", F.element_at("path", -1)["message_id"]).join(more, "_last", "left")
        going = going.withColumn("path", F.when(F.col("_more").isNull(), F.col("path")).otherwise(F.concat("path", "_more"))).drop("_last", "_more")
        reach, left = reach * 2, Observation("paths")
        longer = going.unionByName(found.where(F.size("path") < reach // 2))
        found = stored(longer.observe(left, F.count_if(F.size("path") == reach).alias("full")), "ancestors")
        full = left.get["full"]
    return found


def _walks(messages: DataFrame, max_cost: int, max_depth: int, leaves: DataFrame | None) -> DataFrame:
    """leaf, channel_id, walk: from each reply to its ancestors, with the running cost of each step.

    It begins at all replies, or at those of ``leaves(message_id)``; ends at ``max_depth`` messages, once ``max_cost`` is
    reached (that message is kept), at a missing parent, at one of another channel, and where it would come round.
    """
    first = messages.where(f"coalesce(ref_id, 0) <> 0 and coalesce(type, 0) <> {SKIPPED_TYPE}")
    first = first if leaves is None else first.join(leaves.select("message_id"), "message_id", "left_semi")
    said = F.coalesce(F.length("content"), F.lit(0)) > 0
    first = first.select(F.col("message_id").alias("leaf"), "channel_id", F.array(F.struct("message_id", "ref_id", F.coalesce("type", F.lit(0)).alias("type"), said.alias("said"), "cost")).alias("own"))
    above = ancestors(messages, max_depth - 1).select(F.col("message_id").alias("leaf"), "path")
    path = F.slice(F.when(F.col("path").isNull(), F.col("own")).otherwise(F.concat("own", "path")), 1, max_depth)
    met = first.join(above, "leaf", "left").select("leaf", "channel_id", path.alias("walk"))
    upto = lambda i: F.slice("walk", 1, i + 1)
    steps = F.transform("walk", lambda x, i: F.struct(x["message_id"].alias("message_id"), x["ref_id"].alias("ref_id"), x["type"].alias("type"), x["said"].alias("said"), F.aggregate(upto(i), F.lit(0).cast("bigint"), lambda t, y: t + y["cost"]).alias("total"), (F.size(F.array_distinct(F.transform(upto(i), lambda y: y["message_id"]))) == i + 1).alias("new"), x["cost"].alias("cost")))
    walk = F.filter(F.col("walk"), lambda x: x["new"] & ((x["total"] - x["cost"] < max_cost) | (x["total"] == x["cost"])))
    return met.withColumn("walk", steps).withColumn("walk", walk)


def reply_walk(messages: DataFrame, max_cost: int = 5000, max_depth: int = 20, leaves: DataFrame | None = None) -> DataFrame:
    """leaf, channel_id, depth, message_id, ref_id, type, said, total: a row for each step of each walk."""
    rows = _walks(messages, max_cost, max_depth, leaves).select("leaf", "channel_id", F.posexplode("walk").alias("depth", "x"))
    return rows.select("leaf", "channel_id", (F.col("depth") + 1).alias("depth"), "x.message_id", "x.ref_id", "x.type", "x.said", "x.total")


def reply_chains(messages: DataFrame, max_cost: int = 5000, max_depth: int = 20, leaves: DataFrame | None = None) -> DataFrame:
    """leaf_message_id, channel_id, message_ids (root first), n_messages, cross_channel_ref.

    A chain that costs more than HARD_COST is left out, skipped types leave their chains after the limits
    were applied, and a chain without any content is none.
    """
    kept = F.filter("walk", lambda x: x["type"] != SKIPPED_TYPE)
    chains = _walks(messages, max_cost, max_depth, leaves).withColumns({"steps": F.reverse(kept), "end": F.element_at("walk", -1), "depth": F.size("walk")})
    chains = chains.where((F.col("end.total") <= HARD_COST) & F.exists("steps", lambda x: x["said"]))
    home = messages.select(F.col("message_id").alias("p_id"), F.col("channel_id").alias("p_channel"))
    ended = chains.join(home, F.col("end.ref_id") == F.col("p_id"), "left")
    crossed = (F.col("p_channel") != F.col("channel_id")) & (F.col("end.total") < max_cost) & (F.col("depth") < max_depth)
    return ended.select(
        F.col("leaf").alias("leaf_message_id"), "channel_id", F.col("steps.message_id").alias("message_ids"), F.size("steps").cast("bigint").alias("n_messages"), F.when(crossed, F.col("p_id")).alias("cross_channel_ref")
    )


def describe(chunks: DataFrame, messages: DataFrame) -> DataFrame:
    """Chunks with sorted sets of authors and mentions, first and last time by message order, attachments and status."""
    rows = chunks.select("chunk_type", F.col("message_ids").alias("ids"), F.posexplode("message_ids").alias("at", "message_id"))
    facts = rows.join(messages, "message_id").groupBy("chunk_type", "ids").agg(
        F.array_sort(F.collect_set("author_id")).alias("author_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("mentions")))).alias("mentioned_user_ids"),
        F.bool_or("has_attachments").alias("has_attachments"),
        F.min_by("created_s", "at").alias("first_message_s"),
        F.max_by("created_s", "at").alias("last_message_s"),
    )
    return chunks.join(facts.withColumnRenamed("ids", "message_ids"), ["chunk_type", "message_ids"])


def texts(chunks: DataFrame, rendered: DataFrame, key: list[str], reply_chain: bool | Column = False) -> DataFrame:
    """key, text: the rendered messages (message_id, line) of each chunk in order; ``reply_chain``, if it is a column, is one of the key's."""
    from ..functions import rendering as R

    rows = chunks.select(*key, F.posexplode("message_ids").alias("at", "message_id")).join(rendered.select("message_id", "line"), "message_id")
    once = rows.repartition(*key).groupBy(*key, "at").agg(F.min("line").alias("line"))  # a log may hold a message twice
    lines = once.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("lines"))
    if isinstance(reply_chain, Column):
        return lines.select(*key, F.when(reply_chain, R.chunk_text("lines", True)).otherwise(R.chunk_text("lines")).alias("text"))
    return lines.select(*key, R.chunk_text("lines", reply_chain).alias("text"))
