"""The chunkers over a stream: every micro-batch goes on from the state of each key and tells the chunks it changed.

A micro-batch is folded by :func:`logweave.operators.segments.folded`: Spark deals its rows by key and sorts them, so
they may come in any order, in any number of files and Arrow batches, and a key with very many rows is
folded in pieces. The state of a key is the fold's, a few numbers, with the ids of its open segment, which the budget bounds,
and the newest id it has seen. A row that is not newer than that *before* its micro-batch is late and left out, as the
batch readers never look behind their checkpoint; so a micro-batch that runs again after its state was written
changes nothing, and one that runs again before that does the same again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..operators import segments as S
from ..operators.chunking import SKIPPED_TYPE
from ..operators.storage import stored, stored_in_batches
from ..warehouse import STATES, Warehouse

STATE_ROWS = f"key string, state {S.STATE}, ids array<bigint>, newest bigint"


def keyed(messages: DataFrame, keys: list[str]) -> DataFrame:
    """key, message_id, cost, created_s of the messages that are chunked."""
    told = messages.where(F.coalesce("type", F.lit(0)) != SKIPPED_TYPE)
    return told.select(F.concat_ws("/", *keys).alias("key"), "message_id", F.col("cost").cast("bigint").alias("cost"), F.col("created_s").cast("double").alias("created_s"))


def advance(rows: DataFrame, budget: S.Budget, before: DataFrame, piece_rows: int = S.PIECE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The chunks that new rows change (key, seg_start, seg_end, state, grown, message_ids), and the states of their keys afterwards.

    ``grown`` tells chunks that new rows are in from those that only ended.
    """
    new = rows.join(before.select("key", "newest"), "key", "left").where("newest is null or message_id > newest").drop("newest")
    new = merge.keep_first(new, ["key", "message_id"], ["created_s", "cost"])
    found = stored_in_batches(S.folded(new, ["key"], ["message_id"], "cost", budget, "created_s", before.select("key", "state"), piece_rows), "folded")
    after = stored(S.states_after(found, ["key"]), "states")
    # The rows of the segments that were open are told again, so that a segment is seen whole, and closed where it ends.
    start = F.col("state.start")
    prior = before.join(after.select("key"), "key", "left_semi").select("key", start.alias("seg_start"), F.posexplode("ids").alias("_at", "message_id"))
    prior = prior.select("key", "message_id", (F.col("seg_start") + F.col("_at")).alias("pos"), "seg_start", F.lit(False).alias("_new"))
    placed = found.where("state is null").select("key", "message_id", "pos", "seg_start", F.lit(True).alias("_new"))
    placed = stored(placed.unionByName(prior), "placed")
    members = S.members(placed, S.segments(placed, ["key"]), ["key"], ["message_id", "_new"])
    ids = F.array_sort(F.collect_list("message_id")).alias("message_ids")
    chunks = members.groupBy("key", "seg_start", "seg_end", "state").agg(F.bool_or("_new").alias("grown"), ids)
    held = placed.join(after, "key").where((start > 0) & (F.col("pos") >= start)).groupBy("key").agg(ids)
    newest = new.groupBy("key").agg(F.max("message_id").alias("newest"))
    states = after.join(newest, "key", "left").join(held, "key", "left")
    none = F.array().cast("array<bigint>")
    return chunks, states.select("key", "state", F.coalesce("message_ids", none).alias("ids"), "newest")


def ready(wh: Warehouse, table: str, rows: DataFrame, budget: S.Budget, piece_rows: int = S.PIECE_ROWS) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The chunks that new rows change from the states in ``table``, and what writes the states once the chunks are kept."""
    before = wh.read(table) if wh.has(table) else wh.spark.createDataFrame([], STATE_ROWS)
    chunks, states = advance(rows, budget, before, piece_rows)
    return stored(chunks, "chunks"), lambda: wh.merge(table, states, ["newest"], STATES)


def step(wh: Warehouse, table: str, rows: DataFrame, budget: S.Budget, keep: Callable[[DataFrame], None], piece_rows: int = S.PIECE_ROWS) -> None:
    """Advance the states in ``table`` by new rows; ``keep`` writes the chunks that changed, and only then are the states written."""
    chunks, write = ready(wh, table, rows, budget, piece_rows)
    keep(chunks)
    write()


def run_available(spark: SparkSession, messages: DataFrame, keys: list[str], budget: S.Budget, path: str, piece_rows: int = S.PIECE_ROWS) -> DataFrame:
    """Process all that is available in micro-batches; key, seg_start, seg_end, state, message_ids of all chunks so far."""
    wh = Warehouse(spark, f"{path}/tables")

    def take(batch: DataFrame, number: int) -> None:
        step(wh, "states", keyed(batch, keys), budget, lambda chunks: wh.merge("windows", chunks.drop("grown"), ["seg_end"]), piece_rows)

    messages.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    return wh.read("windows")
