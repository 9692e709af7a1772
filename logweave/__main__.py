"""python -m logweave ingest|load|chunk|embed|project|search|vacuum: thin commands over the library's jobs.

Tables are buckets of Parquet in one warehouse; the log of messages is a folder that grows.
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from . import ingest, runs, session
from .functions import rendering as R
from .operators import layout, search
from .sources import glxy
from .sources.settings import Settings
from .warehouse import Warehouse


def load(wh: Warehouse, pages: str, guild: int | None = None) -> int:
    """Saved pages of messages, a JSON object a line, into the tables, and what is new of them into the log."""
    raw = wh.spark.read.text(pages).select(F.col("value").alias("raw"))
    n = runs.persist_messages(wh, raw, guild)
    ids = raw.select(F.get_json_object("raw", "$.id").cast("bigint").alias("message_id")).distinct()
    told = rendered(wh).join(ids, "message_id", "left_semi")
    if wh.holds("log"):  # one row a message
        told = told.join(wh.spark.read.parquet(f"{wh.root}/log").select("message_id"), "message_id", "left_anti")
    if wh.has("chunking_checkpoints"):  # the log only goes on, as its readers never look behind their checkpoint
        told = told.join(wh.read("chunking_checkpoints"), "channel_id", "left").where("last_message_id is null or message_id > last_message_id").drop("last_message_id")
    told.write.mode("append").parquet(f"{wh.root}/log")
    return n


def rendered(wh: Warehouse):
    """Messages with what the chunkers read."""
    files = wh.read("attachments").groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("attachment_id", "filename"))), lambda x: x["filename"]).alias("filenames"))
    names = wh.read("users").select(F.col("user_id").alias("author_id"), "username")
    told = wh.read("messages").join(files, "message_id", "left").join(names, "author_id", "left").withColumn("line", R.message_text("username", "author_id", "created_at", "content", "filenames", "embeds"))
    told = told.withColumns({"cost": R.message_cost("line"), "created_s": F.unix_micros("created_at") / 1e6, "ref_id": F.col("referenced_message_id"), "has_attachments": F.col("filenames").isNotNull()})
    return told.select("message_id", "channel_id", "guild_id", "author_id", "type", "ref_id", "content", "created_s", "mentions", "has_attachments", "line", "cost")


def project(wh: Warehouse, guild_id: int | None = None, channel_id: int | None = None, files: str | None = None) -> None:
    """The layout of all vectors, or those of one guild or channel, as a table of point clouds and, in a mounted folder, as their files."""
    glxy.write(layout.layout(runs.scoped(wh.read("vectors"), guild_id, channel_id)), f"{wh.root}/projections")
    if files:
        glxy.write_files(glxy.read(wh.spark, f"{wh.root}/projections"), files)


def main() -> None:
    p = argparse.ArgumentParser(prog="logweave")
    p.add_argument("command", choices=("ingest", "load", "chunk", "embed", "project", "search", "vacuum"))
    p.add_argument("--warehouse", default="warehouse")
    p.add_argument("--pages", default="pages")
    p.add_argument("--config", default="config.toml")
    for name in ("guild-id", "channel-id", "author-id"):
        p.add_argument(f"--{name}", type=int)
    for name in ("after", "before", "query", "instruction"):
        p.add_argument(f"--{name}")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--files", help="project: a folder for <guild>.bin")
    p.add_argument("--include-text", action="store_true")
    a = p.parse_args()
    spark = session.create()
    wh = Warehouse(spark, a.warehouse)
    if a.command == "ingest":
        settings = Settings.from_file(a.config)
        print(ingest.run(wh, [ingest.Account.of(x) for x in settings.accounts], a.guild_id, a.channel_id))
    elif a.command == "load":
        print(load(wh, a.pages, a.guild_id))
    elif a.command == "chunk":
        print(runs.chunk(wh, a.guild_id, a.channel_id))
    elif a.command == "embed":
        print(runs.embed(wh, guild_id=a.guild_id, channel_id=a.channel_id))
    elif a.command == "vacuum":
        print({name: wh.vacuum(name) for name in wh.tables()})
    elif a.command == "project":
        project(wh, a.guild_id, a.channel_id, a.files)
    else:
        asked = spark.createDataFrame([(a.query or "",)], "text string").select(search.hashing_encoder(instruction=a.instruction or "")("text").alias("v")).head()["v"]
        texts = wh.read("chunk_texts") if a.include_text else None
        runs.semantic_search(wh.read("vectors"), asked, a.limit, texts=texts, guild_id=a.guild_id, channel_id=a.channel_id, author_id=a.author_id, after=a.after, before=a.before).show(truncate=False)


if __name__ == "__main__":
    main()
