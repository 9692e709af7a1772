"""The test tables as a message log.

The log's columns are derived from ids alone, the same way in Spark and in the SQL that results are compared
with: authors from roles, channels from conversations, replies, attachments and mentions from ids. What
depends on those is synthetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rendering as R

#: Valid in Spark and in the comparing engine alike.
MESSAGES = """
select conv_id*1000+turn+1 as message_id, conv_id as channel_id, conv_id%4+1 as guild_id,
 conv_id*10 + case role when 'system' then 1 when 'user' then 2 else 3 end as author_id, text as content,
 1704067200 + conv_id*3600 + turn*25 + cast((turn - turn%4)/4 as bigint)*30 as created_s,
 case when role='system' then 21 else 0 end as type,
 case when conv_id%7=0 and turn=1 and conv_id>0 then (conv_id-1)*1000+1
      when turn>0 and (role='assistant' or (role='user' and turn>=3 and conv_id%2=0)) then conv_id*1000+turn end as ref_id,
 case when (conv_id*1000+turn+1)%5=0 then concat('file', cast(conv_id*1000+turn+1 as varchar(20)), '.',
   case (conv_id*1000+turn+1)%7 when 0 then 'PNG' when 1 then 'mp4' when 2 then 'mp3' when 3 then 'pdf' when 4 then 'py' when 5 then 'zip' else 'xyz' end) end as filename
from {conversations}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with what the chunkers and the renderer read."""
    rows = spark.sql(MESSAGES, conversations=table(spark, sf_dir, "conversations"))
    files = F.when(F.col("filename").isNotNull(), F.array("filename")).otherwise(F.array().cast("array<string>"))
    told = rows.withColumns({"created_at": F.timestamp_seconds("created_s"), "username": F.concat(F.lit("user"), F.col("author_id").cast("string")), "filenames": files})
    told = told.withColumn("line", R.message_text("username", "author_id", "created_at", "content", "filenames"))
    mentions = F.when(F.col("message_id") % 4 == 0, F.array(F.col("author_id") + 1, F.col("author_id") - 1)).otherwise(F.array().cast("array<bigint>"))
    return told.withColumns({"cost": R.message_cost("line"), "mentions": mentions, "has_attachments": F.col("filename").isNotNull()})


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: the type as channel, the user as author; a cost from the props' length.

    Seconds are rounded, halves to even, as the SQL's cast of ``epoch(ts)`` rounds them.
    """
    seconds = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("message_id"), F.col("event_type").alias("channel_id"), F.col("user_id").alias("author_id"), F.lit(0).alias("type"), seconds.alias("created_s"), R.count_tokens("props").alias("cost"), F.col("props").alias("content")
    )


#: Ids whose times a timestamp can hold (microseconds in 64 bits).
_DATED = ((1 << 63) // 1_000_000 - 1704067200 - 1800) // 3600 - 1


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as the vector table; an id beyond what a timestamp can hold has no time."""
    day = F.when(F.col("vec_id").between(-_DATED, _DATED), F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") * 3600))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("guild_id"), (F.col("vec_id") % 20).alias("channel_id"), F.array(F.col("vec_id") % 7, F.col("vec_id") % 11).alias("author_ids"), day.alias("first_message_at"), (day + F.expr("interval 30 minutes")).alias("last_message_at"), F.col("embedding").alias("vector")
    )


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunk texts; language as guild, source as channel name."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", R.count_tokens("text").alias("token_count"), F.col("lang").alias("guild"), F.col("source").alias("channel"), F.when(F.col("doc_id") % 3 == 0, "embedded").otherwise("pending").alias("embedding_status"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as channels of the guilds that regions are."""
    types = F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 5, 10, 11, 13, 15, 99)]), (F.col("n_nationkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("channel_id"), F.col("n_regionkey").cast("bigint").alias("guild_id"), F.col("n_name").alias("name"), types.alias("type"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey") % 3).alias("position"), F.when(F.col("n_nationkey") % 4 == 0, F.col("n_nationkey").cast("bigint") + 3).alias("parent_id"))


def guilds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("guild_id"), F.col("r_name").alias("name"))
