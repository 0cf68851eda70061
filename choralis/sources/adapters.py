"""The driver's tables as conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONVERSATIONS = 32
#: What documents are dealt by, and what follows from it: rows of replies that have these columns lie by the first two.
DEALT = ("rest", "ids", "conv_id")
#: Ids that share a set of conversations, so that these grow in number with the documents and not in length.
IDS = 10_000
MOST_REPLIES = 400


def documents_as_replies(spark: SparkSession, sf_dir: str, measured: Callable[[DataFrame], DataFrame] | None = None, dealt: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as replies by their source, whole and of any length, in conversations of at most MOST_REPLIES. Documents
    with near ids and with lengths that leave the same remainder meet, so exact copies among them do.

    measured adds columns to documents before they are dealt, which replies then have too; where only those are asked for,
    no text moves. With dealt they have the columns of DEALT besides. A row without n_chars takes the length of its text. Accounts of every fourth source have no metadata, others have some that follows from the source's number.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = docs.columns
    docs = measured(docs) if measured else docs
    also = [c for c in docs.columns if c not in given] + ([c for c in DEALT if c != "conv_id"] if dealt else [])
    n_chars = F.coalesce("n_chars", F.length("text"), F.lit(0))
    start = F.timestamp_seconds(F.lit(1704067200))
    order = Window.partitionBy("rest", "ids").orderBy("doc_id")
    rank = F.row_number().over(order) - 1
    docs = docs.withColumn("rest", n_chars % CONVERSATIONS).withColumn("ids", F.floor(F.col("doc_id") / IDS)).withColumn("rank", rank)
    replies = docs.select(
        F.concat_ws("-", "rest", "ids", F.floor(F.col("rank") / MOST_REPLIES)).alias("conv_id"),
        (F.col("rank") % MOST_REPLIES).cast("int").alias("pos"),
        "doc_id",
        F.concat(F.lit("d"), "doc_id").alias("reply_id"),
        F.col("source").alias("account_id"),
        "text",
        F.timestamp_seconds(1704067200 + F.col("doc_id") % 120).alias("created_at"),
        *also,
    )
    replies = replies.drop("doc_id")
    posts = replies.select("conv_id").distinct().select(
        "conv_id", F.lit("thread").alias("kind"), F.concat(F.lit("post_"), "conv_id").alias("post_id"), F.lit("root").alias("author"),
        F.lit("the of and to in is it for on that").alias("text"), start.alias("created_at"),
    )
    k = F.substring("account_id", 4, 9).cast("int")
    known = k % 4 != 0
    accounts = replies.groupBy("conv_id", "account_id").agg(F.min("pos").alias("first_pos"))
    accounts = accounts.select(
        "conv_id", "account_id", F.col("account_id").alias("username"), "first_pos",
        F.when(known, k * 137).cast("int").alias("account_age_days"), F.when(known, (k * 7919) % 1000).cast("int").alias("followers"),
        F.when(known, (k * 104729) % 2500).cast("int").alias("following"), F.when(known, k * 4001).cast("int").alias("total_posts"),
    )
    return posts, replies.select("conv_id", "pos", "reply_id", "account_id", "text", "created_at", *also), accounts


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the conversations table as replies by role, a second apart."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select(
        F.col("conv_id").cast("string"), F.col("turn").cast("int").alias("pos"), F.concat_ws("_", F.lit("t"), "conv_id", "turn").alias("reply_id"),
        F.col("role").alias("account_id"), "text", F.timestamp_seconds(F.lit(1704067200) + F.col("turn")).alias("created_at"),
    )
