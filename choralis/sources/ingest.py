"""Conversation documents: reading, validation and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from choralis.config import Config
from choralis.sources.schema import CONVERSATION


def read_conversations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """conv_id (hash of the document), kind, post, replies, corrupt (the text of a document that isn't one)."""
    read = spark.read.schema(f"{CONVERSATION}, corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
    rows = read.option("multiLine", multi_line).json(path)
    key = F.md5(F.concat_ws("\x1f", F.to_json(F.struct("kind", "post", "replies")), "corrupt"))
    return rows.select(key.alias("conv_id"), F.coalesce("kind", F.lit("thread")).alias("kind"), "post", "replies", "corrupt")


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _when(ok: Column, text: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), text)


def violations(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """conv_id and violations: what each document breaks, in the order of its fields, then of the checks across fields."""
    p, r = F.col("post"), F.col("replies")
    n = F.coalesce(F.size(r), F.lit(0))
    size = config.max_id

    def every(check) -> Column:
        return F.coalesce(F.forall(r, check), F.lit(True))

    def counts(name: str):
        return every(lambda x: F.coalesce(x["author"][name] >= 0, F.lit(True)))

    ids = F.transform(r, lambda x: x["id"])
    names = F.transform(r, lambda x: F.struct(x["author"]["id"].alias("i"), x["author"]["username"].alias("u")))
    people = F.transform(r, lambda x: x["author"]["id"])
    checks = [
        _when(F.col("kind").isin("thread", "feed"), "kind must be thread or feed"),
        _when(p.isNotNull(), "post must be given"),
        *[_when(~_blank(p[c]) & (F.length(p[c]) <= m), f"post.{c} must have 1 to {m} characters") for c, m in (("id", size), ("author", size), ("text", config.max_text))],
        _when(p["createdAt"].isNotNull(), "post.createdAt must be given"),
        _when(n.between(1, config.max_replies), f"replies must number 1 to {config.max_replies}"),
        _when(every(lambda x: ~_blank(x["id"]) & (F.length(x["id"]) <= size)), f"replies.id must have 1 to {size} characters"),
        _when(every(lambda x: ~_blank(x["text"]) & (F.length(x["text"]) <= config.max_text)), f"replies.text must have 1 to {config.max_text} characters"),
        _when(every(lambda x: x["createdAt"].isNotNull()), "replies.createdAt must be given"),
        _when(every(lambda x: ~_blank(x["author"]["id"]) & (F.length(x["author"]["id"]) <= size)), f"replies.author.id must have 1 to {size} characters"),
        _when(every(lambda x: ~_blank(x["author"]["username"]) & (F.length(x["author"]["username"]) <= size)), f"replies.author.username must have 1 to {size} characters"),
        *[_when(counts(c), f"replies.author.{c} must not be negative") for c in ("accountAgeDays", "followers", "following", "totalPosts")],
        _when(F.coalesce(F.size(F.array_distinct(ids)) == n, F.lit(True)), "duplicate reply id"),
        _when(every(lambda x: F.coalesce(x["createdAt"] >= p["createdAt"], F.lit(True))), "a reply predates the post"),
        _when(F.coalesce(F.size(F.array_distinct(names)) == F.size(F.array_distinct(people)), F.lit(True)), "an account appears with two usernames"),
        _when(F.coalesce(~F.array_contains(ids, p["id"]), F.lit(True)), "a reply reuses the post id"),
    ]
    return rows.select("conv_id", F.array_compact(F.array(*checks)).alias("violations"))


def problem(found: Column) -> Column:
    """The first five violations as one text; null without any."""
    return F.when(F.size(found) > 0, F.array_join(F.slice(found, 1, 5), "; "))


def flatten(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """posts, replies, accounts; an account's first record wins."""
    posts = rows.select("conv_id", "kind", F.col("post.id").alias("post_id"), "post.author", "post.text", F.col("post.createdAt").alias("created_at"))
    each = rows.select("conv_id", F.posexplode("replies").alias("pos", "r"))
    replies = each.select("conv_id", "pos", F.col("r.id").alias("reply_id"), F.col("r.author.id").alias("account_id"), "r.text", F.col("r.createdAt").alias("created_at"))
    first = each.groupBy("conv_id", F.col("r.author.id").alias("account_id")).agg(F.min("pos").alias("first_pos"), F.min_by("r.author", "pos").alias("a"))
    accounts = first.select(
        "conv_id", "account_id", "a.username", "first_pos", F.col("a.accountAgeDays").alias("account_age_days"), "a.followers", "a.following", F.col("a.totalPosts").alias("total_posts")
    )
    return posts, replies, accounts


def reply_checks(replies: DataFrame, posts: DataFrame, accounts: DataFrame) -> DataFrame:
    """The checks across fields on flat tables: conv_id, duplicate_ids, early, two_names, reused."""
    dup = F.count("*").over(Window.partitionBy("conv_id", "reply_id")) > 1
    r = replies.withColumn("dup", dup).join(posts.select("conv_id", "post_id", F.col("created_at").alias("posted_at")), "conv_id")
    names = accounts.groupBy("conv_id", "account_id").agg(F.count_distinct("username").alias("n")).groupBy("conv_id").agg(F.count(F.when(F.col("n") > 1, 1)).alias("two_names"))
    by = r.groupBy("conv_id").agg(
        F.count(F.when(F.col("dup"), 1)).alias("duplicate_ids"), F.count(F.when(F.col("created_at") < F.col("posted_at"), 1)).alias("early"), F.count(F.when(F.col("reply_id") == F.col("post_id"), 1)).alias("reused")
    )
    return by.join(names, "conv_id", "left").select("conv_id", "duplicate_ids", "early", F.coalesce("two_names", F.lit(0)).alias("two_names"), "reused")
