"""Roll-up of replies to accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choralis.functions.exact import mean3, round3


def with_metadata(accounts: DataFrame) -> DataFrame:
    """has_metadata, follow_ratio, posts_per_day; null where an input is null."""
    given = [F.col(c).isNotNull() for c in ("account_age_days", "followers", "following", "total_posts")]
    return accounts.select(
        "*",
        (given[0] | given[1] | given[2] | given[3]).alias("has_metadata"),
        F.when(given[1] & given[2], round3(F.col("followers") / F.greatest(F.lit(1), "following"))).alias("follow_ratio"),
        F.when(given[0] & given[3], round3(F.col("total_posts") / F.greatest(F.lit(1), "account_age_days"))).alias("posts_per_day"),
    )


def self_similarity(pairs: DataFrame, replies: DataFrame) -> DataFrame:
    """conv_id, account_id, self_similarity: the largest among an account's own replies."""
    who = replies.select("conv_id", "pos", "account_id")
    own = pairs.join(who.withColumnsRenamed({"pos": "i"}), ["conv_id", "i"]).join(who.withColumnsRenamed({"pos": "j", "account_id": "other"}), ["conv_id", "j"])
    own = own.where(F.col("account_id") == F.col("other"))
    return own.groupBy("conv_id", "account_id").agg(round3(F.max("sim")).alias("self_similarity"))


def self_similarity_of_rows(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """The same of similarity.tfidf_rows, whose rows meet the positions of their account: no pair is a row of its own."""
    mine = replies.groupBy("conv_id", "account_id").agg(F.collect_list("pos").alias("mine"))
    who = replies.select("conv_id", F.col("pos").alias("i"), "account_id").join(mine, ["conv_id", "account_id"])
    own = F.filter(F.arrays_zip(F.col("js").alias("j"), F.col("sims").alias("sim")), lambda x: F.array_contains("mine", x["j"]))
    best = rows.join(who, ["conv_id", "i"]).select("conv_id", "account_id", F.array_max(F.transform(own, lambda x: x["sim"])).alias("sim"))
    return best.where("sim is not null").groupBy("conv_id", "account_id").agg(round3(F.max("sim")).alias("self_similarity"))


def self_similarity_of_own(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """The same of `own` in rows of similarity.tfidf_rows: no pair moves."""
    own = rows.where("own is not null").select("conv_id", F.col("i").alias("pos"), "own")
    own = own.join(replies.select("conv_id", "pos", "account_id"), ["conv_id", "pos"])
    return own.groupBy("conv_id", "account_id").agg(round3(F.max("own")).alias("self_similarity"))


def account_features(similar: DataFrame, timing: DataFrame, in_reply: DataFrame, own: DataFrame, neighbours: str = "neighbour_mean") -> DataFrame:
    """One row for each account; the representative reply has the largest rounded similarity, the first of equals."""
    rows = similar.join(timing.drop("reply_id"), ["conv_id", "pos"]).join(in_reply, ["conv_id", "reply_id"], "left")
    ranks = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("pattern_ranks", F.array().cast("array<int>")).alias("r")))), lambda x: x["r"])
    by = rows.groupBy("conv_id", "account_id").agg(
        F.count("*").alias("reply_count"),
        F.min("pos").alias("first_pos"),
        F.max_by("reply_id", F.struct("max_sim", -F.col("pos"))).alias("representative"),
        F.max_by("pos", F.struct("max_sim", -F.col("pos"))).alias("representative_pos"),
        F.max("max_sim").alias("max_sim"),
        mean3(F.col("lex")).alias("lex"),
        F.max(neighbours).alias("neighbour_mean"),
        F.bool_or("near_duplicate").alias("near_duplicate"),
        F.max("within30").alias("within30"),
        F.max("within60").alias("within60"),
        F.bool_or("in_burst").alias("in_burst"),
        F.max("regularity").alias("regularity"),
        F.min("seconds_after").alias("first_seconds"),
        F.array_distinct(F.flatten(ranks)).alias("pattern_ranks"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "reply_id"))), lambda x: x["reply_id"]).alias("reply_ids"),
    )
    return by.join(own, ["conv_id", "account_id"], "left").withColumn("self_similarity", F.coalesce("self_similarity", F.lit(0.0)))


def shares(df: DataFrame, *by: str) -> DataFrame:
    """Counts of each group and its share of its conversation."""
    n = df.groupBy("conv_id", *by).agg(F.count("*").alias("n"))
    return n.withColumn("share", round3(F.col("n") / F.sum("n").over(Window.partitionBy("conv_id"))))

