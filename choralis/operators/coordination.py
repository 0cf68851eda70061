"""Pairs of accounts that post alike at about the same time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choralis.config import Config
from choralis.functions.exact import clamp, floor_seconds, round3
from choralis.operators.intervals import interval_join


def timing_proximity(dt: Column, config: Config) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(dt) / F.lit(float(config.window_seconds)))


def shared_pattern_score(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def coordination_score(text: Column, timing: Column, pattern: Column, config: Config) -> Column:
    return round3(clamp(config.text_weight * text + config.timing_weight * timing + config.pattern_weight * pattern))


def coordination_edges(pairs: DataFrame, replies: DataFrame, accounts: DataFrame, in_reply: DataFrame, config: Config, prune: bool = True) -> DataFrame:
    """The strongest pair of replies of each two accounts, if its rounded score reaches the threshold.

    Only pairs that can reach it are scored: the similarity and time bounds of the configuration drop the others before
    any join with the replies. Where only a time bound holds, the replies near each other in time meet in an interval
    join, so a conversation may have any number of replies; where neither holds, all its pairs are taken.
    """
    none = F.array().cast("array<int>")
    r = replies.join(in_reply, ["conv_id", "reply_id"], "left").join(accounts.select("conv_id", "account_id", "first_pos"), ["conv_id", "account_id"])
    r = r.select("conv_id", "pos", F.struct("reply_id", "account_id", "created_at", "pos", "first_pos", F.coalesce("pattern_ranks", none).alias("ranks")).alias("r"))
    least = config.least_similarity if prune else None
    if prune and least is None and config.most_seconds is not None:
        t = replies.select("conv_id", F.col("pos").alias("i"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("ti"))
        most = (int(config.most_seconds) + 1) * 1_000_000  # whole seconds, rounded down in either order, take up to one more
        near = interval_join(t, t.withColumnsRenamed({"i": "j", "ti": "tj"}), ["conv_id"], "ti", "tj", most, F.col("i") < F.col("j"))
        near = near.select("conv_id", "i", "j", F.floor(F.abs(F.col("ti") - F.col("tj")) / 1_000_000).alias("least_dt"))
        pairs = near.join(pairs, ["conv_id", "i", "j"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
        most_score = config.text_weight * F.col("sim") + config.timing_weight * timing_proximity(F.col("least_dt"), config) + config.pattern_weight
        pairs = pairs.where(most_score >= config.coordinated - 0.0005 - 1e-9).drop("least_dt")  # before rows grow wide
    elif least is None:
        every = replies.select("conv_id", F.col("pos").alias("i")).join(replies.select("conv_id", F.col("pos").alias("j")), "conv_id").where("i < j")
        pairs = every.join(pairs, ["conv_id", "i", "j"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    else:
        pairs = pairs.where(F.col("sim") >= least)
    met = pairs.join(r.withColumnsRenamed({"pos": "i", "r": "x"}), ["conv_id", "i"]).join(r.withColumnsRenamed({"pos": "j", "r": "y"}), ["conv_id", "j"])
    met = met.where(F.col("x.account_id") != F.col("y.account_id"))
    ahead = F.col("x.first_pos") < F.col("y.first_pos")
    met = met.select("conv_id", "sim", F.when(ahead, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(ahead, F.col("y")).otherwise(F.col("x")).alias("y"))
    met = met.withColumn("dt", F.abs(floor_seconds(F.col("x.created_at"), F.col("y.created_at"))))
    if prune and config.most_seconds is not None:
        met = met.where(F.col("dt") <= config.most_seconds)
    met = met.withColumn("timing", timing_proximity(F.col("dt"), config)).withColumn("shared", shared_pattern_score(F.col("x.ranks"), F.col("y.ranks")))
    met = met.withColumn("score", coordination_score(F.col("sim"), F.col("timing"), F.col("shared"), config)).where(F.col("score") >= config.coordinated)
    order = Window.partitionBy("conv_id", "x.account_id", "y.account_id").orderBy(F.desc("score"), "x.pos", "y.pos")
    best = met.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    first = F.col("x.account_id") < F.col("y.account_id")

    def pick(a: str, b: str, c: str) -> Column:
        return F.when(first, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}"))

    return best.select(
        "conv_id", pick("x", "y", "account_id").alias("source"), pick("y", "x", "account_id").alias("target"), "score",
        round3(F.col("sim")).alias("text_similarity"), round3(F.col("timing")).alias("timing"), round3(F.col("shared")).alias("shared"),
        "dt", pick("x", "y", "reply_id").alias("source_reply"), pick("y", "x", "reply_id").alias("target_reply"),
    )


def directed(edges: DataFrame) -> DataFrame:
    """Each edge from either account: conv_id, account_id, other, score, text_similarity, dt."""
    def one(a: str, b: str) -> DataFrame:
        return edges.select("conv_id", F.col(a).alias("account_id"), F.col(b).alias("other"), "score", "text_similarity", "dt")

    return one("source", "target").unionByName(one("target", "source"))
