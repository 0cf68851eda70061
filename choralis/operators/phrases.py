"""Phrases that several accounts of a conversation repeat."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choralis.config import Config
from choralis.functions.settle import kept
from choralis.functions.text import contentful, shingles
from choralis.operators import similarity


def trigrams(words: DataFrame) -> DataFrame:
    """conv_id, pos, reply_id, account_id, at, trigram: every contentful run of three words."""
    runs = words.select("conv_id", "pos", "reply_id", "account_id", F.posexplode(shingles(F.col("words"), 3)).alias("at", "trigram"))
    return runs.where(contentful(F.col("trigram")))


def candidate_trigrams(words: DataFrame, config: Config) -> DataFrame:
    """Those of trigrams(words) that enough accounts may share. Runs of three words are counted by a number before anything is
    collected: of a number that fewer accounts have no trigram can be shared, and nearly all have one account.

    Words move once, dealt by conversation. Conversations of at most similarity.BLOCK replies meet whole there, and no run
    becomes a row but those that may be shared; the runs of longer ones meet in windows.
    """
    n = words.groupBy("conv_id").agg(F.count("*").alias("n"))
    long = kept(n.where(F.col("n") > similarity.BLOCK).select("conv_id"), "long-conversations")
    if long.isEmpty():
        return _met_whole(words, config)
    # a null is a conversation of its own, too
    own = lambda how: words.join(long.withColumnRenamed("conv_id", "long"), F.col("conv_id").eqNullSafe(F.col("long")), how)
    return _met_whole(own("left_anti"), config).unionByName(_met_in_windows(own("left_semi"), config))


def _shared_runs(least: int) -> Callable[[pa.Table], pa.Table]:
    """Of a conversation's runs those with a number that at least so many accounts have."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        size = pc.list_value_length(rows["words"]).to_numpy().astype(np.int64)
        words = pc.list_flatten(rows["words"])
        code = pc.dictionary_encode(words, null_encoding="encode").combine_chunks().indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        first = np.flatnonzero(at + 2 < size[row])
        several = code.max(initial=0) + 1  # of two million words and more, different runs may have one number
        _, kind = np.unique((code[first] * several + code[first + 1]) * several + code[first + 2], return_inverse=True)
        accounts, who = np.unique(rows["who"].to_numpy(), return_inverse=True)
        met = np.unique(kind * len(accounts) + who[row[first]]) // len(accounts)
        first = first[np.bincount(met)[kind] >= least]
        told = rows.select(["conv_id", "pos", "reply_id", "account_id"]).take(row[first])
        trigram = pc.binary_join_element_wise(*[words.take(first + k) for k in range(3)], pa.scalar(" ", words.type))
        return told.append_column("at", pa.array(at[first].astype(np.int32))).append_column("trigram", trigram)

    return run


def _met_whole(words: DataFrame, config: Config) -> DataFrame:
    given = words.where((F.size("words") >= 3) & F.col("pos").isNotNull())
    rows = given.select("conv_id", "pos", "reply_id", "account_id", "words", F.xxhash64("account_id").alias("who"))
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("conv_id", "pos", "reply_id", "account_id"))
    found = rows.groupBy("conv_id").applyInArrow(_shared_runs(config.min_phrase_accounts), f"{types}, at int, trigram string")
    return found.where(contentful(F.col("trigram")))


def _met_in_windows(words: DataFrame, config: Config) -> DataFrame:
    """Conversations of any length. A reply's runs become rows there, beside one row that keeps its words, and meet
    in windows that follow that one shuffle; so no run moves, and words needn't be sought again for the runs that are left.
    """
    dealt = words.where(F.size("words") >= 3).select("conv_id", "pos", "reply_id", "account_id", "words").repartition("conv_id")
    run = lambda i: F.struct(i.alias("at"), F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"))
    keeper = F.array(F.struct(F.lit(-1).alias("at"), F.xxhash64("pos").alias("h")))
    rows = dealt.withColumn("run", F.explode(F.concat(keeper, F.transform(F.sequence(F.lit(0), F.size("words") - 3), run))))
    keeps = F.col("run.at") < 0
    rows = rows.select(
        "conv_id", "pos", "run.at", "run.h", F.xxhash64("account_id").alias("who"),
        *[F.when(keeps, F.col(c)).alias(c) for c in ("reply_id", "account_id", "words")],
    )
    same = Window.partitionBy("conv_id", "h")
    rows = rows.withColumn("nth", F.dense_rank().over(same.orderBy("who"))).withColumn("n", F.max("nth").over(same))
    rows = rows.where((F.col("at") < 0) | (F.col("n") >= config.min_phrase_accounts))
    told = rows.groupBy("conv_id", "pos").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("reply_id", "account_id", "words")],
        F.collect_list(F.when(F.col("at") >= 0, F.col("at"))).alias("spots"),
    )
    told = told.where("pos is not null").withColumn("at", F.explode("spots"))
    trigram = F.array_join(F.slice("words", F.col("at") + 1, 3), " ")
    return told.select("conv_id", "pos", "reply_id", "account_id", "at", trigram.alias("trigram")).where(contentful(F.col("trigram")))


def shared_trigrams(runs: DataFrame, config: Config) -> DataFrame:
    """conv_id, trigram, reply_set (sorted), accounts, first: of trigrams that enough accounts use."""
    few = runs.groupBy("conv_id", "trigram").agg(
        F.count_distinct("account_id").alias("accounts"),
        F.sort_array(F.collect_set("reply_id")).alias("reply_set"),
        F.min(F.struct("pos", "at")).alias("first"),
    )
    return few.where(F.col("accounts") >= config.min_phrase_accounts)


def patterns(words: DataFrame, config: Config) -> DataFrame:
    """conv_id, rank, pattern_id, text, account_count, reply_set.

    Trigrams with one set of replies are laid over the least reply's words; runs of covered words are the phrases, put together from the trigrams that cover them.
    """
    runs = kept(candidate_trigrams(words, config), "trigrams")
    shared = kept(shared_trigrams(runs, config), "shared_trigrams")
    # a set of replies goes by its digest, for it is as long as its conversation and comes with each of its trigrams
    shared = shared.withColumn("set", F.unhex(F.sha2(F.to_json("reply_set"), 256)))
    group = shared.groupBy("conv_id", "set").agg(F.min("first").alias("first"), F.first("accounts").alias("account_count"))
    spots = shared.withColumn("reply_id", F.element_at("reply_set", 1)).select("conv_id", "set", "reply_id", "trigram")
    spots = spots.join(runs.select("conv_id", "reply_id", "trigram", "at"), ["conv_id", "reply_id", "trigram"])
    along = Window.partitionBy("conv_id", "set").orderBy("at")
    step = F.col("at") - F.coalesce(F.lag("at").over(along), F.lit(-9))
    spots = spots.withColumn("step", step).withColumn("island", F.sum((step > 3).cast("int")).over(along))
    # a run's trigrams hold all its words: each adds as many of its last ones as it lies behind the one before
    adds = F.slice(F.split("trigram", " "), 4 - F.least("step", F.lit(3)), F.least("step", F.lit(3)))
    cut = spots.groupBy("conv_id", "set", "island").agg(F.min("at").alias("a"), F.sort_array(F.collect_list(F.struct("at", adds.alias("adds")))).alias("runs"))
    text = F.array_join(F.flatten(F.transform("runs", lambda x: x["adds"])), " ")
    found = cut.select("conv_id", "set", "a", text.alias("text")).join(group, ["conv_id", "set"])
    order = Window.partitionBy("conv_id").orderBy(F.desc("account_count"), F.desc(F.length("text")), "first", "a")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.max_patterns)
    # of a set one trigram holds the replies, the one that is found first
    ranked = ranked.join(shared.select("conv_id", "set", "first", "reply_set"), ["conv_id", "set", "first"])
    return ranked.select("conv_id", "rank", F.concat(F.lit("pattern_"), "rank").alias("pattern_id"), "text", "account_count", "reply_set")


def reply_patterns(found: DataFrame) -> DataFrame:
    """conv_id, reply_id, pattern_ranks: the patterns in a reply, in their order."""
    rows = found.select("conv_id", "rank", F.explode("reply_set").alias("reply_id"))
    return rows.groupBy("conv_id", "reply_id").agg(F.sort_array(F.collect_list("rank")).alias("pattern_ranks"))
