"""All tables of an analysis, lazily, over any number of conversations."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choralis.config import Config
from choralis.functions.settle import kept
from choralis.functions.text import tokens
from choralis.operators import accounts as acc
from choralis.operators import classify, coordination, graph, phrases, score, scorers, similarity, timing


class Analysis:
    """Tables derived from posts, replies and accounts (see choralis.sources.ingest.flatten), each built when first
    asked for. Tables that many others read are written to the checkpoint folder once, which also keeps plans short."""

    def __init__(self, posts: DataFrame, replies: DataFrame, accounts: DataFrame, config: Config = Config(), scorer: Callable[[str], str] | None = None, model: similarity.SimilarityModel = similarity.tfidf_pairs, dealt: DataFrame | None = None, by: tuple[str, ...] = ("conv_id",)):
        """dealt: the same replies as similarity.measured has them, with the columns `by`, by some of which they lie."""
        self.told, self.by = (similarity.measured(replies), ("conv_id",)) if dealt is None else (dealt, by)
        self.posts, self.replies, self.config, self.scorer, self.model = posts, replies, config, scorer, model
        self.accounts = acc.with_metadata(accounts)

    @cached_property
    def words(self) -> DataFrame:
        told = similarity.tokenised(self.replies)  # whose texts lie in the words, and needn't be written with them
        return kept(told.select("conv_id", "pos", "reply_id", "account_id", "words", "token_count", "lex"), "words")

    def rows(self, least: float | None = None, asked: Column | None = None) -> DataFrame:
        """The pairs of the own model, those of a reply together; see similarity.tfidf_rows. Not written."""
        return similarity.tfidf_rows(self.told.withColumn("words", tokens(F.col("norm"))), least, asked, self.by)

    @cached_property
    def near(self) -> DataFrame | None:
        """Of these what all else is made of: pairs that are similar or may be coordinated, and each reply's greatest
        similarities. Other models have pairs alone."""
        least = min(self.config.similar, self.config.least_similarity or self.config.similar)
        return kept(self.rows(least), "near-pairs") if self.model is similarity.tfidf_pairs else None

    @cached_property
    def pairs(self) -> DataFrame:
        return kept(self.model(self.words), "pairs") if self.model is not similarity.tfidf_pairs else similarity.pairs_of(self.rows())

    def looked_up(self, b: Column) -> DataFrame:
        """conv_id, a, b, sim: each reply's similarity to the one at position b."""
        asked = self.replies.select("conv_id", F.col("pos").alias("a"), b.alias("b"))
        own = self.model is similarity.tfidf_pairs  # then only pairs that are asked for leave their group
        return similarity.similarity_of(similarity.pairs_of(self.rows(math.inf, F.array(b))) if own else self.pairs, asked)

    @cached_property
    def long(self) -> DataFrame | None:
        """conv_id of the conversations of more than similarity.BLOCK replies, if there is any."""
        n = self.replies.groupBy("conv_id").agg(F.count("*").alias("n"))
        found = kept(n.where(F.col("n") > similarity.BLOCK).select("conv_id"), "long-conversations")
        return None if found.isEmpty() else found

    @cached_property
    def weights(self) -> DataFrame | None:
        """Of the long conversations alone, for only they need an index of terms."""
        if self.long is None:
            return None
        long = self.replies.join(self.long, "conv_id", "left_semi")
        return kept(similarity.ordered_weights(similarity.tokenised(long)), "weights")  # without writing the words

    def short_rows(self, least: float) -> DataFrame:
        """rows of the other conversations, which meet whole where they were dealt."""
        told = self.told if self.long is None else self.told.join(self.long, "conv_id", "left_anti")
        return similarity.tfidf_rows(told.withColumn("words", tokens(F.col("norm"))), least, None, self.by)

    def close(self, least: float) -> DataFrame:
        """conv_id, i, j, sim of the own model's pairs with a similarity of at least `least`, above 0: of long conversations
        by the threshold join. Not written."""
        short = similarity.pairs_of(self.short_rows(least), least)
        return short if self.weights is None else short.unionByName(similarity.threshold_pairs(self.weights, least))

    @cached_property
    def matches(self) -> DataFrame:
        """conv_id, pos, best, best_pos: each reply's greatest similarity by the own model and the first reply that has it:
        of long conversations level by level."""
        short = similarity.best_of_rows(self.short_rows(math.inf))
        return short if self.weights is None else short.unionByName(similarity.best_matches(self.weights))

    @cached_property
    def best(self) -> DataFrame:
        return similarity.best_of_pairs(self.pairs) if self.near is None else similarity.best_of_rows(self.near)

    @cached_property
    def directed(self) -> DataFrame:
        """The pairs of the similarity graph, both ways."""
        least = self.config.similar
        close = self.pairs.where(F.col("sim") >= least) if self.near is None else similarity.pairs_of(self.near, least)
        return kept(similarity.timed(close, self.replies), "directed")

    @cached_property
    def top_edges(self) -> DataFrame:
        return kept(similarity.top_edges(self.directed, self.config), "top_edges")

    @cached_property
    def similar(self) -> DataFrame:
        return kept(similarity.reply_similarity(self.told, self.best, self.directed, self.config), "similar")

    @cached_property
    def timing(self) -> DataFrame:
        return kept(timing.reply_timing(self.replies, self.posts, self.directed, self.config), "timing")

    @cached_property
    def patterns(self) -> DataFrame:
        return kept(phrases.patterns(self.words, self.config), "patterns")

    @cached_property
    def reply_patterns(self) -> DataFrame:
        return phrases.reply_patterns(self.patterns)

    @cached_property
    def coordination(self) -> DataFrame:
        least = self.config.least_similarity
        pairs = self.pairs if self.near is None or least is None else similarity.pairs_of(self.near, least)
        return kept(coordination.coordination_edges(pairs, self.replies, self.accounts, self.reply_patterns, self.config), "coordination")

    @cached_property
    def own(self) -> DataFrame:
        return acc.self_similarity(self.pairs, self.replies) if self.near is None else acc.self_similarity_of_own(self.near, self.replies)

    @cached_property
    def features(self) -> DataFrame:
        return kept(acc.account_features(self.similar, self.timing, self.reply_patterns, self.own), "features")

    @cached_property
    def components(self) -> DataFrame:
        return graph.components(self.accounts, self.coordination)

    @cached_property
    def similar_accounts(self) -> DataFrame:
        return graph.similar_accounts(self.top_edges, self.replies)

    @cached_property
    def graph(self) -> DataFrame:
        basic = self.timing.join(self.replies.select("conv_id", "pos", "account_id"), ["conv_id", "pos"])
        basic = basic.groupBy("conv_id", "account_id").agg(F.count("*").alias("reply_count"), F.min("seconds_after").alias("first_seconds"), F.min("pos").alias("first_pos"))
        return kept(graph.graph_features(basic, self.coordination, self.similar_accounts, self.components), "graph")

    @cached_property
    def clusters(self) -> DataFrame:
        return graph.clusters(self.graph, self.config.min_cluster)

    @cached_property
    def members(self) -> DataFrame:
        return kept(graph.members(self.graph, self.clusters), "members")

    @cached_property
    def requests(self) -> DataFrame:
        return kept(classify.requests(self.features, self.graph, self.accounts, self.posts, self.replies, self.similar, self.patterns), "requests")

    @cached_property
    def classified(self) -> DataFrame:
        return kept(classify.scored(self.requests, self.config, *((self.scorer,) if self.scorer else scorers.chosen(self.config))), "classified")

    @cached_property
    def scores(self) -> DataFrame:
        return score.thread_score(self.classified, self.graph, self.similar, self.members, self.config)

    @cached_property
    def links(self) -> DataFrame:
        return graph.behaviour_edges(self.replies, self.top_edges, self.coordination)
