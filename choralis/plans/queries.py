"""The operators as queries over the driver's tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from choralis.config import Config, Thresholds
from choralis.functions import settle, signals, text
from choralis.functions.exact import epoch, floor_seconds, label, mean3, round3
from choralis.operators import accounts as acc
from choralis.operators import answers, classify, coordination, graph, intervals, phrases, similarity, timing, views
from choralis.plans import fixtures
from choralis.plans.analysis import Analysis
from choralis.sources import adapters, ingest, names, pages, store, targets
from choralis.streaming import capture

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@lru_cache(maxsize=4)
def analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    dealt = adapters.documents_as_replies(spark, sf_dir, similarity.measured, dealt=True)[1]
    return Analysis(*adapters.documents_as_replies(spark, sf_dir), dealt=dealt, by=adapters.DEALT)


def over(name: str):
    """A query over the analysis of the documents."""

    def put(f: Callable[[Analysis], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(analysis(spark, sf_dir))
        return f

    return put


def listed(c: str | Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def listed_values(c: str, f: Callable[[Column], Column]) -> Column:
    """The values of the structs in column c; of a null column none."""
    return F.coalesce(F.array_join(F.transform(c, lambda x: f(x).cast("string")), ","), F.lit(""))


def thousandths(x: Column) -> Column:
    return F.round(x * 1000).cast("long")


# -- text, similarity


@over("normalised_text")
def _(a):
    return a.words.select("conv_id", "pos", F.array_join("words", " ").alias("norm"))


@query
def lexical_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, replies, _ = adapters.documents_as_replies(spark, sf_dir, lambda d: similarity.tokenised(d).drop("norm", "words"))
    return replies.select("conv_id", "pos", "token_count", "lex")


def _shingles(docs: DataFrame) -> DataFrame:
    runs = similarity.tokenised(docs).withColumn("runs", text.shingles(F.col("words"), 3))
    counts = runs.withColumn("shingles", F.size("runs")).withColumn("contentful", F.size(F.filter("runs", text.contentful)))
    return counts.drop("norm", "words", "token_count", "lex", "runs")


@query
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.documents_as_replies(spark, sf_dir, _shingles)[1].select("conv_id", "pos", "shingles", "contentful")


@over("tfidf_df")
def _(a):
    return similarity.document_frequency(a.words)


@over("tfidf_weights")
def _(a):
    return similarity.term_weights(a.words).select("conv_id", "pos", "term", round3(F.col("w")).alias("w"))


@over("tfidf_pairs")
def _(a):
    return a.pairs.select("conv_id", "i", "j", round3(F.col("sim")).alias("sim"))


@over("similar_pairs")
def _(a):
    """The pairs of the similarity graph, in long conversations by the threshold join."""
    return a.close(a.config.similar).select("conv_id", "i", "j", round3(F.col("sim")).alias("sim"))


@over("coordination_candidates")
def _(a):
    """The pairs that can reach the coordination score, in long conversations by the threshold join."""
    return a.close(a.config.least_similarity).select("conv_id", "i", "j", round3(F.col("sim")).alias("sim"))


@over("best_matches")
def _(a):
    return a.matches.select("conv_id", "pos", round3(F.col("best")).alias("best"), "best_pos")


@query
def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = v.select((F.col("vec_id") % 64).alias("conv_id"), F.floor(F.col("vec_id") / 64).alias("pos"), "embedding")
    return similarity.embedding_pairs(rows).select("conv_id", "i", "j", round3(F.col("sim")).alias("sim"))


@over("pair_lookup")
def _(a):
    return a.looked_up((F.col("pos") * 7 + 3) % 11).select("conv_id", "a", "b", round3(F.col("sim")).alias("sim"))


@over("similarity_edges")
def _(a):
    return a.top_edges.select("conv_id", "i", "j", round3(F.col("sim")).alias("sim"), "dt")


@over("reply_similarity")
def _(a):
    return a.similar.select("conv_id", "pos", "max_sim", "near_duplicate", "neighbours", "neighbour_mean")


@over("most_similar_reply")
def _(a):
    return a.similar.select("conv_id", "pos", "most_similar_pos")


@over("neighbour_lists")
def _(a):
    return a.similar.where("neighbours > 0").select("conv_id", "pos", listed("first_neighbours").alias("first_neighbours"))


@over("near_duplicates")
def _(a):
    return a.similar.where("near_duplicate").select("conv_id", "reply_id", "account_id")


@over("comparisons")
def _(a):
    return similarity.comparisons(a.replies)


@query
def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar turns of the conversations table."""
    turns = adapters.conversation_turns(spark, sf_dir)
    words = similarity.tokenised(turns)
    return similarity.tfidf_pairs(words).groupBy("conv_id").agg(F.count("*").alias("pairs"), round3(F.max("sim")).alias("best"))


# -- phrases, timing


@over("repeated_trigrams")
def _(a):
    found = phrases.shared_trigrams(phrases.candidate_trigrams(a.words, a.config), a.config)
    return found.select("conv_id", "trigram", "accounts", listed("reply_set").alias("replies"))


@over("repeated_phrases")
def _(a):
    return a.patterns.select("conv_id", "pattern_id", "text", "account_count", F.size("reply_set").alias("replies"))


@over("reply_phrases")
def _(a):
    return a.reply_patterns.select("conv_id", "reply_id", listed("pattern_ranks").alias("patterns"))


@over("timing_bursts")
def _(a):
    return a.timing.select("conv_id", "pos", "seconds_after", "within30", "within60", "in_burst")


@over("timing_regularity")
def _(a):
    return a.timing.where("regularity is not null").select("conv_id", "pos", "regularity")


@query
def event_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    by = e.groupBy("user_id", "event_type").agg(F.sort_array(F.collect_list(epoch(F.col("ts")))).alias("t"))
    return by.select("user_id", "event_type", F.size("t").alias("events"), timing.regularity(F.col("t")).alias("regularity"))


@query
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", floor_seconds(before, F.col("ts")).alias("ahead"), F.abs(floor_seconds(F.col("ts"), before)).alias("back"))


@query
def event_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other events of its user lie within half an hour and an hour of each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", epoch(F.col("ts")).alias("t"))
    near = intervals.near_counts(e, ["user_id"], "t", {"within30": 1800, "within60": 3600})
    return near.select("event_id", "within30", "within60", (F.col("within60") >= Config().burst).alias("in_burst"))


@query
def click_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of clicks of a client and kind, within 30 and 60 seconds; rows without client or kind have no number."""
    c = spark.read.parquet(f"{sf_dir}/clicks.parquet").select("click_id", "client_id", "kind", epoch(F.col("ts")).alias("t"))
    near = intervals.near_counts(c, ["client_id", "kind"], "t", {"within30": 30, "within60": 60}, 3600)
    return near.select("click_id", "within30", "within60", (F.col("within60") >= Config().burst).alias("in_burst"))


@query
def errors_near_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and errors of a client at most ten minutes apart, with the seconds between them."""
    c = spark.read.parquet(f"{sf_dir}/clicks.parquet").select("client_id", "kind", "click_id", epoch(F.col("ts")).alias("t"))
    bought = c.where("kind = 'purchase'").select("client_id", F.col("click_id").alias("purchase"), F.col("t").alias("bought"))
    failed = c.where("kind = 'error'").select("client_id", F.col("click_id").alias("error"), F.col("t").alias("failed"))
    met = intervals.interval_join(bought, failed, ["client_id"], "bought", "failed", 600)
    return met.select("client_id", "purchase", "error", (F.col("failed") - F.col("bought")).alias("seconds"))


# -- coordination, graph


@over("coordination_edges")
def _(a):
    return a.coordination


#: Timing weighs so much that no similarity is needed, so replies are candidates by their time alone.
BY_TIME = Config(text_weight=0.3, timing_weight=0.6, pattern_weight=0.1, coordinated=0.69)


@over("coordination_by_time")
def _(a):
    return coordination.coordination_edges(a.pairs, a.replies, a.accounts, a.reply_patterns, BY_TIME)


@over("coordination_adjacency")
def _(a):
    return coordination.directed(a.coordination).groupBy("conv_id", "account_id").agg(F.count("*").alias("edges"), F.max("score").alias("best"))


@query
def coordination_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score's three terms on a grid of literal values."""
    c = Config()
    n = spark.range(0, 1000).select((F.col("id") % 10 / 9.0).alias("text"), ((F.col("id") / 10).cast("int") % 10 * 17 - 20).alias("dt"), ((F.col("id") / 100).cast("int")).alias("k"))
    a, b = F.sequence(F.lit(1), F.lit(5)), F.sequence(F.lit(3), F.lit(3) + F.col("k"))
    return n.select("text", "dt", "k", round3(coordination.timing_proximity(F.col("dt"), c)).alias("timing"), round3(coordination.shared_pattern_score(a, b)).alias("shared"),
                    coordination.coordination_score(F.col("text"), coordination.timing_proximity(F.col("dt"), c), coordination.shared_pattern_score(a, b), c).alias("score"))


@over("components")
def _(a):
    return a.components.select("conv_id", "account_id", "component")


@over("components_iterative")
def _(a):
    return graph.components_iterative(a.accounts, a.coordination)


@query
def client_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of clients that their master records, e-mail addresses or names connect, however many they are."""
    c = spark.read.parquet(f"{sf_dir}/clients.parquet").select("client_id", "master_id", F.lower("email").alias("email"), F.lower("name").alias("name"))
    c = c.where("client_id is not null")
    ids = F.col("client_id").cast("string")
    by_master = c.where("master_id is not null").select(ids.alias("source"), F.col("master_id").cast("string").alias("target"))
    links = by_master
    for same in ("email", "name"):  # all with a value are linked to the least of them: a star, not all pairs
        first = F.min("client_id").over(Window.partitionBy(same)).cast("string")
        links = links.unionByName(c.where(F.col(same).isNotNull()).select(ids.alias("source"), first.alias("target")))
    one = F.lit("clients").alias("conv_id")
    nodes = c.select(ids.alias("account_id")).unionByName(by_master.select(F.col("target").alias("account_id"))).distinct()
    found = graph.components_iterative(nodes.select(one, "account_id"), links.select(one, "source", "target"), finish=0)
    size = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(size, "component").select("account_id", "component", "size")


@over("account_links")
def _(a):
    return graph.account_links(a.coordination).select("conv_id", "account_id", round3(F.col("similarity")).alias("similarity"), "links", "max_score")


@over("graph_features")
def _(a):
    return a.graph.drop("first_pos")


@over("similar_account_edges")
def _(a):
    return a.similar_accounts


@over("account_edges")
def _(a):
    return views.account_edges(a.similar_accounts, a.coordination)


@over("clusters")
def _(a):
    return a.clusters


@over("cluster_members")
def _(a):
    return a.members


@over("graph_counts")
def _(a):
    return views.graph_counts(a)


@over("ranked_members")
def _(a):
    return views.ranked_members(a.classified, a.members)


@over("account_details")
def _(a):
    d = views.account_details(a)
    lists = (("replies", "reply_id"), ("similar", "other_reply"), ("coordinated", "other"))
    names = [listed(F.coalesce(F.col(x).getField(f), F.array().cast("array<string>"))).alias(x) for x, f in lists]
    shown = {
        "times": ("replies", lambda x: x["seconds_after"]),
        "similarities": ("similar", lambda x: F.concat_ws(":", thousandths(x["sim"]), x["dt"])),
        "scores": ("coordinated", lambda x: F.concat_ws(":", thousandths(x["score"]), x["dt"])),
    }
    return d.select("conv_id", "account_id", "label", "automation", "cluster_id", "reach", *names, *[listed_values(x, f).alias(n) for n, (x, f) in shown.items()])


@over("cluster_details")
def _(a):
    d = views.cluster_details(a)
    told = F.coalesce("phrases", F.array().cast(d.schema["phrases"].dataType))
    return d.select(
        "conv_id", "cluster_id", "size", "density", "similarity", "score", "automation", "coordination",
        listed(F.transform("accounts", lambda r: r["account_id"])).alias("accounts"), F.array_join(F.transform(told, lambda r: r["text"]), "|").alias("phrases"),
        listed_values("accounts", lambda r: thousandths(r["automation"])).alias("automations"), listed_values("phrases", lambda r: r["uses"]).alias("uses"),
    )


@over("cluster_stats")
def _(a):
    return graph.cluster_stats(a.coordination, a.members, a.timing)


@over("cluster_likelihoods")
def _(a):
    rows = a.members.join(a.classified.select("conv_id", "account_id", "automation", "coordination"), ["conv_id", "account_id"])
    by = rows.groupBy("conv_id", "cluster_id").agg(mean3(F.col("automation")).alias("automation"), mean3(F.col("coordination")).alias("coordination"))
    return by.withColumn("label", views.cluster_label(F.col("automation")))


@over("cluster_density")
def _(a):
    return graph.cluster_density(a.coordination, a.members)


@over("cluster_top_phrases")
def _(a):
    return graph.cluster_phrases(a.members, a.replies, a.patterns)


@over("account_similar_top5")
def _(a):
    return graph.account_similar(a.top_edges, a.replies)


@over("coordinated_neighbours")
def _(a):
    return graph.coordinated_neighbours(a.coordination)


@over("two_hop_reach")
def _(a):
    return graph.reach(a.coordination, a.accounts)


def _wanted(a):
    first = a.accounts.groupBy("conv_id").agg(F.min_by("account_id", "first_pos").alias("source"))
    return a.accounts.select("conv_id", F.col("account_id").alias("target")).join(first, "conv_id")


@over("shortest_path_length")
def _(a):
    return graph.shortest_paths(_wanted(a), a.links).select("conv_id", "source", "target", "length")


@over("shortest_path_steps")
def _(a):
    return graph.path_steps(graph.shortest_paths(_wanted(a), a.links), a.links)


# -- accounts, classifier, views


@over("account_metadata")
def _(a):
    return a.accounts.select("conv_id", "account_id", "has_metadata", "follow_ratio", "posts_per_day")


@over("self_similarity")
def _(a):
    return a.own


@over("account_features")
def _(a):
    return a.features.drop("reply_ids", "pattern_ranks", "representative_pos")


@over("account_patterns")
def _(a):
    return a.features.where(F.size("pattern_ranks") > 0).select("conv_id", "account_id", listed("pattern_ranks").alias("patterns"))


@over("account_replies")
def _(a):
    rows = views.account_replies(a.replies, a.similar, a.timing, a.accounts)
    return rows.select("conv_id", "account_id", listed(F.transform("replies", lambda r: r["reply_id"])).alias("replies"))


@over("classify_accounts")
def _(a):
    return a.classified.select("conv_id", "account_id", "label", "automation", "coordination", "confidence", "category")


@over("classification_evidence")
def _(a):
    return a.classified.select("conv_id", "account_id", F.size("signals_for").alias("n_for"), F.size("signals_against").alias("n_against"), F.size("coordination_signals").alias("n_coordination"))


@over("classification_texts")
def _(a):
    """The wordings, each list's joined by bars."""
    lists = [F.array_join(c, "|").alias(c) for c in ("signals_for", "signals_against", "coordination_signals")]
    return a.classified.select("conv_id", "account_id", *lists, "summary", "source")


@over("scorer_requests")
def _(a):
    return a.requests.select("conv_id", "account_id", F.size("neighbour_texts").alias("neighbours"), F.size("other_texts").alias("others"), F.size("phrases").alias("phrases"), "phrase_accounts")


@over("thread_score")
def _(a):
    return a.scores


@over("label_counts")
def _(a):
    return acc.shares(a.classified, "label")


@over("sensitivity_relabel")
def _(a):
    cols = [classify.relabelled(F.col("automation"), F.col("source"), s).alias(f"at_{s}") for s in (0, 50, 100)]
    return a.classified.select("conv_id", "account_id", *cols)


@over("coordinated_filter")
def _(a):
    rows = a.classified.join(a.members.select("conv_id", "account_id", "cluster_id"), ["conv_id", "account_id"], "left")
    return rows.where(views.passes("coordinated", F.col("label"), F.col("cluster_id"), F.col("coordinated"))).select("conv_id", "account_id")


@over("feed_groups")
def _(a):
    return views.feed_groups(a.classified)


@over("group_members")
def _(a):
    return views.group_members(a.classified)


@over("common_signals")
def _(a):
    return views.common_signals(a.classified)


@over("hidden_counts")
def _(a):
    return views.hidden_counts(a.classified, views.HIDEABLE)


@over("badges")
def _(a):
    return views.badges(a.classified, a.replies, a.members, a.clusters)


@over("reveal_order")
def _(a):
    return views.reveal_order(a.graph)


@over("account_search")
def _(a):
    return views.search(a.accounts, "@SRC1").select("conv_id", "account_id")


@over("account_lookup")
def _(a):
    return views.lookup(a.accounts, "Src7").select("conv_id", "account_id", "first_pos")


@over("focus")
def _(a):
    return views.focus(views.account_edges(a.similar_accounts, a.coordination), a.accounts)


@over("result_lines")
def _(a):
    return views.result_line(a.classified, a.clusters, a.scores)


@over("graph_view")
def _(a):
    """The nested JSON read back: one row for each account, edge and cluster of it, and for its score."""
    return views.view_parts(views.graph_view(a))


@over("stored_tables")
def _(a):
    out = None
    for name, df in store.graph_tables(a).items():
        n = df.groupBy("analysis_id").agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out


@over("node_sizes")
def _(a):
    n = F.count("*").over(Window.partitionBy("conv_id"))
    return a.classified.select("conv_id", "account_id", round3(views.node_size(F.col("degree"), F.col("reply_count"), n)).alias("size"))


# -- signals and literal rows


def _dealt(rows: list, key: str) -> Column:
    """One of the rows for each key, in turn."""
    return F.element_at(F.array(*[F.lit(x) for x in rows]), (F.col(key) % len(rows) + 1).cast("int"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, texts, parent: an account for each document, that posts one of the sample texts and then the whole document,
    or, in every second round of samples, the sample alone with the document's source behind it."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("k", (F.col("doc_id") % len(fixtures.SIGNAL_TEXTS)).cast("int"))
    told = spark.createDataFrame([(k, t, p) for k, (_, t, p) in enumerate(fixtures.SIGNAL_TEXTS)], "k int, said array<string>, parent string")
    both = d.join(F.broadcast(told), "k")
    alone = F.concat(F.slice("said", 1, F.size("said") - 1), F.array(F.concat(F.element_at("said", -1), F.lit(" "), F.coalesce("source", F.lit("")))))
    texts = F.when(F.floor(F.col("doc_id") / len(fixtures.SIGNAL_TEXTS)) % 2 == 0, F.concat("said", F.array(F.coalesce("text", F.lit(""))))).otherwise(alone)
    return both.select("doc_id", texts.alias("texts"), "parent")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.text_signals(F.col("texts"), F.col("parent"))
    return _texts(spark, sf_dir).select("doc_id", F.explode(F.array(found)).alias("signals"))  # rows of their own, for otherwise each use of a signal searches the texts again


@query
def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, flags and numbers of distinct matches."""
    plain = ("emojis", "emoji_density", "links", "uppercase_ratio", "thread_hook", "parent_overlap", "generic_praise", "substantive")
    lists = [F.size(f"signals.{c}").alias(f"n_{c}") for c in signals.LISTS]
    return _signals(spark, sf_dir).select("doc_id", *[F.col(f"signals.{c}").alias(c) for c in plain], *lists)


@query
def text_signal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("doc_id", "signals.mentions", "signals.hashtags", *[F.array_join(f"signals.{c}", "|").alias(c) for c in signals.LISTS])


@query
def spam_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = [classify.category(F.lit(x)).alias(f"category_{x}") for x in classify.LABELS]
    return _signals(spark, sf_dir).select("doc_id", round3(classify.spam_floor()).alias("spam"), *cats)


@query
def document_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    loud, urgent = signals.uppercase_ratio(F.col("text")) >= 0.5, F.size(signals.first_matches(F.col("text"), signals.URGENCY)) > 0
    rows = d.select("source", signals.link_count(F.col("text")).alias("links"), loud.alias("loud"), urgent.alias("urgent"))
    return rows.groupBy("source").agg(F.sum("links").alias("links"), F.count_if("loud").alias("shouting"), F.count_if("urgent").alias("urgent"))


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address for each page, in one of the sample forms, under a name of the page's own."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.replace(_dealt(fixtures.URLS, "page_id"), F.lit("jane"), F.concat(F.lit("u"), "page_id")).alias("raw"))


@query
def target_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _addresses(spark, sf_dir).withColumn("t", targets.target(F.col("raw")))
    return rows.select("page_id", "raw", "t.site", "t.url", "t.feed", targets.login_required(F.col("raw")).alias("login"))


@query
def profile_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _addresses(spark, sf_dir).select("page_id", targets.handle(F.col("raw")).alias("handle"))


@query
def item_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of ids made of the documents': with a time in the high bits, too small, missing or no number."""
    now = F.timestamp_seconds(F.lit(1767225600))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = ((F.lit(1_600_000_000_000) + F.col("doc_id") * 60_000) * 4_194_304 + F.col("doc_id")).cast("string")
    kind = F.col("doc_id") % 4
    made = F.when(kind == 0, whole).when(kind == 1, F.col("doc_id").cast("string")).when(kind == 2, F.concat(F.lit("n"), "doc_id"))
    rows = d.select("doc_id", made.alias("id"), _dealt([r for _, r in fixtures.TIMES], "doc_id").alias("relative"))
    return rows.select("doc_id", F.unix_millis(targets.created_at(F.col("id"), F.col("relative"), now)).alias("ms"))


@query
def threshold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the hundredths of events' values."""
    t = Thresholds()
    p = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.floor(F.col("value") * 100) % 101 / 100.0).alias("p"))
    return p.select("event_id", "p", label(F.col("p"), t.human, t.automation).alias("label"), label(F.col("p"), 0.2, 0.9).alias("wide"))


@query
def duration_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * 97 % 20_000).alias("n"))
    return n.select("o_orderkey", "n", views.duration_text(F.col("n")).alias("duration"), views.age_text(F.when(F.col("n") % 5 != 0, F.col("n"))).alias("age"))


@query
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()
    return d.select("source", names.fnv_name(F.col("source")).alias("shown"))


@query
def sent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.length(views.sent_text(F.col("text"))).alias("sent"))


# -- ingest, store


@query
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, replies, accounts = adapters.documents_as_replies(spark, sf_dir)
    return ingest.reply_checks(replies, posts, accounts)


@query
def document_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which conversations of the conversations table would break the limits."""
    turns = adapters.conversation_turns(spark, sf_dir)
    who = F.struct(F.col("account_id").alias("id"), F.col("account_id").alias("username"), *[F.lit(None).cast("int").alias(c) for c in ("accountAgeDays", "followers", "following", "totalPosts")])
    reply = F.struct(F.col("reply_id").alias("id"), who.alias("author"), "text", F.col("created_at").alias("createdAt"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", reply.alias("r")))).alias("x"))
    post = F.struct(F.concat(F.lit("p"), "conv_id").alias("id"), F.lit("root").alias("author"), F.lit("post").alias("text"), F.timestamp_seconds(F.lit(1704067200)).alias("createdAt"))
    rows = rows.select("conv_id", F.lit("thread").alias("kind"), post.alias("post"), F.transform("x", lambda x: x["r"]).alias("replies"))
    found = ingest.violations(rows)
    return found.select("conv_id", F.size("violations").alias("n"), F.coalesce(ingest.problem(F.col("violations")), F.lit("")).alias("problem"))


@query
def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table written as JSON documents, read again, validated and flattened."""
    turns = adapters.conversation_turns(spark, sf_dir)
    who = F.struct(F.col("account_id").alias("id"), F.col("account_id").alias("username"))
    reply = F.struct(F.col("reply_id").alias("id"), who.alias("author"), "text", F.col("created_at").alias("createdAt"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", reply.alias("r")))).alias("x"))
    post = F.struct(F.concat(F.lit("p"), "conv_id").alias("id"), F.lit("root").alias("author"), F.lit("post").alias("text"), F.timestamp_seconds(F.lit(1704067200)).alias("createdAt"))
    folder = settle.fresh_path(spark, "conversations")
    rows.select(F.lit("thread").alias("kind"), post.alias("post"), F.transform("x", lambda x: x["r"]).alias("replies")).write.json(folder)
    read = ingest.read_conversations(spark, folder, multi_line=False)
    fine = read.join(ingest.violations(read).where("size(violations) > 0"), "conv_id", "left_anti")
    posts, replies, _ = ingest.flatten(fine)
    named = replies.join(posts.select("conv_id", "post_id"), "conv_id")
    return named.select(F.substring("post_id", 2, 40).alias("conversation"), "pos", "reply_id", "account_id", "text", epoch(F.col("created_at")).alias("created_at"))


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as analyses: some of the demo, some running."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    created = F.unix_date(F.col("o_orderdate").cast("date")) * F.lit(86_400).cast("long") + key % 86_400
    return o.select(F.md5(key.cast("string").cast("binary")).alias("analysis_id"), created.alias("created_at"), (key % 11 == 0).alias("demo"), (key % 13 == 0).alias("running"), key.alias("n"))


@query
def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.kept_analyses(_analyses(spark, sf_dir).drop("n"), Config().retention)


@query
def analysis_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running analyses by their run, also where an older one is stored; the others as stored."""
    rows = _analyses(spark, sf_dir)
    runs = rows.where("running").select("analysis_id", F.lit("COMPARING").alias("status"), (F.col("n") % 50).alias("replies"), (F.col("n") % 7).alias("accounts"))
    stored = rows.where("not demo").select("analysis_id", F.lit("COMPLETE").alias("status"), (F.col("n") % 50 + 100).alias("replies"), (F.col("n") % 7 + 10).alias("accounts"))
    return store.status(runs, stored)


@query
def stored_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the names made of the analyses' ids are those of stored graphs."""
    a = _analyses(spark, sf_dir)
    i, k = F.col("analysis_id"), F.col("n") % 4
    name = F.when(k == 0, F.concat(F.lit("lens_"), i)).when(k == 1, F.concat(F.lit("lens_"), F.upper(i))).when(k == 2, F.concat(F.lit("lens_"), F.substring(i, 1, 31)))
    return store.stored_ids(a.select(name.otherwise(F.concat(F.lit("other_"), i)).alias("name")))


@query
def customer_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nodes that take the computed properties of those who have orders."""
    nodes = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment", "c_acctbal")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey"))
    return store.with_properties(nodes, orders.agg(F.max("o_totalprice").alias("c_acctbal"), F.count("*").alias("n_orders")), "c_custkey")


@query
def stored_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a stored table by nation, of which two writes change some nations each, as it reads afterwards."""
    nodes = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"), "c_acctbal")
    path = settle.fresh_path(spark, "customers")
    store.put_stored(nodes, path, "nation")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_custkey", "c_custkey").join(nodes.select("c_custkey", "nation"), "c_custkey")
    by = orders.groupBy("nation", "c_custkey")
    store.upsert(by.agg(F.max("o_totalprice").alias("c_acctbal"), F.count("*").alias("n_orders")).where("nation < 12"), path, "c_custkey", unit="nation")
    urgent = by.agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"), (F.count("*") * 10).alias("n_orders"))
    store.upsert(urgent.where("nation >= 8 and n_urgent > 0"), path, "c_custkey", unit="nation")
    return store.stored(spark, path, "nation").select("c_custkey", "nation", "c_acctbal", "n_orders", "n_urgent")


@query
def clustered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines, both stored in buckets of the order's key, so that neither join nor sums move rows."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("long").alias("quantity"))
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = store.clustered(o, "orders", "k", buckets).join(store.clustered(lines, "order_lines", "k", buckets).hint("merge"), "k")
    return both.groupBy("k", "o_orderpriority").agg(F.count("*").alias("n_lines"), F.sum("quantity").alias("quantity")).withColumnRenamed("k", "o_orderkey")


@query
def completed_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _analyses(spark, sf_dir).drop("n")
    return store.completed(rows, rows.where("not running").select("analysis_id", (F.col("created_at") % 7 / 7.0).alias("score")))


@query
def reset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _analyses(spark, sf_dir).drop("n")
    return store.reset_ids(rows, rows.where("not running"))


# -- pages, streams, scorers


def _saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages of the two sites: even ones as a thread or a feed of posts, odd ones as a post with comments."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    time = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.lit(1704067200) + F.col("turn")), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    tweet = F.format_string(
        '<article data-testid="tweet"><a href="/%s/status/%s"><time datetime="%s"></time></a><div data-testid="tweetText">%s</div></article>', "role", F.col("conv_id") * 1000 + F.col("turn"), time, text
    )
    made = F.lit(1_704_067_200_000) * 4_194_304 + F.col("conv_id") * 1000
    who = F.format_string('<a class="update-components-actor__meta-link" href="/in/%s">%s</a><div class="update-components-text">%s</div>', "role", "role", text)
    comment = F.format_string('<article data-id="urn:li:comment:(activity:%s,%s)">%s</article>', made, made + F.col("turn"), who)
    html = F.when(F.col("conv_id") % 2 == 0, tweet).when(F.col("turn") == 0, who).otherwise(comment)
    pages = t.withColumn("html", html).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "html"))), lambda x: x["html"]), "\n").alias("html"))
    odd = F.col("conv_id") % 2 == 1
    reader = F.when(odd, "linkedin_thread").when(F.col("conv_id") % 4 == 0, "x_thread").otherwise("x_feed")
    card = F.concat(F.format_string('<div data-urn="urn:li:activity:%s">', made), "html", F.lit("</div>"))
    thread = F.when(odd, made.cast("string")).when(F.col("conv_id") % 4 == 0, (F.col("conv_id") * 1000).cast("string"))
    return pages.select(F.col("conv_id").alias("page"), reader.alias("reader"), thread.alias("thread_id"), F.when(odd, card).otherwise(F.col("html")).alias("html"), F.timestamp_seconds(F.lit(1767225600)).alias("now"))


@query
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and replies that the readers find in the pages made of conversations."""
    return pages.read_pages(_saved_pages(spark, sf_dir)).withColumn("created_at", F.unix_millis("created_at"))


@query
def page_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_outline(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as two scans that overlap: the first turn is the post; some texts only come with the second scan, which
    words others anew, and some turns are earlier than the post."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn is not null")
    at = F.timestamp_seconds(1704067200 + F.col("turn") * 10 - F.when(F.col("turn") % 4 == 2, 100).otherwise(0))

    def scan(first: int, handle: Column, text: Column) -> DataFrame:
        return t.select(F.col("conv_id").cast("string"), (F.col("turn") + first).cast("long").alias("seq"), (F.col("turn") == 0).alias("focal"), F.concat(F.lit("t"), "turn").alias("id"), handle.alias("handle"), text.alias("text"), at.alias("created_at"))

    one = scan(0, F.col("role"), F.when(F.col("turn") % 5 != 3, F.col("text")).otherwise(""))
    return one.unionByName(scan(1_000_000, F.upper("role"), F.concat(F.lit("again "), "text")))


@query
def scan_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture.merge_batch(_scans(spark, sf_dir)).withColumn("created_at", F.unix_timestamp("created_at"))


@query
def finished_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _scans(spark, sf_dir)
    post = items.where("focal").groupBy("conv_id").agg(F.max_by(F.struct("id", "handle", "text", "created_at"), "seq").alias("p")).select("conv_id", "p.*")
    posts, replies, accounts = capture.finish_thread(post, capture.merge_batch(items))
    return replies.join(accounts.select("conv_id", "account_id", "username"), ["conv_id", "account_id"]).withColumn("created_at", F.unix_timestamp("created_at"))


@query
def finished_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, _, _ = capture.finish_feed(capture.merge_batch(_scans(spark, sf_dir)), "X", F.timestamp_seconds(F.lit(1704104430)))
    return posts.withColumn("created_at", F.unix_timestamp("created_at"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of items, in conversations of 300 ids, below the cap, that grow in number."""
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/documents.parquet").schema).parquet(f"{sf_dir}/documents.parquet*")
    conv = F.concat_ws("-", F.col("doc_id") % 32, F.floor(F.col("doc_id") / 9_600)).alias("conv_id")
    return source.select(conv, F.col("doc_id").alias("seq"), F.lit(False).alias("focal"), F.concat(F.lit("d"), "doc_id").alias("id"), F.col("source").alias("handle"), "text", F.timestamp_seconds("doc_id").alias("created_at"))


def _streamed(merged: DataFrame, out: str | None = None) -> DataFrame:
    """What a finite stream merges, written where all tasks write; its checkpoint lies beside."""
    out = out or settle.fresh_path(merged.sparkSession, "merged")
    merged.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return merged.sparkSession.read.parquet(out)


@query
def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of scanned items, merged with state; each id is seen once."""
    return _streamed(capture.merge_scans(_items(spark, sf_dir), idle_ms=None)).groupBy("conv_id").agg(F.count("*").alias("items"))


@query
def stopped_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with every 97th document the last before the user stops its conversation."""
    items = _items(spark, sf_dir)
    stops = _items(spark, sf_dir).where("seq % 97 = 50").select("conv_id", "seq")
    return _streamed(capture.merge_scans(items, idle_ms=None, stops=stops)).groupBy("conv_id").agg(F.count("*").alias("items"))


@query
def live_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a capture's state has them, after two scans some of which the user stopped, joined with what it
    wrote: what the state counts is what was taken."""
    scans = _scans(spark, sf_dir)
    folder = settle.fresh_path(spark, "scans")
    scans.write.parquet(folder)
    items = spark.readStream.schema(scans.schema).parquet(f"{folder}*")
    stops = items.where("focal and conv_id % 5 = 2").select("conv_id", (F.col("seq") + 3).alias("seq"))
    out = settle.fresh_path(spark, "merged")
    taken = _streamed(capture.merge_scans(items, idle_ms=None, stops=stops), out).where("kind = 'reply'").groupBy("conv_id").agg(F.count("*").alias("taken"))
    return capture.live_status(spark, f"{out}-state").join(taken, "conv_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))


@query
def typed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed answers made of the documents' ids, mapped in tasks; every thirteenth breaks the contract."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    kinds, n = classify.QUESTIONS["spamType"], F.col("doc_id")
    yes = {q: F.struct(F.lit("noul").alias("type"), F.when((n + 7 * i) % 17 < 2, 0.9).otherwise(0.1).alias("noul")) for i, q in enumerate(classify.YES_NO)}
    auto = n % 97 / 96.0
    choice = F.struct(F.lit("choice").alias("type"), F.when(auto >= 0.5, "automated").otherwise("human").alias("choice"), F.struct(auto.alias("automated"), (1 - auto).alias("human")).alias("probabilities"), F.lit(0.8).alias("confidence"))
    chosen = _dealt(list(kinds), "doc_id")
    spam = F.struct(F.lit("choice").alias("type"), chosen.alias("choice"), F.struct(*[F.when(chosen == k, 0.9).otherwise(0.1 / (len(kinds) - 1)).alias(k) for k in kinds]).alias("probabilities"))
    answer = F.to_json(F.struct(F.struct(choice.alias("automation"), spam.alias("spamType"), *[c.alias(q) for q, c in yes.items()]).alias("answers")))
    return classify.mapped_answers(d.select("doc_id", F.when(n % 13 == 5, '{"answers": {}}').otherwise(answer).alias("answer")), "answer")


@query
def scorer_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer whose answers break the contract: every account falls back and is held at uncertain."""
    a = analysis(spark, sf_dir)
    got = classify.scored(a.requests, a.config, lambda payload: "{}")
    return got.groupBy("label", "source").agg(F.count("*").alias("n"), F.max("confidence").alias("most"))


def _by_name(payload: str) -> str:
    """A stand-in for an external scorer, that goes by the number in an account's name."""
    k = int((json.loads(payload)["username"] or "src0")[3:])
    return json.dumps({"classification": "uncertain", "summary": "by name", "automationLikelihood": k * 4 % 101 / 100, "coordinationLikelihood": 0.1, "confidence": 0.5})


def _unasked(payload: str) -> str:
    raise RuntimeError("all answers should have been kept")


@query
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts scored a second time, by a scorer that answers nothing, from what the first run kept."""
    a = analysis(spark, sf_dir)
    cache = answers.AnswerCache(settle.fresh_path(spark, "answers"), keep=1_000_000)
    classify.scored(a.requests, a.config, _by_name, cache=cache)
    return classify.scored(a.requests, a.config, _unasked, cache=cache).select("conv_id", "account_id", "automation", "label", "source")
