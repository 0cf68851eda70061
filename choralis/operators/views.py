"""What views are made of: filters, groups, badges, texts and nested results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choralis.config import Thresholds
from choralis.functions.exact import label, mean3, percent, round3
from choralis.operators import graph

#: Fixed value: kinds of posting, from personal posts to scams.
CATEGORIES = [
    "personal", "mixed", "too_little_text", "ai_useful", "ai_written", "milestone", "ai_ad", "ai_low_value", "content_farm",
    "generic_comment", "engagement_bait", "follow_farming", "automated", "scam",
]
#: Kinds that can be hidden, those hidden unless asked otherwise, and those "meaningful only" hides.
HIDEABLE = [
    "scam", "engagement_bait", "follow_farming", "generic_comment", "content_farm", "ai_ad", "milestone", "ai_low_value",
    "ai_useful", "ai_written", "automated", "too_little_text", "mixed",
]
HIDDEN = ["scam", "engagement_bait", "follow_farming", "generic_comment", "ai_ad", "ai_low_value", "too_little_text"]
MEANINGFUL_HIDDEN = [c for c in HIDEABLE if c not in ("mixed", "ai_useful")]


def category_or_label(category: Column, name: Column) -> Column:
    by_label = F.when(name == "human_like", "personal").when(name == "uncertain", "mixed").otherwise("automated")
    return F.when(category.isin(CATEGORIES), category).otherwise(by_label)


def passes(show: str, name: Column, cluster_id: Column, coordinated: Column) -> Column:
    """Whether an account passes a filter: all, coordinated or a label."""
    if show == "all":
        return F.lit(True)
    return cluster_id.isNotNull() | (coordinated > 0) if show == "coordinated" else name == show


def hidden_counts(classified: DataFrame, hidden: list[str] = HIDDEN) -> DataFrame:
    """conv_id, category, hidden_posts."""
    kind = category_or_label(F.col("category"), F.col("label"))
    rows = classified.withColumn("category", kind).where(F.col("category").isin(hidden))
    return rows.groupBy("conv_id", "category").agg(F.sum("reply_count").alias("hidden_posts"))


def search(accounts: DataFrame, query: str) -> DataFrame:
    return accounts.where(F.lower(F.concat(F.lit("@"), "username")).contains(query.lower()))


def lookup(accounts: DataFrame, name: str) -> DataFrame:
    """The first account of each conversation with the name, whatever its case."""
    rows = accounts.where(F.lower("username") == name.lower())
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("first_pos"))).where("k = 1").drop("k")


def focus(edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """conv_id, account_id, focus: each of the accounts with its neighbours over drawn edges (source, target)."""
    both = edges.select("conv_id", F.col("source").alias("account_id"), F.col("target").alias("focus"))
    both = both.unionByName(edges.select("conv_id", F.col("target").alias("account_id"), F.col("source").alias("focus")))
    near = both.join(accounts.select("conv_id", "account_id"), ["conv_id", "account_id"], "left_semi")
    return near.unionByName(accounts.select("conv_id", "account_id", F.col("account_id").alias("focus"))).distinct()


def account_edges(similar: DataFrame, coordination: DataFrame) -> DataFrame:
    """Both kinds of edges between accounts: source, target, type, weight, dt."""
    a = similar.select("conv_id", "source", "target", F.lit("SIMILAR").alias("type"), "weight", "dt")
    b = coordination.select("conv_id", "source", "target", F.lit("COORDINATED").alias("type"), F.col("score").alias("weight"), "dt")
    return a.unionByName(b)


def feed_groups(classified: DataFrame) -> DataFrame:
    """conv_id, category, index, members, automation, share: one group for each kind of posting."""
    kind = category_or_label(F.col("category"), F.col("label"))
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    by = classified.withColumn("category", kind).groupBy("conv_id", "category").agg(F.count("*").alias("members"), mean3(F.col("automation")).alias("automation"))
    total = F.sum("members").over(Window.partitionBy("conv_id"))
    return by.select("conv_id", "category", F.row_number().over(Window.partitionBy("conv_id").orderBy(order)).alias("index"), "members", "automation", round3(F.col("members") / total).alias("share"))


def group_members(classified: DataFrame) -> DataFrame:
    kind = category_or_label(F.col("category"), F.col("label"))
    order = Window.partitionBy("conv_id", "category").orderBy(F.desc("automation"), "first_pos")
    return classified.withColumn("category", kind).select("conv_id", "category", "account_id", "automation", F.row_number().over(order).alias("place"))


def common_signals(classified: DataFrame, k: int = 4) -> DataFrame:
    """conv_id, category, signal, n: the signals most accounts of a group have, without their percentages."""
    plain = F.array_distinct(F.transform("signals_for", lambda s: F.regexp_replace(s, r"\s*\(\d+%\)$", "")))
    rows = classified.withColumn("category", category_or_label(F.col("category"), F.col("label"))).select("conv_id", "category", F.explode(plain).alias("signal"))
    n = rows.groupBy("conv_id", "category", "signal").agg(F.count("*").alias("n"))
    order = Window.partitionBy("conv_id", "category").orderBy(F.desc("n"), "signal")
    return n.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def badges(classified: DataFrame, replies: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row for each reply: its account's label, likelihoods and cluster index."""
    c = members.select("conv_id", "account_id", "cluster_id").join(clusters.select("conv_id", "cluster_id", F.col("index").alias("cluster")), ["conv_id", "cluster_id"])
    a = classified.select("conv_id", "account_id", "username", "label", "automation", "coordination")
    return replies.select("conv_id", "reply_id", "account_id").join(a, ["conv_id", "account_id"]).join(c, ["conv_id", "account_id"], "left").select(
        "conv_id", "reply_id", "username", "label", "automation", "coordination", "cluster"
    )


def reveal_order(graph: DataFrame) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("first_seconds", "first_pos")
    return graph.select("conv_id", "account_id", F.row_number().over(order).alias("place"))


def account_replies(replies: DataFrame, similar: DataFrame, timing: DataFrame, accounts: DataFrame) -> DataFrame:
    """conv_id, account_id, replies: structs in the order of time; accounts without one have an empty list."""
    r = replies.join(similar.select("conv_id", "pos", "near_duplicate"), ["conv_id", "pos"]).join(timing.select("conv_id", "pos", "seconds_after"), ["conv_id", "pos"])
    by = r.groupBy("conv_id", "account_id").agg(F.sort_array(F.collect_list(F.struct("seconds_after", "pos", "reply_id", "text", "near_duplicate"))).alias("replies"))
    return accounts.select("conv_id", "account_id").join(by, ["conv_id", "account_id"], "left").withColumn("replies", F.coalesce("replies", F.array().cast(by.schema["replies"].dataType)))


def graph_counts(a) -> DataFrame:
    """conv_id with the numbers of accounts, replies, coordination edges and clusters, 0 where there are none."""
    def n(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("conv_id").agg(F.count("*").alias(name))

    out = a.posts.select("conv_id")
    for df, name in ((a.accounts, "accounts"), (a.replies, "replies"), (a.coordination, "edges"), (a.clusters, "clusters")):
        out = out.join(n(df, name), "conv_id", "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("accounts", "replies", "edges", "clusters")])


def result_line(classified: DataFrame, clusters: DataFrame, scores: DataFrame) -> DataFrame:
    """conv_id and one line that sums an analysis up."""
    def count(name: str) -> Column:
        return F.count(F.when(F.col("label") == name, 1)).alias(name)

    by = classified.groupBy("conv_id").agg(F.count("*").alias("n"), count("human_like"), count("uncertain"), count("automation_like"))
    c = clusters.groupBy("conv_id").agg(F.count("*").alias("c"))
    out = by.join(c, "conv_id", "left").join(scores.select("conv_id", "score"), "conv_id").withColumn("c", F.coalesce("c", F.lit(0)))
    line = F.format_string("%d accounts: %d human-like, %d uncertain, %d automation-like · %d clusters · score %s. Experimental heuristic, not ground truth.", "n", "human_like", "uncertain", "automation_like", "c", percent(F.col("score")))
    return out.select("conv_id", line.alias("line"))


def duration_text(seconds: Column) -> Column:
    return (
        F.when(seconds < 90, F.concat(F.floor(seconds + 0.5).cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60 + 0.5).cast("string"), F.lit(" min")))
        .otherwise(F.format_string("%.1f h", seconds / 3600))
    )


def age_text(days: Column) -> Column:
    return (
        F.when(days.isNull(), "account metadata not available")
        .when(days >= 365, F.format_string("%.1f years old", days / 365.0))
        .otherwise(F.concat(days.cast("string"), F.lit(" days old")))
    )


def ranked_members(classified: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, cluster_id, account_id, automation, place: a cluster's accounts, the most automated first."""
    order = Window.partitionBy("conv_id", "cluster_id").orderBy(F.desc("automation"), "first")
    rows = members.withColumnRenamed("place", "first").join(classified.select("conv_id", "account_id", "automation"), ["conv_id", "account_id"])
    return rows.select("conv_id", "cluster_id", "account_id", "automation", F.row_number().over(order).alias("place"))


def account_details(a) -> DataFrame:
    """One account's page: its classification, cluster, replies in the order of time, nearest replies of others,
    coordinated accounts by score, and how many accounts two hops reach."""
    key = ["conv_id", "account_id"]

    def listed(df: DataFrame, name: str, *cols: str) -> DataFrame:
        return df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))

    out = a.classified.select(*key, "username", "label", "category", "automation", "coordination", "confidence", "summary", "signals_for", "signals_against")
    out = out.withColumnRenamed("coordination", "coordination_score").join(a.members.select(*key, "cluster_id"), key, "left")
    out = out.join(account_replies(a.replies, a.similar, a.timing, a.accounts), key)
    out = out.join(listed(graph.account_similar(a.top_edges, a.replies), "similar", "place", "reply_id", "other", "other_reply", "sim", "dt"), key, "left")
    out = out.join(listed(graph.coordinated_neighbours(a.coordination), "coordinated", "place", "other", "score", "dt"), key, "left")
    return out.join(graph.reach(a.coordination, a.accounts), key)


def cluster_details(a) -> DataFrame:
    """One cluster's page: members by automation, phrases, density, means over its edges and its likelihoods."""
    key = ["conv_id", "cluster_id"]
    ranked = ranked_members(a.classified, a.members).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", "account_id", "automation"))).alias("accounts"))
    told = graph.cluster_phrases(a.members, a.replies, a.patterns).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", "text", "uses"))).alias("phrases"))
    out = ranked.join(told, key, "left").join(graph.cluster_density(a.coordination, a.members), key)
    return out.join(graph.cluster_stats(a.coordination, a.members, a.timing, a.classified), key, "left")


def cluster_label(automation: Column, t: Thresholds = Thresholds(), sensitivity: float = 50) -> Column:
    at = t.at(sensitivity)
    return label(automation, at.human, at.automation)


def sent_text(text: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(text, 1, 5000), F.lit("")), F.lit("(post without text)"))


def node_size(degree: Column, replies: Column, n: Column) -> Column:
    density = F.least(F.greatest(F.sqrt(90 / n), F.lit(0.5)), F.lit(1.0))
    return (5.5 + 2.1 * F.sqrt(degree + replies)) * (0.55 + 0.45 * density)


def graph_view(a) -> DataFrame:
    """conv_id and the nested result as JSON: accounts, edges, clusters, score."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        cols = [c for c in df.columns if c != "conv_id"]
        return df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))

    accounts = a.classified.select("conv_id", "account_id", "username", "label", "automation", "coordination", "confidence", "category", "degree", "reply_count")
    out = a.posts.select("conv_id", "kind", "post_id")
    for df, name in ((accounts, "accounts"), (account_edges(a.similar_accounts, a.coordination), "edges"), (a.clusters, "clusters")):
        out = out.join(listed(df, name), "conv_id", "left")
    out = out.join(a.scores, "conv_id", "left")
    return out.select("conv_id", F.to_json(F.struct(*[c for c in out.columns if c != "conv_id"])).alias("view"))


#: What `graph_view` writes, but for fields that nobody reads back.
VIEW = """accounts array<struct<account_id: string, label: string, automation: double, coordination: double, degree: long, reply_count: long>>,
  edges array<struct<source: string, target: string, type: string, weight: double, dt: long>>,
  clusters array<struct<cluster_id: string, size: long, index: long>>, score double, automation_share double"""


def view_parts(view: DataFrame) -> DataFrame:
    """conv_id, part, id, other, kind, x, y, m, n: the accounts, edges, clusters and the score of graph views, read back from
    their JSON. Fields that a view leaves out, as JSON does with nulls, are null; a view without accounts has none here."""
    v = view.select("conv_id", F.from_json("view", VIEW).alias("v")).select("conv_id", "v.*")
    text, num, whole = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("long")

    def part(name: str, rows: DataFrame, *cols: Column) -> DataFrame:
        return rows.select("conv_id", F.lit(name).alias("part"), *[c.alias(n) for n, c in zip(("id", "other", "kind", "x", "y", "m", "n"), cols, strict=True)])

    def each(name: str) -> DataFrame:
        return v.select("conv_id", F.inline(name))

    a = part("account", each("accounts"), F.col("account_id"), text, F.col("label"), F.col("automation"), F.col("coordination"), F.col("degree"), F.col("reply_count"))
    e = part("edge", each("edges"), F.col("source"), F.col("target"), F.col("type"), F.col("weight"), num, F.col("dt"), whole)
    c = part("cluster", each("clusters"), F.col("cluster_id"), text, text, num, num, F.col("size"), F.col("index"))
    s = part("score", v, text, text, text, F.col("score"), F.col("automation_share"), whole, whole)
    return a.unionByName(e).unionByName(c).unionByName(s)
