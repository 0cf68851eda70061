"""The property graph: components, neighbourhoods, paths and the reads that views are made of."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choralis.functions.exact import mean3, round3
from choralis.functions.settle import settled
from choralis.operators.coordination import directed


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Union-find over the edges (source, target) of one conversation."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(rows["source"], rows["target"], strict=True):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = sorted(parent)
    return pd.DataFrame({"conv_id": rows["conv_id"].iloc[0], "account_id": found, "component": [root(x) for x in found]})


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, account_id, component: the least account id that coordination connects with it.

    Conversations are capped, so each is settled by union-find in one pass over its edges; accounts without an edge are
    a component each and never reach Python.
    """

    kind = edges.schema["conv_id"].dataType.simpleString()
    linked = edges.select("conv_id", "source", "target").groupBy("conv_id").applyInPandas(_settle, f"conv_id {kind}, account_id string, component string")
    return nodes.select("conv_id", "account_id").join(linked, ["conv_id", "account_id"], "left").withColumn("component", F.coalesce("component", "account_id"))


def components_iterative(nodes: DataFrame, edges: DataFrame, finish: int = 100_000) -> DataFrame:
    """The same for graphs of any size, by contraction until no edge is left.

    In each round a node takes the name of the node of the least rank among itself and its neighbours, ranks being hashes
    that change by round, so long chains shrink by a share each time, too; then edges are renamed, and loops and repeated
    edges go. Names are only exchanged among the nodes that still have edges. There is no bound on rounds: each one with an
    edge left merges at least two nodes. Rounds are checkpointed. Once at most `finish` edges are left, one group of
    `components`' union-find ends the work instead; 0 leaves all to rounds.
    """
    kind = edges.schema["conv_id"].dataType.simpleString()
    now = edges.where("source <> target").select("conv_id", F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    names, turn = [], 0
    while True:
        now = settled(now)
        left = now.limit(finish + 1).count()
        if left == 0:
            break
        if left <= finish:
            few = now.select("conv_id", F.col("a").alias("source"), F.col("b").alias("target"))
            names.append(settled(few.repartition(1).groupBy("conv_id").applyInPandas(_settle, f"conv_id {kind}, account_id string, component string")).toDF("conv_id", "a", "to"))
            break
        both = now.unionByName(now.select("conv_id", F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.unionByName(both.select("conv_id", "a", F.col("a").alias("b")))
        took = settled(near.groupBy("conv_id", "a").agg(F.min_by("b", F.struct(F.xxhash64("b", F.lit(turn)), "b")).alias("to")))
        names.append(took)
        one = now.join(took, ["conv_id", "a"]).select("conv_id", F.col("to").alias("x"), F.col("b").alias("a"))
        now = one.join(took, ["conv_id", "a"]).where("x <> to").select("conv_id", F.least("x", "to").alias("a"), F.greatest("x", "to").alias("b")).distinct()
        turn += 1
    # a node's last name, found from the last round back: what a round's names came to be called later
    last = None
    for took in reversed(names):
        if last is not None:
            later = last.select("conv_id", F.col("a").alias("to"), F.col("to").alias("then"))
            took = settled(took.join(later, ["conv_id", "to"], "left").select("conv_id", "a", F.coalesce("then", "to").alias("to")))
        last = took
    known = nodes.select("conv_id", F.col("account_id").alias("a"))
    if last is None:
        return known.select("conv_id", F.col("a").alias("account_id"), F.col("a").alias("component"))
    led = known.join(last, ["conv_id", "a"], "left").withColumn("to", F.coalesce("to", "a"))
    least = led.groupBy("conv_id", "to").agg(F.min("a").alias("component"))
    return led.join(least, ["conv_id", "to"]).select("conv_id", F.col("a").alias("account_id"), "component")


def account_links(edges: DataFrame) -> DataFrame:
    """conv_id, account_id, similarity (mean), links, max_score over an account's coordination edges."""
    return directed(edges).groupBy("conv_id", "account_id").agg(F.avg("text_similarity").alias("similarity"), F.count("*").alias("links"), F.max("score").alias("max_score"))


def similar_accounts(top: DataFrame, replies: DataFrame) -> DataFrame:
    """conv_id, source, target, weight, dt: accounts joined by similarity edges of their replies, source < target."""
    who = replies.select("conv_id", "pos", "account_id")
    met = top.join(who.withColumnsRenamed({"pos": "i", "account_id": "x"}), ["conv_id", "i"]).join(who.withColumnsRenamed({"pos": "j", "account_id": "y"}), ["conv_id", "j"])
    met = met.where(F.col("x") != F.col("y"))
    return met.groupBy("conv_id", F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target")).agg(round3(F.max("sim")).alias("weight"), F.min("dt").alias("dt"))


def graph_features(features: DataFrame, edges: DataFrame, similar: DataFrame, parts: DataFrame) -> DataFrame:
    """Component, its size and mean of its accounts' means, partners, strongest link, similar accounts and degree."""
    links = account_links(edges)
    size = F.count("*").over(Window.partitionBy("conv_id", "component"))
    mean = F.avg("similarity").over(Window.partitionBy("conv_id", "component"))
    sym = similar.select("conv_id", F.col("source").alias("account_id"), F.col("target").alias("other"))
    sym = sym.unionByName(similar.select("conv_id", F.col("target").alias("account_id"), F.col("source").alias("other")))
    alike = sym.groupBy("conv_id", "account_id").agg(F.collect_set("other").alias("alike"))
    partners = directed(edges).groupBy("conv_id", "account_id").agg(F.collect_set("other").alias("partners"))
    none = F.array().cast("array<string>")
    out = parts.join(links, ["conv_id", "account_id"], "left").withColumn("component_size", size).withColumn("mean", mean)
    out = out.join(alike, ["conv_id", "account_id"], "left").join(partners, ["conv_id", "account_id"], "left")
    out = out.join(features.select("conv_id", "account_id", "reply_count", "first_seconds", "first_pos"), ["conv_id", "account_id"])
    alike_, partners_ = F.coalesce("alike", none), F.coalesce("partners", none)
    return out.select(
        "conv_id", "account_id", "component", "component_size", round3(F.coalesce("mean", F.lit(0.0))).alias("component_similarity"),
        F.size(partners_).alias("coordinated"), F.coalesce("max_score", F.lit(0.0)).alias("max_score"), F.size(alike_).alias("similar"),
        (F.size(F.array_except(alike_, partners_)) + F.size(partners_) + F.col("reply_count")).alias("degree"), "first_seconds", "first_pos",
    )


def clusters(graph: DataFrame, least: int) -> DataFrame:
    """conv_id, component, cluster_id, index, size of components with enough accounts; the largest first, ties by the
    member that comes first in the order of first reply."""
    order = Window.partitionBy("conv_id").orderBy("first_seconds", "first_pos")
    placed = graph.withColumn("place", F.row_number().over(order))
    big = placed.groupBy("conv_id", "component").agg(F.count("*").alias("size"), F.min("place").alias("place")).where(F.col("size") >= least)
    index = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("size"), "place"))
    return big.withColumn("index", index).select("conv_id", "component", F.format_string("cluster_%02d", "index").alias("cluster_id"), "index", "size")


def members(graph: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, cluster_id, account_id, place: a cluster's accounts in the order of their first reply."""
    order = Window.partitionBy("conv_id", "cluster_id").orderBy("first_seconds", "first_pos")
    return graph.join(found, ["conv_id", "component"]).select("conv_id", "cluster_id", "account_id", F.row_number().over(order).alias("place"))


def internal_edges(edges: DataFrame, in_cluster: DataFrame) -> DataFrame:
    m = in_cluster.select("conv_id", "account_id", "cluster_id")
    a = m.withColumnsRenamed({"account_id": "source"})
    b = m.withColumnsRenamed({"account_id": "target", "cluster_id": "other_cluster"})
    return edges.join(a, ["conv_id", "source"]).join(b, ["conv_id", "target"]).where(F.col("cluster_id") == F.col("other_cluster"))


def cluster_density(edges: DataFrame, in_cluster: DataFrame) -> DataFrame:
    """conv_id, cluster_id, size, internal_edges, density."""
    n = in_cluster.groupBy("conv_id", "cluster_id").agg(F.count("*").alias("size"))
    e = internal_edges(edges, in_cluster).groupBy("conv_id", "cluster_id").agg(F.count("*").alias("internal_edges"))
    e = n.join(e, ["conv_id", "cluster_id"], "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0)))
    possible = F.col("size") * (F.col("size") - 1) / 2.0
    return e.withColumn("density", F.when(F.col("size") < 2, 0.0).otherwise(round3(F.col("internal_edges") / F.nullif(possible, F.lit(0.0)))))


def cluster_stats(edges: DataFrame, in_cluster: DataFrame, timing: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """Means over internal edges, and first and span of the evidence replies' times; over members their likelihoods."""
    inner = internal_edges(edges, in_cluster)
    means = inner.groupBy("conv_id", "cluster_id").agg(mean3(F.col("text_similarity")).alias("similarity"), mean3(F.col("score")).alias("score"))
    seen = inner.select("conv_id", "cluster_id", F.explode(F.array("source_reply", "target_reply")).alias("reply_id")).distinct()
    times = seen.join(timing.select("conv_id", "reply_id", "seconds_after"), ["conv_id", "reply_id"])
    times = times.groupBy("conv_id", "cluster_id").agg(F.min("seconds_after").alias("first_seconds"), (F.max("seconds_after") - F.min("seconds_after")).alias("span_seconds"))
    out = means.join(times, ["conv_id", "cluster_id"])
    if classified is not None:
        rows = in_cluster.join(classified.select("conv_id", "account_id", "automation", "coordination"), ["conv_id", "account_id"])
        out = out.join(rows.groupBy("conv_id", "cluster_id").agg(mean3(F.col("automation")).alias("automation"), mean3(F.col("coordination")).alias("coordination")), ["conv_id", "cluster_id"])
    return out


def cluster_phrases(in_cluster: DataFrame, replies: DataFrame, found: DataFrame, k: int = 3) -> DataFrame:
    """conv_id, cluster_id, rank, text: a cluster's phrases by uses times words; equal ones by pattern rank."""
    rows = in_cluster.join(replies.select("conv_id", "account_id", "reply_id"), ["conv_id", "account_id"])
    use = rows.join(found.select("conv_id", "rank", "text", F.explode("reply_set").alias("reply_id")), ["conv_id", "reply_id"])
    use = use.groupBy("conv_id", "cluster_id", "rank", "text").agg(F.count("*").alias("uses"))
    order = Window.partitionBy("conv_id", "cluster_id").orderBy(F.desc(F.col("uses") * F.size(F.split("text", " "))), "rank")
    return use.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("conv_id", "cluster_id", "place", "text", "uses")


def reach(edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """conv_id, account_id, reach: distinct other accounts within two coordination edges."""
    e = directed(edges).select("conv_id", "account_id", "other").distinct()
    two = e.join(e.select("conv_id", F.col("account_id").alias("other"), F.col("other").alias("far")), ["conv_id", "other"]).select("conv_id", "account_id", F.col("far").alias("other"))
    met = e.unionByName(two).where(F.col("account_id") != F.col("other")).distinct()
    n = met.groupBy("conv_id", "account_id").agg(F.count("*").alias("reach"))
    return accounts.select("conv_id", "account_id").join(n, ["conv_id", "account_id"], "left").withColumn("reach", F.coalesce("reach", F.lit(0)))


def account_similar(top: DataFrame, replies: DataFrame, k: int = 5) -> DataFrame:
    """conv_id, account_id, place, reply_id, other, other_reply, sim, dt: each account's nearest replies of others."""
    who = replies.select("conv_id", "pos", "reply_id", "account_id")
    met = top.join(who.withColumnsRenamed({"pos": "i", "reply_id": "ri", "account_id": "x"}), ["conv_id", "i"])
    met = met.join(who.withColumnsRenamed({"pos": "j", "reply_id": "rj", "account_id": "y"}), ["conv_id", "j"]).where(F.col("x") != F.col("y"))

    def one(a: str, b: str, ra: str, rb: str) -> DataFrame:
        return met.select("conv_id", F.col(a).alias("account_id"), F.col(ra).alias("reply_id"), F.col(b).alias("other"), F.col(rb).alias("other_reply"), round3(F.col("sim")).alias("sim"), "dt")

    order = Window.partitionBy("conv_id", "account_id").orderBy(F.desc("sim"), "dt", "reply_id", "other_reply")
    both = one("x", "y", "ri", "rj").unionByName(one("y", "x", "rj", "ri"))
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def coordinated_neighbours(edges: DataFrame) -> DataFrame:
    order = Window.partitionBy("conv_id", "account_id").orderBy(F.desc("score"), "other")
    return directed(edges).select("conv_id", "account_id", "other", "score", "dt").withColumn("place", F.row_number().over(order))


def behaviour_edges(replies: DataFrame, top: DataFrame, edges: DataFrame) -> DataFrame:
    """conv_id, a, b, kind, weight over nodes `a:<account>` and `r:<reply>`, in both directions."""
    who = replies.select("conv_id", "pos", "reply_id")
    posted = replies.select("conv_id", F.concat(F.lit("a:"), "account_id").alias("a"), F.concat(F.lit("r:"), "reply_id").alias("b"), F.lit("POSTED").alias("kind"))
    sim = top.join(who.withColumnsRenamed({"pos": "i", "reply_id": "x"}), ["conv_id", "i"]).join(who.withColumnsRenamed({"pos": "j", "reply_id": "y"}), ["conv_id", "j"])
    sim = sim.select("conv_id", F.concat(F.lit("r:"), "x").alias("a"), F.concat(F.lit("r:"), "y").alias("b"), F.lit("SIMILAR_TO").alias("kind"))
    coord = edges.select("conv_id", F.concat(F.lit("a:"), "source").alias("a"), F.concat(F.lit("a:"), "target").alias("b"), F.lit("COORDINATED_WITH").alias("kind"))
    one = posted.unionByName(sim).unionByName(coord)
    return one.unionByName(one.select("conv_id", F.col("b").alias("a"), F.col("a").alias("b"), "kind"))


def shortest_paths(wanted: DataFrame, links: DataFrame, longest: int = 12) -> DataFrame:
    """conv_id, source, target, length, path (nodes) for the wanted pairs of accounts that at most `longest` links connect;
    of several shortest paths the least, node by node.

    All pairs advance together, from both ends in turn, the smaller frontier first; what a search meets grows with the
    power of its depth, and each side goes half as deep. A side holds, of each pair and node that it has met, the least of
    the shortest paths to it (from the target: from it), so the least path over all nodes at which the newest frontier
    meets the other side is the least of all. A pair leaves both sides once it is found.
    """
    key = ["conv_id", "source", "target"]
    step_to = settled(links.select("conv_id", F.col("a").alias("node"), F.col("b").alias("next")).distinct())  # in both directions
    pairs = wanted.select(*key).distinct().where(F.col("source") != F.col("target"))

    def start(end: str) -> DataFrame:
        return settled(pairs.select(*key, F.concat(F.lit("a:"), end).alias("node"))).withColumn("path", F.array("node"))

    fronts, seen = [start("source"), start("target")], [start("source"), start("target")]
    sizes, found = [0, 0], None
    for n in range(1, longest + 1):
        k = 0 if sizes[0] <= sizes[1] else 1
        step = fronts[k].join(step_to, ["conv_id", "node"])
        grown = F.concat("path", F.array("next")) if k == 0 else F.concat(F.array("next"), "path")
        step = step.select(*key, F.col("next").alias("node"), grown.alias("path")).groupBy(*key, "node").agg(F.min("path").alias("path"))
        step = settled(step.join(seen[k].select(*key, "node"), [*key, "node"], "left_anti"))
        sizes[k] = step.count()
        if sizes[k] == 0:
            break  # no pair that is left has more to meet on this side
        other = seen[1 - k].select(*key, "node", F.col("path").alias("far"))
        first, second = ("path", "far") if k == 0 else ("far", "path")
        whole = F.concat(F.col(first), F.slice(F.col(second), 2, longest + 1))
        hit = settled(step.join(other, [*key, "node"]).groupBy(*key).agg(F.min(whole).alias("path")))
        told = hit.select(*key, F.lit(n).alias("length"), "path")
        found = told if found is None else found.unionByName(told)
        gone = hit.select(*key)
        seen[k] = settled(seen[k].unionByName(step).join(gone, key, "left_anti"))
        seen[1 - k] = seen[1 - k].join(gone, key, "left_anti")
        fronts[k] = step.join(gone, key, "left_anti")
        fronts[1 - k] = fronts[1 - k].join(gone, key, "left_anti")
    if found is None:
        return pairs.select(*key, F.lit(0).alias("length"), F.array("source").alias("path")).limit(0)
    return found


def path_steps(paths: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each step: from, to, kind and its wording."""
    rows = paths.select("conv_id", "source", "target", "path", F.explode(F.sequence(F.lit(0), F.size("path") - 2)).alias("step"))
    rows = rows.select("conv_id", "source", "target", "step", F.get("path", F.col("step")).alias("a"), F.get("path", F.col("step") + 1).alias("b"))
    kinds = links.groupBy("conv_id", "a", "b").agg(F.min("kind").alias("kind"))
    out = rows.join(kinds, ["conv_id", "a", "b"])
    return out.withColumn("wording", step_wording(F.col("kind"), F.col("a")))


def step_wording(kind: Column, start: Column) -> Column:
    return F.when((kind == "POSTED") & start.startswith("r:"), "POSTED BY").otherwise(kind)
