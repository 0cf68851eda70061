"""Nearness in time and similarity above a bound, against plain loops."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from choralis.config import Config
from choralis.operators import coordination, intervals, similarity
from choralis.plans.analysis import Analysis


def test_interval_join_meets_each_pair_once(spark):
    rng = random.Random(1)
    a = [(i, rng.choice(["hot", "hot", "x", None]), rng.choice([None, *range(-40, 900)])) for i in range(300)]
    b = [(i, rng.choice(["hot", "x", None]), rng.choice([None, *range(-40, 900)])) for i in range(200)]
    left = spark.createDataFrame(a + a[:9], "bucket int, k string, ta long")
    right = spark.createDataFrame(b, "Bucket_ int, k string, tb long")
    for most in (0, 1, 17, 5000):
        got = intervals.interval_join(left, right, ["k"], "ta", "tb", most)
        assert got.columns == ["k", "bucket", "ta", "Bucket_", "tb"]
        want = Counter((x, y) for x, k, s in a + a[:9] for y, q, t in b if k is not None and k == q and None not in (s, t) and abs(s - t) <= most)
        assert Counter((r.bucket, r.Bucket_) for r in got.collect()) == want
    assert intervals.interval_join(left.limit(0), right, ["k"], "ta", "tb", 9).count() == 0


@pytest.mark.parametrize("span", [None, 1, 7, 1000])
def test_near_counts_are_those_of_a_value_range(spark, span):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot"] * 8 + ["x", None]), rng.choice([None, *range(-20, 400)])) for i in range(500)]
    rows += rows[:30]
    got = intervals.near_counts(spark.createDataFrame(rows, "id int, own string, span long"), ["own"], "span", {"near": 5, "Home": 31}, span)
    assert got.columns == ["id", "own", "span", "near", "Home"]

    def count(k, t, reach):
        return None if None in (k, t) else sum(k == q and s is not None and abs(s - t) <= reach for _, q, s in rows) - 1

    assert Counter(map(tuple, got.collect())) == Counter((i, k, t, count(k, t, 5), count(k, t, 31)) for i, k, t in rows)


def conversation(rng, n, kinds=60):
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(kinds * 20)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 14))) for _ in range(n)]
    for i in range(0, n, 5):
        texts[i] = " ".join(w if rng.random() < 0.85 else "new" for w in texts[rng.randrange(n)].split())
    return texts


@pytest.fixture(scope="module")
def spoken(spark):
    """One conversation above the usual bound of 400 replies, a small one and one of a single reply."""
    rng = random.Random(3)
    rows = [("big", i, t) for i, t in enumerate(conversation(rng, 450))] + [("small", i, t) for i, t in enumerate(["", "a b", "a b", "!!", "a c d"])] + [("one", 0, "a b")]
    replies = spark.createDataFrame(rows, "conv_id string, pos int, text string").withColumn("reply_id", F.concat("conv_id", "pos")).withColumn("account_id", F.concat(F.lit("u"), F.col("pos") % 40))
    words = similarity.kept(similarity.tokenised(replies), "test-words")
    return replies, words, similarity.kept(similarity.ordered_weights(words), "test-weights"), similarity.tfidf_pairs(words).collect()


@pytest.mark.parametrize("least", [0.93, 0.72, 0.545, 0.1])
def test_threshold_join_equals_all_pairs(spoken, least):
    _, _, weights, pairs = spoken
    got = {(r.conv_id, r.i, r.j): r.sim for r in similarity.threshold_pairs(weights, least).collect()}
    want = {(r.conv_id, r.i, r.j): r.sim for r in pairs if r.sim >= least}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-11) for k in got)


def test_threshold_join_sums_few_of_the_pairs_that_share_a_term(spoken):
    _, _, weights, pairs = spoken
    index = similarity._indexed(weights, 0.72)
    a = index.select("conv_id", "t", F.col("pos").alias("i"))
    met = a.join(a.withColumnRenamed("i", "j"), ["conv_id", "t"]).where("i < j").select("conv_id", "i", "j").distinct().count()
    assert met < len(pairs) / 2  # texts of a small vocabulary; of longer ones far fewer meet


def test_best_matches_are_the_greatest_of_all_pairs(spoken):
    _, _, weights, pairs = spoken
    best = {}
    for r in pairs:
        for i, j in ((r.i, r.j), (r.j, r.i)):
            if r.sim > 0:
                best[r.conv_id, i] = max(best.get((r.conv_id, i), (-1, 0)), (r.sim, -j))
    got = {(r.conv_id, r.pos): (r.best, -r.best_pos) for r in similarity.best_matches(weights).collect()}
    assert got.keys() == best.keys()
    assert all(math.isclose(got[k][0], best[k][0], abs_tol=1e-11) and got[k][1] == best[k][1] for k in got)


def test_coordination_by_time_alone_equals_the_unpruned_plan(spark, spoken):
    replies, words, _, _ = spoken
    rng = random.Random(4)
    when = spark.createDataFrame([(f"{c}{i}", rng.randrange(900_000)) for c, n in (("big", 450), ("small", 5), ("one", 1)) for i in range(n)], "reply_id string, ms long")
    r = replies.join(when, "reply_id").withColumn("created_at", F.timestamp_millis("ms"))
    accounts = r.groupBy("conv_id", "account_id").agg(F.min("pos").alias("first_pos"))
    none = r.limit(0).select("conv_id", "reply_id", F.array(F.lit(1)).alias("pattern_ranks"))
    config = Config(text_weight=0.3, timing_weight=0.6, pattern_weight=0.1, coordinated=0.69)
    assert config.least_similarity is None and config.most_seconds is not None
    pairs = similarity.kept(similarity.tfidf_pairs(words), "test-pairs")
    fast, slow = (Counter(map(tuple, coordination.coordination_edges(pairs, r, accounts, none, config, prune).collect())) for prune in (True, False))
    assert fast == slow and len(fast) > 50


def test_only_long_conversations_need_an_index_of_terms(spark, spoken, monkeypatch):
    replies, _, _, pairs = spoken
    accounts = replies.select("conv_id", "account_id", *[F.lit(1).alias(c) for c in ("account_age_days", "followers", "following", "total_posts")])
    indexed, index = [], similarity.ordered_weights
    monkeypatch.setattr(similarity, "ordered_weights", lambda words: indexed.append({r.conv_id for r in words.select("conv_id").distinct().collect()}) or index(words))
    for block, long in ((similarity.BLOCK, {"big"}), (450, None)):
        monkeypatch.setattr(similarity, "BLOCK", block)
        a = Analysis(replies.limit(0), replies, accounts)
        best = {}
        for r in pairs:
            for i, j in ((r.i, r.j), (r.j, r.i)):
                best[r.conv_id, i] = max(best.get((r.conv_id, i), (-1, 0)), (r.sim, -j))
        got = {(r.conv_id, r.pos): (r.best, -r.best_pos) for r in a.matches.collect()}
        assert got.keys() == best.keys()
        assert all(math.isclose(got[k][0], best[k][0], abs_tol=1e-11) and got[k][1] == best[k][1] for k in got)
        close = {(r.conv_id, r.i, r.j): r.sim for r in a.close(0.545).collect()}
        want = {(r.conv_id, r.i, r.j): r.sim for r in pairs if r.sim >= 0.545}
        assert close.keys() == want.keys() and all(math.isclose(close[k], want[k], abs_tol=1e-11) for k in close)
        assert indexed == ([long] if long else [])
        indexed.clear()
