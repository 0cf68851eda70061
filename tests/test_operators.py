"""Operators on literal conversations, and against a plain Python version."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from choralis.config import Config, Thresholds
from choralis.functions import signals, text
from choralis.functions.exact import spark_pattern
from choralis.operators import classify, coordination, graph, phrases, similarity, timing
from choralis.plans.analysis import Analysis

POSTED = datetime(2024, 1, 1, tzinfo=timezone.utc)


def build(spark, rows, kind="thread"):
    """posts, replies and accounts of (conv_id, account_id, text, seconds)."""
    seen = defaultdict(int)
    replies, accounts = [], {}
    for conv, who, words, at in rows:
        pos = seen[conv]
        seen[conv] += 1
        replies.append((conv, pos, f"r{pos:03d}", who, words, POSTED + timedelta(seconds=at)))
        accounts.setdefault((conv, who), (conv, who, who, pos, None, None, None, None))
    posts = [(c, kind, f"post{c}", "root", "agents will change software", POSTED) for c in seen]
    return (
        spark.createDataFrame(posts, "conv_id string, kind string, post_id string, author string, text string, created_at timestamp"),
        spark.createDataFrame(replies, "conv_id string, pos int, reply_id string, account_id string, text string, created_at timestamp"),
        spark.createDataFrame(list(accounts.values()), "conv_id string, account_id string, username string, first_pos int, account_age_days int, followers int, following int, total_posts int"),
    )


def norm(spark, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.normalised(F.col("t"))).collect()]


def test_normalisation(spark):
    got = norm(spark, ["They’re right, it's here", "ＡＩ agents", "AI agents", "  !!! ", None, "See https://a.b/c @me — NOW"])
    assert got == ["theyre right its here", "ai agents", "ai agents", "", "", "see now"]


def test_shingles_and_diversity(spark):
    row = spark.sql("select array('a','b','c','d') x, array('a','b') y, array('this','this','is','it') z, cast(array() as array<string>) e").select(
        text.shingles(F.col("x"), 3), text.shingles(F.col("y"), 3), text.lexical_diversity(F.col("z")), text.lexical_diversity(F.col("e"))
    ).first()
    assert list(row) == [["a b c", "b c d"], [], 0.75, 0.0]


def test_ascii_boundary(spark):
    n = spark.sql("select 'greaté a great day égreat' t").select(F.regexp_count("t", F.lit(spark_pattern(r"\bgreat\b")))).first()[0]
    assert n == 3


def test_timing_regularity(spark):
    cases = {"[0,10,20]": None, "[0,10,20,30,40]": 1.0, "[5,5,5,5]": 1.0}
    for times, want in cases.items():
        assert spark.sql(f"select array{times.replace('[', '(').replace(']', ')')} t").select(timing.regularity(F.col("t"))).first()[0] == want
    assert spark.sql("select array(0,1,2,300) t").select(timing.regularity(F.col("t"))).first()[0] < 0.3


def test_coordination_score(spark):
    c = Config()
    rows = spark.createDataFrame([(0.8, 0.5, 1.0), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)], "t double, m double, p double")
    got = [r[0] for r in rows.select(coordination.coordination_score(F.col("t"), F.col("m"), F.col("p"), c)).collect()]
    assert got == [0.74, 1.0, 0.0]


def test_bounds_and_thresholds():
    assert Config().least_similarity == pytest.approx(0.5445, abs=1e-3)
    assert Config().most_seconds == pytest.approx(100.2, abs=0.1)
    assert Config(timing_weight=0.6, pattern_weight=0.3, text_weight=0.1).least_similarity is None
    with pytest.raises(ValueError):
        Thresholds(0.7, 0.6)


def sample(seed, n, convs=2):
    rng = random.Random(seed)
    words = "alpha beta gamma delta omega sigma kappa theta the of and with".split()
    stock = [" ".join(rng.choices(words, k=9)) for _ in range(4)]
    rows = []
    for _ in range(n):
        base = rng.choice(stock) if rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randint(0, 8)))
        if rng.random() < 0.3:
            base += " " + rng.choice(words)
        rows.append((str(rng.randrange(convs)), f"u{rng.randrange(7)}", base, rng.randrange(300)))
    return rows


def plain_pairs(rows):
    by = defaultdict(list)
    for conv, _, words, _ in rows:
        by[conv].append(words.split())
    out = {}
    for conv, docs in by.items():
        df = Counter(t for d in docs for t in set(d))
        vectors = []
        for d in docs:
            v = {t: c * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in Counter(d).items()}
            size = math.sqrt(sum(x * x for x in v.values()))
            vectors.append({t: x / size for t, x in v.items()})
        for i in range(len(docs)):
            for j in range(i + 1, len(docs)):
                s = sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items())
                if s > 0:
                    out[conv, i, j] = round(min(1.0, s), 9)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_match_plain_version(spark, seed):
    rows = sample(seed, 40)
    a = Analysis(*build(spark, rows))
    got = {(r.conv_id, r.i, r.j): round(r.sim, 9) for r in a.pairs.collect()}
    assert got == plain_pairs(rows)


def test_pruned_coordination_equals_unpruned(spark):
    a = Analysis(*build(spark, sample(3, 60)))
    full = coordination.coordination_edges(a.pairs, a.replies, a.accounts, a.reply_patterns, a.config, prune=False)
    assert sorted(map(tuple, a.coordination.collect())) == sorted(map(tuple, full.collect()))
    assert a.coordination.count() > 0
    settled = graph.components_iterative(a.accounts, a.coordination)
    assert sorted(map(tuple, settled.select("conv_id", "account_id", "component").collect())) == sorted(map(tuple, a.components.select("conv_id", "account_id", "component").collect()))


def test_conversations_do_not_mix(spark):
    one = [("0", *r[1:]) for r in sample(4, 25)]
    alone = Analysis(*build(spark, one))
    twice = Analysis(*build(spark, one + [("1", *r[1:]) for r in one]))
    for name in ("similar", "coordination", "patterns"):
        want = sorted(str(r.asDict()) for r in getattr(alone, name).collect())
        got = sorted(str(r.asDict()) for r in getattr(twice, name).where("conv_id = '0'").collect())
        assert got == want


def test_top_edges_of_identical_replies(spark):
    rows = [("0", f"u{i}", "the very same words here", i) for i in range(10)]
    a = Analysis(*build(spark, rows))
    edges = a.top_edges.collect()
    assert len(edges) < 45 and all(e.sim >= 0.72 for e in edges)
    assert sum(0 in (e.i, e.j) for e in edges) >= 6


def test_phrases(spark):
    rows = [("0", "a", "everyone needs to pay attention to this", 1), ("0", "b", "wow everyone needs to pay attention now", 2), ("0", "c", "so everyone needs to pay attention", 3), ("0", "d", "unrelated words only", 4)]
    a = Analysis(*build(spark, rows))
    first = a.patterns.orderBy("rank").first()
    assert first.text == "everyone needs to pay attention" and first.account_count == 3 and "r003" not in first.reply_set
    same = Analysis(*build(spark, [("0", "a", "one stock phrase again", i) for i in range(4)]))
    assert same.patterns.count() == 0


def test_burst_forms_a_cluster_and_self_does_not(spark):
    words = "agents will replace every single dashboard next year"
    rows = [("0", f"b{i}", words, 40 + 3 * i) for i in range(3)] + [("0", "late", words, 1900), ("0", "h", "I baked bread", 44)]
    a = Analysis(*build(spark, rows))
    assert {(r.source, r.target) for r in a.coordination.collect()} == {("b0", "b1"), ("b0", "b2"), ("b1", "b2")}
    assert [(r.cluster_id, r.size) for r in a.clusters.collect()] == [("cluster_01", 3)]
    c = {r.account_id: r for r in a.classified.collect()}
    assert c["h"].label == "human_like" and c["b0"].automation > c["h"].automation
    assert 0 <= a.scores.first().score <= 1
    path = graph.shortest_paths(spark.createDataFrame([("0", "b0", "b2"), ("0", "h", "b0")], "conv_id string, source string, target string"), a.links).collect()
    assert [(r.source, r.length) for r in path] == [("b0", 1)]
    own = Analysis(*build(spark, [("0", "a", words, i) for i in range(3)]))
    assert own.coordination.count() == 0


SIGNS = [
    (["Kindly message us on Telegram about your locked account"], {"messaging", "urgency"}),
    (["Thanks to @mentor, I made $12,000 in 7 days"], {"money"}),
    (["Comment Interested to earn $300 per day"], {"job"}),
    (["The index rebuild took nine minutes."], set()),
    (["Telegram announced a new feature"], set()),
]


def test_signals(spark):
    rows = spark.createDataFrame([(t,) for t, _ in SIGNS], "texts array<string>").select(signals.text_signals(F.col("texts"), F.lit(None).cast("string")).alias("s")).collect()
    for row, (_, want) in zip(rows, SIGNS, strict=True):
        assert {n for n in signals.LISTS if row.s[n]} == want


def test_answers():
    good = '{"classification": "uncertain", "automationLikelihood": 0.5, "coordinationLikelihood": 0, "confidence": 1, "summary": "x"}'
    assert classify.parse_answer(good)["signals_for"] == []
    for bad in ("[]", "{", good.replace("0.5", "1.5"), good.replace('"x"', '" "'), good.replace("uncertain", "robot"), good[:-1] + ', "coordinationSignals": "x"}'):
        with pytest.raises(classify.BadAnswer):
            classify.parse_answer(bad)


def test_scorer_answers_and_falls_back(spark):
    a = Analysis(*build(spark, [("0", "a", "some words", 1), ("0", "b", "other things", 2)]))

    def scorer(payload):
        if "some words" in payload:
            return '{"classification": "human_like", "automationLikelihood": 0.9, "coordinationLikelihood": 0, "confidence": 1, "summary": "x"}'
        raise OSError("down")

    got = {r.account_id: r for r in classify.scored(a.requests, a.config, scorer).collect()}
    assert (got["a"].label, got["a"].source) == ("automation_like", "SCORER")  # labels follow the thresholds
    assert (got["b"].label, got["b"].source) == ("uncertain", "HEURISTIC_FALLBACK") and "down" in got["b"].signals_for[0] and got["b"].confidence <= 0.3


def test_embedding_model_is_pluggable(spark):
    posts, replies, accounts = build(spark, sample(5, 6, 1))
    a = Analysis(posts, replies, accounts, model=lambda words: similarity.embedding_pairs(words.select("conv_id", "pos", F.array(F.lit(1.0), F.col("pos").cast("double")).alias("embedding"))))
    assert a.pairs.count() == 15
    assert phrases.trigrams(a.words).count() >= 0
