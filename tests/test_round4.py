"""Work that is done once: by expressions in lambdas, and by searches that most texts don't need."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from choralis.config import Config
from choralis.functions import signals
from choralis.operators import answers, classify, phrases, similarity
from choralis.operators.timing import regularity
from choralis.plans import fixtures, queries


def test_regularity_computes_its_times_and_their_mean_once(spark):
    rng = random.Random(1)
    rows = [sorted(rng.randrange(900) for _ in range(n)) for n in (0, 1, 3, 4, 5, 60, 400)] + [[7] * 9, list(range(0, 50, 5))]

    def plain(t):
        gaps = [b - a for a, b in zip(t, t[1:])]
        mean = sum(gaps) / len(gaps) if gaps else 0
        if len(t) < 4:
            return None
        return 1.0 if mean == 0 else math.floor(min(1, max(0, 1 - math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) / mean)) * 1000 + 0.5) / 1000

    df = spark.createDataFrame([(k, t[::-1]) for k, t in enumerate(rows)] + [(99, None)], "k int, t array<bigint>")
    out = df.select("k", regularity(F.sort_array("t")).alias("r"))
    assert {r.k: r.r for r in out.collect()} == {k: plain(t) for k, t in enumerate(rows)} | {99: None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") <= 2  # for its size, and for all else


def test_texts_that_match_no_list_are_searched_once(spark):
    rng = random.Random(2)
    bare = "words of a plain prose that sells nothing at all in 2024"
    texts = [" ".join(x) for _, x, _ in fixtures.SIGNAL_TEXTS] + ["", bare, "HURRY", "#F4F", "🔞", "a—b", "xhurry", "50% off", "$ABC", "so you dont", "also you don't"]
    texts += [t[rng.randrange(len(t)) :] + bare[: rng.randrange(9)] for t in texts for _ in range(4) if t]
    one = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    every = {n: signals.first_matches(F.col("t"), p) for n, p in signals.LISTS.items()}
    hook = F.regexp_like("t", F.lit("(?im)" + signals.spark_pattern(signals.THREAD_HOOK)))
    got = one.select("t", signals.text_signals(F.array("t"), F.lit(None).cast("string")).alias("s"), F.struct(*[c.alias(n) for n, c in every.items()]).alias("w"), F.regexp_like("t", signals._any_list()).alias("any"), hook.alias("hook")).collect()
    for r in (x for x in got if x.t is not None):
        assert {n: r.s[n] for n in every} == {n: r.w[n] for n in every} and r.s.thread_hook == r.hook, r.t
        assert r.any == any(r.w[n] for n in every), r.t
    assert 20 < sum(bool(r["any"]) for r in got) < len(got) - 20


def test_runs_of_a_short_conversation_meet_whole_and_of_a_long_one_in_windows(spark, monkeypatch):
    rng = random.Random(3)
    kinds = [f"w{k}" for k in range(12)] + ["the", "of", "é", "ß"]
    rows = [(None if c == 2 else f"c{c}", k, f"r{k}", None if k % 9 == 0 else f"u{k % 5}", rng.choices(kinds, k=rng.randrange(40))) for c in range(4) for k in range(30 if c else 90)]
    words = spark.createDataFrame([*rows, ("c1", 99, "r99", "u1", None)], "conv_id string, pos int, reply_id string, account_id string, words array<string>")
    every = {}
    for r in phrases.trigrams(words).collect():
        every.setdefault((r.conv_id, r.trigram), []).append(r)
    want = Counter(tuple(r) for found in every.values() if len({r.account_id for r in found}) >= 3 for r in found)
    windows, long = phrases._met_in_windows, []
    monkeypatch.setattr(phrases, "_met_in_windows", lambda w, c: long.append({r.conv_id for r in w.select("conv_id").distinct().collect()}) or windows(w, c))
    cols = ["conv_id", "pos", "reply_id", "account_id", "at", "trigram"]
    for block, held in ((400, []), (40, [{"c0"}]), (7, [{"c0", "c1", None, "c3"}])):
        monkeypatch.setattr(similarity, "BLOCK", block)
        assert Counter(map(tuple, phrases.candidate_trigrams(words, Config()).select(*cols).collect())) == want and len(want) > 100
        assert long == held
        long.clear()


def test_answers_meet_their_requests_by_key(spark, tmp_path):
    a = queries.analysis(spark, "/root/testdata/sf0.001")
    cache = answers.AnswerCache(str(tmp_path / "answers"))
    once = classify.scored(a.requests, a.config, queries._by_name, cache=cache)
    again = classify.scored(a.requests, a.config, queries._unasked, cache=cache)
    cols = ["conv_id", "account_id", "automation", "label", "source", "summary"]
    plain = Counter(map(tuple, classify.scored(a.requests, a.config, queries._by_name).select(*cols).collect()))
    for got in (once, again):
        assert Counter(map(tuple, got.select(*cols).collect())) == plain and plain
        plan = got.select(*cols)._jdf.queryExecution().executedPlan().toString()
        moved = [x for x in plan.splitlines() if "Exchange" in x]
        assert moved and not any("payload" in x or "text" in x for x in moved)
    assert "payload" not in cache.entries(spark, classify.ANSWER).columns
