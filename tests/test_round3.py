"""Findings of round 3."""

import pytest
from pyspark.sql import functions as F

from choralis.config import Config
from choralis.functions import signals
from choralis.functions.exact import spark_pattern
from choralis.operators import accounts as acc
from choralis.operators import phrases, similarity
from choralis.plans import fixtures, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["text_signals", "spam_floor"])
def test_each_signal_is_searched_once(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") <= len(signals.LISTS) + 4  # and words of texts, parents and praise


def test_no_match_starts_with_another_character(spark):
    said = [t for _, texts, _ in fixtures.SIGNAL_TEXTS for t in texts]
    said += ["xhurry HURRY,hurryé éhurry _asap", "a$AB $1,000 in 2 days", "x—y🔥z", "5% off 50% off", "\U0001f51ehorny #f4f x#f4f", "dm me\ndm me", "Join our waitlist🚀now live"]
    rows = spark.createDataFrame([(t,) for t in said], "text string")
    for pattern in signals.STARTS:
        plain = F.regexp_extract_all("text", F.lit("(?i)" + spark_pattern(pattern)), F.lit(0))
        quick = F.regexp_extract_all("text", signals._any_case(pattern), F.lit(0))
        assert rows.where(plain != quick).count() == 0


def _words(spark):
    rows = [(f"c{k % 3}", k, " ".join(f"w{(k * a + a * a) % 37}" for a in range(1, 12))) for k in range(90)] + [("c1", 200, None), ("one", 0, "w1 w2")]
    replies = spark.createDataFrame(rows, "conv_id string, pos int, text string")
    return similarity.tokenised(replies.withColumn("reply_id", F.col("pos").cast("string")).withColumn("account_id", F.concat(F.lit("u"), F.col("pos") % 5))), replies


def test_pairs_never_move_term_by_term(spark):
    pairs = similarity.tfidf_pairs(_words(spark)[0])
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in x and ("i#" in x or "j#" in x) for x in plan.splitlines())


def test_long_conversations_are_compared_in_blocks(spark, monkeypatch):
    words, replies = _words(spark)
    who = replies.withColumn("account_id", F.concat(F.lit("u"), F.col("pos") % 5))

    def found():
        rows = similarity.tfidf_rows(words)
        pairs = similarity.pairs_of(rows)
        best = {(r.conv_id, r.pos): (r.best, r.best_pos) for r in similarity.best_of_rows(rows).collect()}
        assert best == {(r.conv_id, r.pos): (r.best, r.best_pos) for r in similarity.best_of_pairs(pairs).collect()}
        own = sorted(map(tuple, acc.self_similarity_of_rows(rows, who).collect()))
        assert own == sorted(map(tuple, acc.self_similarity(pairs, who).collect())) and own
        return sorted(map(tuple, pairs.collect())), best

    whole = found()
    monkeypatch.setattr(similarity, "BLOCK", 7)
    assert found() == whole and len(whole[0]) > 100


def test_pairs_of_documents_move_once_and_are_not_written(spark):
    pairs = queries.QUERIES["tfidf_pairs"](spark, SF)
    assert pairs.count() and all(SF in x for x in pairs.inputFiles())
    pairs.collect()
    final = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len([x for x in final.splitlines() if "Exchange hashpartitioning(rest" in x]) == 1  # by which conversations are dealt


@pytest.mark.parametrize("block", [400, 7])
def test_rows_keep_what_is_similar_or_asked_for(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    words, replies = _words(spark)
    who = replies.withColumn("account_id", F.concat(F.lit("u"), F.col("pos") % 5))
    pairs = {(r.conv_id, r.i, r.j): r.sim for r in similarity.tfidf_pairs(words).collect()}
    at = {(r.conv_id, r.pos) for r in replies.collect()}
    rows = similarity.tfidf_rows(words, 0.4, F.array(F.lit(200) - F.col("pos"), F.lit(3)))
    asked = {(c, *sorted((p, q))) for c, p in at for q in (200 - p, 3)}
    assert {(r.conv_id, r.i, r.j): r.sim for r in similarity.pairs_of(rows).collect()} == {k: s for k, s in pairs.items() if s >= 0.4 or k in asked}
    assert any(k in asked and s < 0.4 for k, s in pairs.items()) and any(s < 0.4 and k not in asked for k, s in pairs.items())
    assert sorted(map(tuple, acc.self_similarity_of_own(rows, who).collect())) == sorted(map(tuple, acc.self_similarity(similarity.tfidf_pairs(words), who).collect()))
    best = similarity.best_of_pairs(similarity.tfidf_pairs(words))
    assert sorted(map(tuple, similarity.best_of_rows(rows).collect())) == sorted(map(tuple, best.collect()))


def test_embedding_pairs_take_groups_that_grow(spark, tmp_path):
    spark.range(200).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id") % 7 + F.lit(0.5)).alias("embedding")).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.conv_id, r.i, r.j) for r in queries.embedding_pairs(spark, str(tmp_path)).collect()}
    assert got == {(k, i, j) for k in range(64) for j in range(4) for i in range(j) if k + 64 * j < 200}


def test_counts_of_words_move_no_text(spark):
    for name in ("lexical_diversity", "shingle_counts"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window [" in plan and "parquet" in plan and not any("text#" in x for x in plan[: plan.index("Window [")].splitlines())
        assert "words-" not in plan  # nothing is written either


def test_sets_of_replies_are_keys_by_their_digest(spark):
    words = [("c", k, f"r{k:03d}", f"u{k % 5}", "a stock phrase of nine words that all repeat".split()) for k in range(40)]
    rows = spark.createDataFrame(words, "conv_id string, pos int, reply_id string, account_id string, words array<string>")
    found = phrases.patterns(rows, Config())
    got = found.collect()
    assert [(r.rank, r.text, r.account_count, len(r.reply_set)) for r in got] == [(1, "a stock phrase of nine words that all repeat", 5, 40)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "set#" in plan and not any("Exchange" in x and "reply_set#" in x for x in plan.splitlines())


def _moved(df):
    """The lines of the plan that move rows, before it runs."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]


def test_runs_of_words_move_with_their_reply_only(spark):
    said = [(f"c{k % 2}", k, f"r{k}", f"u{k % 4}", f"w{k % 4} w{k % 3} a stock of phrases w{k % 5} a stock of w{k}".split()[: k % 12]) for k in range(60)]
    words = spark.createDataFrame(said, "conv_id string, pos int, reply_id string, account_id string, words array<string>")
    found = phrases.candidate_trigrams(words, Config(min_phrase_accounts=2))
    assert len(_moved(found)) == 1  # the words, by conversation
    by = {}
    for r in phrases.trigrams(words).collect():
        by.setdefault((r.conv_id, r.trigram), []).append(r)
    want = sorted(tuple(r) for rows in by.values() if len({r.account_id for r in rows}) >= 2 for r in rows)
    assert sorted(map(tuple, found.select("conv_id", "pos", "reply_id", "account_id", "at", "trigram").collect())) == want and want


def test_phrases_are_put_together_from_their_trigrams(spark):
    said = {"a": "one two three four five six of the and in nine ten", "b": "nought one two three four five six of the and in nine ten eleven"}
    words = [("c", k, f"r{k}", f"u{k}", said["a" if k else "b"].split()) for k in range(4)]
    rows = spark.createDataFrame(words, "conv_id string, pos int, reply_id string, account_id string, words array<string>")
    got = [r.text for r in phrases.patterns(rows, Config()).collect()]
    # "of the and" and "the and in" carry no content, but runs up to three words apart cover them
    assert got == [said["a"]]


def test_threshold_join_moves_no_term_that_one_reply_has(spark):
    words, _ = _words(spark)
    weights = similarity.ordered_weights(words)
    assert len(_moved(weights)) == 2  # hashes by conversation, and its number of replies
    often = words.select("conv_id", "pos", F.explode(F.array_distinct("words")).alias("x")).groupBy("conv_id", F.xxhash64("x").alias("t")).count().where("count > 1")
    held = weights.select("conv_id", "pos", F.explode("terms.t").alias("t"))
    assert held.join(often, ["conv_id", "t"], "left_anti").count() == 0 and held.count()
    assert len(_moved(similarity._indexed(similarity.kept(weights, "test-weights"), 0.72))) == 0


def test_the_driver_gives_back_what_it_learnt_from(spark, monkeypatch):
    from contextlib import contextmanager

    from choralis.llm import common, toxicity
    from choralis.llm.queries import labels

    seen = []

    @contextmanager
    def lean():
        seen.append("begins")
        yield
        seen.append("ends")

    fit = toxicity.fit_toxicity
    monkeypatch.setattr(toxicity, "lean_worker", lean)
    monkeypatch.setattr(toxicity, "fit_toxicity", lambda *a: seen.append("fits") or fit(*a))
    toxicity.learn_toxicity(common.documents(spark, SF).select("doc_id", "text"), labels(spark, SF))
    assert seen == ["begins", "fits", "ends"]


def test_keys_reach_the_driver_without_row_objects(spark, monkeypatch):
    from choralis.llm import minhash

    docs = spark.createDataFrame([(k, f"a text of some words {k // 2}") for k in range(8)], "doc_id long, text string")
    frame = type(docs)
    monkeypatch.setattr(frame, "collect", lambda self: pytest.fail("rows were collected"))
    reps = minhash.sketch(docs).where("doc_id % 2 = 0").select("row", "node")
    assert minhash._members_of(docs, reps).toArrow().num_rows == 4


def test_texts_meet_by_their_keys_at_any_size(spark):
    from choralis.llm.lines import dedup_lines
    from choralis.llm.minhash import keep_one

    docs = spark.createDataFrame([(k, f"a line that all have\nand words of its own {k * k}", f"s{k}") for k in range(6)], "doc_id long, text string, source string")
    for made in (dedup_lines(docs), keep_one(docs)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert any("SortMergeJoin" in x for x in plan.splitlines())  # that a small table has, too, so work grows in proportion
    assert sorted(r.n_removed for r in dedup_lines(docs).collect()) == [0, 1, 1, 1, 1, 1] and keep_one(docs).count() == 6
