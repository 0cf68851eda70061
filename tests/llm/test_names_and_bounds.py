"""Clashing and odd column names, bounds on what reaches the driver, texts longer than a chunk."""

import hashlib

import pytest
from pyspark.sql import functions as F

from choralis.llm import bpe, common, language, lines, minhash, mixing, quality, queries, toxicity


ODD_NAMES = ["Score", "LANG_PRED", "IDS", "Decoded", "a`b", "a.b"]


@pytest.fixture(scope="module")
def named(spark):
    rows = [(i, f"the {w} cat sat on the mat number {i}", "en", f"s{i % 3}", i) for i, w in enumerate(["old", "new", "red", "old"])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, x int")


def test_any_column_name(spark, named):
    docs = named.select("*", *[F.col("x").alias(c) for c in ODD_NAMES]).drop("x")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    toxic = toxicity.score_toxicity(docs, toxicity.learn_toxicity(docs, labels))
    assert toxic.count() == 4 and [c.lower() for c in toxic.columns].count("score") == 1
    told = language.predict_languages(docs, language.learn_languages(docs.select("text", "lang")))
    assert {r.lang_pred for r in told.select("lang_pred").collect()} == {"en"}
    coded = bpe.bpe_encode(docs, queries.vocabulary(), decoded="decoded")
    assert coded.where("ids is not null and decoded = text").count() == 4
    for kept in (minhash.keep_one(docs), lines.dedup_lines(docs), mixing.mix(docs)):
        assert set(ODD_NAMES) <= set(kept.columns)
        kept.collect()


def test_many_languages_are_an_error(spark):
    docs = spark.range(6).select(F.lit("some words").alias("text"), F.col("id").cast("string").alias("lang"))
    for learn in (language.learn_languages, quality.learn_references):
        with pytest.raises(ValueError, match="more than 5 languages"):
            learn(docs, max_langs=5)
        learn(docs, max_langs=6)


def test_texts_longer_than_a_chunk(spark):
    long = "some words of a long text, " * (common.CHUNK_CHARS // 20)
    assert len(long) > common.CHUNK_CHARS
    docs = spark.createDataFrame([(1, long), (2, None), (3, "short"), (4, long)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.token_digests(docs, queries.vocabulary()).collect()}
    assert got[1].decoded_sha256 == got[4].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert got[2].n_tokens == 0
    judged = {r.doc_id: r for r in quality.judge_quality(docs, quality.learn_references(docs.withColumn("lang", F.lit("en")))).collect()}
    assert judged[1].n_words == len(long.split()) and judged[1].base_failed and judged[3].n_words == 1


def test_toxicity_query(spark):
    """Held-out texts of the given tables by the query itself: clean ones stay, empty ones score low."""
    docs = queries.op3_toxicity(spark, "/root/testdata/sf0.01").cache()
    told = docs.where("held_out").join(queries.labels(spark, "/root/testdata/sf0.01"), "doc_id")
    assert told.where("toxic = 0 and predicted = 1").count() <= 0.02 * told.where("toxic = 0").count()
    assert told.where("toxic = 1 and predicted = 1").count() >= 0.6 * told.where("toxic = 1").count()
    bare = common.documents(spark, "/root/testdata/sf0.01").where("text is null or text = ''").select("doc_id")
    assert docs.join(bare, "doc_id").where("score > 0.2001").count() == 0
