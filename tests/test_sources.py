"""Reading, validation, pages, targets, storage and collection."""

import json

import pytest
from pyspark.sql import functions as F

from choralis.config import Config
from choralis.plans import fixtures
from choralis.plans.analysis import Analysis
from choralis.sources import adapters, ingest, names, pages, store, targets
from choralis.streaming import capture

ACCOUNT = {"id": "a", "username": "ann"}
POST = {"id": "p", "author": "root", "text": "hello", "createdAt": "2024-01-01T00:00:00Z"}


def reply(i, who=ACCOUNT, at="2024-01-01T00:00:10Z", words="text"):
    return {"id": i, "author": who, "text": words, "createdAt": at}


CASES = {
    "good": ([reply("1"), reply("2")], None),
    "early": ([reply("1", at="2023-12-31T23:59:50Z")], "a reply predates the post"),
    "twice": ([reply("1"), reply("1")], "duplicate reply id"),
    "names": ([reply("1"), reply("2", {"id": "a", "username": "Ann"})], "an account appears with two usernames"),
    "reused": ([reply("p")], "a reply reuses the post id"),
    "none": ([], "replies must number 1 to 400"),
    "negative": ([reply("1", ACCOUNT | {"followers": -1})], "replies.author.followers must not be negative"),
    "blank": ([reply("1", words="  ")], "replies.text must have 1 to 5000 characters"),
}


def test_validation(spark, tmp_path):
    for name, (replies, _) in CASES.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"post": POST | {"id": "p"}, "replies": replies, "kind": None}))
    for name, (_, want) in CASES.items():
        rows = ingest.read_conversations(spark, str(tmp_path / f"{name}.json"))
        got = ingest.violations(rows).select(ingest.problem(F.col("violations"))).first()[0]
        assert got == want, name
    posts, replies, accounts = ingest.flatten(ingest.read_conversations(spark, str(tmp_path / "good.json")))
    assert (posts.first().kind, replies.count(), accounts.count()) == ("thread", 2, 1)


def test_broken_document(spark, tmp_path):
    (tmp_path / "x.json").write_text("{not json")
    row = ingest.violations(ingest.read_conversations(spark, str(tmp_path / "x.json"))).first()
    assert "post must be given" in row.violations


def test_pages(spark):
    rows = spark.createDataFrame(fixtures.PAGES, "page string, reader string, thread_id string, html string")
    got = pages.read_pages(rows.withColumn("now", F.timestamp_seconds(F.lit(1767225600)))).orderBy("page", "item").collect()
    by = {}
    for r in got:
        by.setdefault(r.page, []).append((r.role, r.id, r.handle, r.text))
    assert by["x"] == [("post", "10", "root", "The post"), ("reply", "11", "ann", "A reply"), ("reply", "12", "bob", "")]
    assert [x[1] for x in by["xf"]] == ["1", "10", "11", "12"]
    assert [(x[0], x[2], x[3]) for x in by["l"]] == [("post", "jane-doe", "The post"), ("reply", "ann", "Top comment"), ("reply", "company-acme", "Nested")]
    assert [(x[1], x[2]) for x in by["lf"]] == [("li-KEY-1", "bea"), ("7123456789012345678", "outer")]
    assert "none" not in by
    times = {(r.page, r.item): r.created_at for r in got}
    assert times["l", 1] >= times["l", 0]


def test_targets(spark):
    rows = spark.createDataFrame([(u,) for u in fixtures.URLS], "u string").select("u", targets.target(F.col("u")).alias("t"), targets.login_required(F.col("u")).alias("l")).collect()
    got = {r.u: r for r in rows}
    assert got["http://mobile.twitter.com/Jane_1/status/99"].t.url == "https://x.com/Jane_1/status/99"
    assert got["https://twitter.com/"].t.feed and got["https://example.com/x.com/jane/status/1"].t is None
    assert got["https://x.com/login?next=1"].l and not got["https://linkedin.com"].l


def test_pseudonyms():
    assert names.base36(0) == "0" and names.base36(35) == "z" and names.base36(36) == "10"
    assert 0 <= names.fnv_share("x") <= 1 and names.fnv_share("a") != names.fnv_share("b")


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("a" * 32, 1), ("b" * 32, 2)], "analysis_id string, n int")
    store.write_graph({"account": df}, str(tmp_path))
    assert store.read_graph(spark, str(tmp_path), "account", "a" * 32).first().n == 1
    rows = spark.createDataFrame(fixtures.ANALYSES, "analysis_id string, created_at long, demo boolean, running boolean")
    kept = store.kept_analyses(rows, 5)
    assert kept.where("kept and not demo and not running").count() == 5


def test_merge_of_scans():
    seen, skipped = [], set()
    rows = [(f, i, h, t, s) for _, _, f, i, h, t, s in fixtures.SCANS if _ is not None][:8]
    out, post = capture.merge_items(seen, None, skipped, rows, 400)
    assert [(k, i, t) for k, _, i, _, t, _ in out] == [("post", "p", ""), ("reply", "a", "first"), ("post", "p", "the post"), ("reply", "b", "later"), ("reply", "c", "early")]
    assert post == ("p", True) and not skipped
    seen = []
    capture.merge_items(seen, None, set(), [(False, str(i), "h", "t", 0) for i in range(10)], 4)
    assert seen == ["0", "1", "2", "3"]


def test_repeated_pages_do_not_multiply(spark):
    rows = spark.createDataFrame(fixtures.PAGES, "page string, reader string, thread_id string, html string").withColumn("now", F.timestamp_seconds(F.lit(1767225600)))
    once, twice = (pages.read_pages(r).groupBy("page", "item", "id").count().collect() for r in (rows, rows.unionAll(rows.where("page = 'xf'"))))
    n = {(r.page, r.item, r.id): r["count"] for r in once}
    assert set(n.values()) == {1}
    assert {(r.page, r.item, r.id): r["count"] for r in twice} == {k: 2 if k[0] == "xf" else 1 for k in n}


def test_stream_equals_batch(spark, tmp_path):
    items = spark.createDataFrame(fixtures.SCANS, "conv_id string, seq long, focal boolean, id string, handle string, text string, at long")
    items = items.select("conv_id", "seq", "focal", "id", "handle", "text", F.timestamp_seconds("at").alias("created_at"))
    for k in range(2):
        items.where(F.col("seq") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    capture.merge_scans(stream, idle_ms=None).writeStream.format("memory").queryName("merged_test").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.conv_id, r.id) for r in spark.table("merged_test").where("kind = 'reply'").collect()}
    assert got == {(r.conv_id, r.id) for r in capture.merge_batch(items).collect()}


def test_finish(spark):
    items = spark.createDataFrame(fixtures.SCANS, "conv_id string, seq long, focal boolean, id string, handle string, text string, at long")
    items = items.select("conv_id", "seq", "focal", "id", "handle", "text", F.timestamp_seconds("at").alias("created_at"))
    post = items.where("focal and seq in (4, 8)").select("conv_id", "id", "handle", "text", "created_at")
    posts, replies, accounts = capture.finish_thread(post, capture.merge_batch(items, Config(max_replies=2)))
    assert replies.where("created_at < timestamp_seconds(100) and conv_id = 't1'").count() == 0 and posts.count() == 2
    assert {r.account_id for r in accounts.collect()} == {"ann", "bob", "dan"}
    root = capture.finish_feed(capture.merge_batch(items), "X", F.timestamp_seconds(F.lit(0)))[0].collect()
    assert all(r.kind == "feed" for r in root) and "1970-01-01 00:00 UTC" in root[0].text


@pytest.mark.parametrize("name", ["entry", "queries", "oracle_sql"])
def test_entry_module(name):
    import __spark_entry__

    assert callable(getattr(__spark_entry__, name))


def test_documents_of_any_length(spark, tmp_path):
    """Long documents and rows without n_chars are replies too, and near copies among them are found."""
    long = " ".join(f"word{i}" for i in range(1500))
    texts = {1: "short text here", 2: long, 3: long + " end", 4: "no length given", 5: None}
    n_chars = {1: len(texts[1]), 2: 32 * 400, 3: 32 * 401, 4: None, 5: None}
    rows = [(d, t, "en", f"src{d}", n_chars[d]) for d, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    a = Analysis(*adapters.documents_as_replies(spark, str(tmp_path)))
    want = {"d1": "15-0-0", "d2": "0-0-0", "d3": "0-0-0", "d4": "15-0-0", "d5": "0-0-0"}
    assert {r.reply_id: (r.conv_id, r.text) for r in a.replies.collect()} == {k: (c, texts[int(k[1:])]) for k, c in want.items()}
    assert {(r.conv_id, r.i, r.j) for r in a.top_edges.collect()} == {("0-0-0", 0, 1)}


def test_conversations_of_documents_are_bounded(spark, tmp_path):
    """However many documents share a length, no conversation has more than 400 replies, and none is lost."""
    rows = [(d, "one and the same text", "en", "src1", 21) for d in [*range(900), 10_001]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    _, replies, _ = adapters.documents_as_replies(spark, str(tmp_path))
    sizes = {r.conv_id: (r.n, r.low, r.high) for r in replies.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high")).collect()}
    assert sizes == {"21-0-0": (400, 0, 399), "21-0-1": (400, 0, 399), "21-0-2": (100, 0, 99), "21-1-0": (1, 0, 0)}
