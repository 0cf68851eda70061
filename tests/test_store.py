"""Changes of stored graphs, scorers as the settings choose them, and the wait before a new analysis."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from choralis.config import Config, Thresholds
from choralis.operators import classify, scorers
from choralis.sources import store
from choralis.streaming import capture

IDS = [f"{i:032x}" for i in range(4)]


def test_properties_replace_only_found_nodes(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    given = spark.createDataFrame([("a", 9, "x"), ("b", None, None), ("z", 5, "y")], "id string, n int, m string")
    got = {r.id: (r.n, r.m) for r in store.with_properties(nodes, given, "id").collect()}
    assert got == {"a": (9, "x"), "b": (None, None), "c": (3, None)}


def test_killed_upsert_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "accounts")
    rows = [(IDS[0], "a", 1), (IDS[0], "b", 2), (IDS[1], "a", 3), ("12", "a", 4)]
    store.put_stored(spark.createDataFrame(rows, "analysis_id string, id string, n int"), path)
    given = spark.createDataFrame([(IDS[0], "a", 9, "x"), (IDS[3], "z", 5, "y"), (IDS[0], "c", 7, "y")], "analysis_id string, id string, n int, m string")

    def now(n=None):
        return {(r.analysis_id, r.id): (r.n,) for r in store.stored(spark, path, n=n).collect()}

    before = now()
    assert before == {(a, i): (n,) for a, i, n in rows}
    with monkeypatch.context() as m:  # rows are written, the manifest isn't
        m.setattr(store, "_manifest", lambda *x, real=store._manifest, calls=[]: calls.append(1) or (real(*x) if len(calls) < 2 else 1 / 0))
        with pytest.raises(ZeroDivisionError):
            store.upsert(given, path, "id")
    assert now() == before and store.newest(spark, path) == 0
    (tmp_path / "accounts" / "manifest" / "n=7").mkdir()  # begun, not ended
    assert now() == before
    assert store.upsert(given, path, "id") == 1
    assert now() == before | {(IDS[0], "a"): (9,)}
    assert {(r.id, r.m) for r in store.stored(spark, path).where("m is not null").collect()} == {("a", "x")}
    assert now(0) == before  # a reader of the old manifest
    assert store.upsert(given.limit(0), path, "id") == 2 and now() == before | {(IDS[0], "a"): (9,)}
    assert len(list((tmp_path / "accounts" / "rows").glob(f"version=*/analysis_id={IDS[1]}"))) == 1  # untouched, never written again


def test_null_units_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="analysis_id is null"):
        store.put_stored(spark.createDataFrame([(None, 1)], "analysis_id string, n int"), str(tmp_path / "t"))


def test_clustered_tables_join_without_exchange(spark):
    a = store.clustered(spark.range(500).selectExpr("id k", "id % 7 x"), "left_side", "k", 8)
    b = store.clustered(spark.range(900).selectExpr("id % 300 k", "id y"), "right_side", "k", 8)
    both = a.join(b.hint("merge"), "k").groupBy("k").agg({"y": "sum"})
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert both.count() == 300


def test_delete_drops_only_the_ids(spark, tmp_path):
    rows = spark.createDataFrame([(i, k) for k, i in enumerate(IDS)], "analysis_id string, n int")
    store.write_graph({"account": rows, "posted": rows}, str(tmp_path))
    wanted = spark.createDataFrame([(IDS[0],), (IDS[0],), ("../account",), ("f" * 32,), (None,)], "analysis_id string")
    assert store.delete_analyses(wanted, str(tmp_path)) == 2
    assert {r.analysis_id for r in store.read_graph(spark, str(tmp_path), "posted").collect()} == set(IDS[1:])


def test_reset_takes_demos_and_ids_without_an_analysis(spark):
    names = spark.createDataFrame([(i,) for i in IDS], "analysis_id string")
    known = spark.createDataFrame([(IDS[0], True), (IDS[1], False), (IDS[2], None)], "analysis_id string, demo boolean")
    assert {r[0] for r in store.reset_ids(names, known).collect()} == {IDS[0], IDS[3]}


def test_scorer_choice():
    assert scorers.chosen(Config())[0] is None
    assert scorers.chosen(Config(scorer="auto"))[0] is None
    assert isinstance(scorers.chosen(Config(scorer="auto", scorer_url="http://h/"))[0], scorers.HttpScorer)
    assert isinstance(scorers.chosen(Config(scorer="typed", scorer_url="http://h/"))[0], scorers.TypedScorer)
    for bad in (Config(scorer="http"), Config(scorer="typed"), Config(scorer="other", scorer_url="http://h/")):
        with pytest.raises(ValueError):
            scorers.chosen(bad)
    assert "secret" not in repr(Config(scorer_token="secret"))


def test_http_scorer_sends_json_and_takes_2xx_only():
    seen = []

    class Answers(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.headers["Authorization"], self.headers["Content-Type"], json.loads(body)))
            self.send_response(int(self.path[1:]))
            self.send_header("Location", "/200")
            self.end_headers()
            self.wfile.write(b"told")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    assert scorers.HttpScorer(f"{at}/200", "t")('{"a": 1}') == "told"
    assert seen[-1] == ("Bearer t", "application/json", {"a": 1})
    for code in (302, 404, 500):
        with pytest.raises(RuntimeError, match=str(code)):
            scorers.HttpScorer(f"{at}/{code}")("{}")
    assert seen[-1][0] is None
    server.shutdown()
    with pytest.raises(RuntimeError):
        scorers.HttpScorer("http://127.0.0.1:1/")("{}")


def test_typed_requests_ask_what_the_answers_are_read_for():
    sent = []
    ask = scorers.TypedScorer(lambda body: sent.append(json.loads(body)) or "", "m")
    ask(json.dumps({"kind": "feed", "username": "u", "reply_text": "a", "other_texts": ["b"], "followers": 3, "max_sim": 0.0, "phrases": []}))
    ask(json.dumps({"kind": "thread", "username": "u", "max_sim": 0.5}))
    assert set(sent[0]["questions"]) == set(classify.QUESTIONS)
    assert tuple(sent[0]["questions"]["spamType"]["criteria"]) == classify.QUESTIONS["spamType"]
    assert sent[0]["state"]["posts"] == ["a", "b"] and sent[0]["state"]["account"]["metadata"] == {"followers": 3}
    assert "max_sim" not in sent[0]["state"] and sent[1]["state"]["max_sim"] == 0.5


def test_sensitivity_moves_thresholds():
    t = Thresholds()
    assert t.at(50) == t
    assert (t.at(100).human, t.at(100).automation) == pytest.approx((0.2, 0.45))
    assert (t.at(0).human, t.at(0).automation) == pytest.approx((0.6, 0.85))


def test_wait_is_quiet_time_up_to_the_longest():
    c = Config()
    assert capture.next_wait(1_000, None, c) == (1_000, 2_000)
    assert capture.next_wait(5_500, 1_000, c) == (1_000, 1_500)
    assert capture.next_wait(7_000, 1_000, c) == (1_000, 0)


def test_due_once_quiet(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("c", f"i{k}") for k in range(3)], "conv_id string, id string").coalesce(1).write.parquet(folder)
    merged = spark.readStream.schema("conv_id string, id string").parquet(folder)
    run = capture.due(merged, Config(quiet_ms=300)).writeStream.format("memory").queryName("due_rows").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            run.awaitTermination(0.5)
            if spark.table("due_rows").count():
                break
        assert [(r.conv_id, r["items"]) for r in spark.table("due_rows").collect()] == [("c", 3)]
    finally:
        run.stop()
