"""Kept answers of scorers, stops by the user, and new analyses once a conversation is quiet."""

import json
import time

from pyspark.sql import functions as F

from choralis.config import Config
from choralis.operators.answers import AnswerCache
from choralis.operators.classify import ANSWER
from choralis.streaming import capture


def asker(log, fail=()):
    """Answers payloads and writes each that it is asked to a file."""

    def ask(payloads):
        def run(frames):
            import pandas as pd

            for rows in frames:
                with open(log, "a") as f:
                    f.writelines(f"{p}\n" for p in rows["payload"])
                names = ["payload", "reason", *(x.split()[0] for x in ANSWER.split(", "))]
                out = [{"payload": p, "reason": "no answer" if p in fail else None, "label": "uncertain", "automation": len(p) / 100} for p in rows["payload"]]
                yield pd.DataFrame({n: pd.Series([x.get(n) for x in out], dtype=object) for n in names})

        return payloads.coalesce(1).mapInPandas(run, f"payload string, reason string, {ANSWER}")

    return ask


def test_answers_are_kept_from_run_to_run(spark, tmp_path):
    cache, log = AnswerCache(str(tmp_path / "answers"), keep=3), str(tmp_path / "log")

    def run(*payloads, fail=()):
        open(log, "w").close()
        rows = spark.createDataFrame([(p,) for p in payloads], "payload string")
        got = {r.payload: (r.reason, r.automation) for r in cache.answered(rows, asker(log, fail), ANSWER).collect()}
        assert {p: x for p, (why, x) in got.items() if why is None} == {p: len(p) / 100 for p in payloads if p not in fail}
        return sorted(open(log).read().split())

    assert run("a", "bb", "a") == ["a", "bb"]
    assert run("a", "bb") == []  # the second run asks nothing
    assert run("ccc", "d", fail=("d",)) == ["ccc", "d"]
    assert run("d", "a") == ["d"]  # what failed was not kept; a is used again, and bb is now the one used longest ago
    assert run("a", "ccc") == []
    assert run("bb") == ["bb"]
    assert len(cache._versions(spark)) <= 2


def scans(spark, path, rows):
    items = spark.createDataFrame(rows, "conv_id string, seq long, focal boolean, id string, handle string, text string, at long")
    items.select("conv_id", "seq", "focal", "id", "handle", "text", F.timestamp_seconds("at").alias("created_at")).coalesce(1).write.mode("append").parquet(path)


def read(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


def test_a_stopped_conversation_takes_nothing_more(spark, tmp_path):
    at = str(tmp_path)
    schema = capture.SCANNED
    row = lambda c, k: (c, k, False, f"i{k}", "h", "t", k)
    scans(spark, f"{at}/in", [row(c, k) for c in "ab" for k in range(4)])
    spark.createDataFrame([("a", 1), ("a", 2)], "conv_id string, seq long").write.parquet(f"{at}/stops")

    def go():
        merged = capture.merge_scans(read(spark, f"{at}/in", schema), idle_ms=None, stops=read(spark, f"{at}/stops", "conv_id string, seq long"))
        merged.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        return {(r.conv_id, r.id) for r in spark.read.parquet(f"{at}/out").collect()}

    first = {("a", "i0"), ("a", "i1"), *(("b", f"i{k}") for k in range(4))}
    assert go() == first
    scans(spark, f"{at}/in", [row(c, k) for c in "ab" for k in range(4, 6)])
    assert go() == first | {("b", "i4"), ("b", "i5")}


def test_quiet_conversations_are_analysed_anew(spark, tmp_path):
    at, seen = str(tmp_path), []
    row = lambda c, k: (c, k, False, f"i{k}", "h", "t", k)
    scans(spark, f"{at}/in", [row("a", 0), row("a", 1), row("b", 0)])

    def run(rows, n):
        seen.append({(r.conv_id, r.id) for r in rows.collect()})

    config = Config(quiet_ms=500, longest_wait_ms=3_000)
    queries = capture.watch(read(spark, f"{at}/in", capture.SCANNED), f"{at}/watch", run, config)
    try:
        wait = time.time() + 60
        while sum(map(len, seen)) < 3 and time.time() < wait:
            time.sleep(0.2)
        assert set().union(*seen) == {("a", "i0"), ("a", "i1"), ("b", "i0")}
        before = len(seen)
        scans(spark, f"{at}/in", [row("a", 2)])
        wait = time.time() + 60
        while len(seen) == before and time.time() < wait:
            time.sleep(0.2)
        assert seen[-1] == {("a", "i0"), ("a", "i1"), ("a", "i2")}  # the whole conversation that grew, and only that
        assert all(q.exception() is None for q in queries)
    finally:
        for q in queries:
            q.stop()
    assert json.loads(queries[1].lastProgress.json if hasattr(queries[1].lastProgress, "json") else json.dumps(queries[1].lastProgress))["id"]


def test_live_status_follows_the_state(spark, tmp_path):
    items, stops, out = str(tmp_path / "items"), str(tmp_path / "stops"), str(tmp_path / "out")
    scans(spark, items, [("a", 1, True, "p", "me", "post", 0), ("a", 2, False, "x", "u", "one", 1), ("a", 3, False, "y", "u", " ", 2), ("b", 1, False, "z", "v", "two", 3)])
    spark.createDataFrame([("c", 1)], "conv_id string, seq long").write.parquet(stops)

    def run():
        merged = capture.merge_scans(read(spark, items, spark.read.parquet(items).schema), idle_ms=None, stops=read(spark, stops, "conv_id string, seq long"))
        writer = capture.progress(merged).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        return q, {tuple(r) for r in capture.live_status(spark, f"{out}-state").collect()}

    q, told = run()
    assert told == {("a", "COLLECTING", 1, True, 1), ("b", "COLLECTING", 1, False, 0), ("c", "FULL", 0, False, 0)}
    rows = capture.batches(spark, q).collect()
    assert [(r.rows_in, r.items, r.state_rows) for r in rows if r.rows_in] == [(5, 3, 3)]
    scans(spark, items, [("a", 4, False, "y", "u", "late", 4)])
    spark.createDataFrame([("b", 9)], "conv_id string, seq long").write.mode("append").parquet(stops)
    assert run()[1] == {("a", "COLLECTING", 2, True, 0), ("b", "FULL", 1, False, 0), ("c", "FULL", 0, False, 0)}
