"""Collecting a thread or feed from scans that overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from choralis.config import Config

#: Items of scans: one row each; seq orders them, focal marks the thread's post.
SCANNED = "conv_id string, seq long, focal boolean, id string, handle string, text string, created_at timestamp"
MERGED = "conv_id string, kind string, pos int, id string, handle string, text string, created_at timestamp"
STATE = "ids string, post string, post_text boolean, skipped string, idle int, full boolean, began long"
SEP = "\x1f"


def merge_items(seen: list[str], post: tuple[str, bool] | None, skipped: set[str], rows: list[tuple], most: int) -> tuple[list[tuple], tuple[str, bool] | None]:
    """One pass over items (focal, id, handle, text, created_at): what is new, in order. seen and skipped grow in place.

    The first text of an id wins; items without text wait until a later scan has one; a post that had no text is
    replaced by a later read that has.
    """
    out: list[tuple] = []
    known = set(seen)
    for focal, i, handle, text, at in rows:
        told = bool(text and text.strip())
        if focal:
            if post is None or (not post[1] and told):
                post = (i, told)
                out.append(("post", 0, i, handle, text, at))
            continue
        if i in known or len(seen) >= most or (post is not None and i == post[0]):
            continue
        if not told:
            skipped.add(i)
            continue
        skipped.discard(i)
        out.append(("reply", len(seen), i, handle, text, at))
        seen.append(i)
        known.add(i)
    return out, post


def merge_scans(items: DataFrame, config: Config = Config(), idle_ms: int | None = 360_000, stops: DataFrame | None = None) -> DataFrame:
    """A stream of scanned items to a stream of new posts and replies, with at most max_replies for each conversation.

    A conversation's state goes when nothing has come for idle_ms. It is full, and takes nothing more, at the cap, after
    config.idle_scans scans without news, and config.capture_minutes after its first scan; and once the user stops it: stops
    is a second stream (conv_id, seq), whose rows go to the same state, and what was scanned after seq is not taken, even
    if it comes in the same batch. idle_ms None: no timer, for streams that end (a timer keeps an availableNow stream running).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        ids, post_id, post_text, skipped, idle, full, began = state.get if state.exists else ("", None, False, "", 0, False, now)
        full = full or now - began >= config.capture_minutes * 60_000
        if full:
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
            return
        seen, left = [x for x in ids.split(SEP) if x], {x for x in skipped.split(SEP) if x}
        post = (post_id, post_text) if post_id else None
        rows = pd.concat(list(frames)).sort_values(["seq"], kind="stable")
        ends = rows.loc[rows["stop"], "seq"]
        stopped = len(ends) > 0
        rows = rows[~rows["stop"] & (rows["seq"] <= ends.min())] if stopped else rows
        out, post = merge_items(seen, post, left, list(zip(rows["focal"], rows["id"], rows["handle"], rows["text"], rows["created_at"], strict=True)), config.max_replies)
        idle = 0 if out else idle + 1
        full = stopped or len(seen) >= config.max_replies or idle >= config.idle_scans
        state.update((SEP.join(seen), post[0] if post else None, bool(post and post[1]), SEP.join(sorted(left)), idle, full, began))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["conv_id", "kind", "pos", "id", "handle", "text", "created_at"])

    every = items.withColumn("stop", F.lit(False))
    if stops is not None:
        none = [F.lit(None).cast(items.schema[c].dataType).alias(c) for c in items.columns if c not in ("conv_id", "seq")]
        every = every.unionByName(stops.select("conv_id", "seq", *none, F.lit(True).alias("stop")))
    return every.groupBy("conv_id").applyInPandasWithState(step, MERGED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout)


def merge_batch(items: DataFrame, config: Config = Config()) -> DataFrame:
    """The same over a finished set of items, as DataFrame operations: conv_id, pos, id, handle, text, created_at."""
    post = items.where("focal").groupBy("conv_id").agg(F.min_by("id", F.struct(F.trim(F.coalesce("text", F.lit(""))) == "", "seq")).alias("post_id"))
    told = items.where("not focal and trim(coalesce(text, '')) <> ''").join(post, "conv_id", "left").where("post_id is null or id <> post_id")
    first = told.groupBy("conv_id", "id").agg(F.min("seq").alias("seq"), F.min_by(F.struct("handle", "text", "created_at"), "seq").alias("r"))
    ranked = first.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq")) - 1).where(F.col("pos") < config.max_replies)
    return ranked.select("conv_id", "pos", "id", "r.handle", "r.text", "r.created_at")


def finish_thread(post: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """posts, replies, accounts of merged items: lower-case handles are accounts, the first casing is the name, and a
    reply is never earlier than its post."""
    posts = post.select("conv_id", F.lit("thread").alias("kind"), F.col("id").alias("post_id"), F.col("handle").alias("author"), F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("(post without text)")).alias("text"), "created_at")
    at = posts.select("conv_id", F.col("created_at").alias("posted_at"))
    replies = items.join(at, "conv_id").select("conv_id", "pos", F.col("id").alias("reply_id"), F.lower("handle").alias("account_id"), "handle", "text", F.greatest("created_at", "posted_at").alias("created_at"))
    return posts, replies.drop("handle"), _handles(replies)


def finish_feed(items: DataFrame, site: str, captured_at) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of a feed: a stand-in root one second before its oldest post says how much was captured."""
    replies = items.select("conv_id", "pos", F.col("id").alias("reply_id"), F.lower("handle").alias("account_id"), "handle", "text", "created_at")
    by = replies.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("account_id").alias("a"), F.min("created_at").alias("oldest"))
    at = captured_at if isinstance(captured_at, Column) else F.lit(captured_at).cast("timestamp")
    shown = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd HH:mm")
    text = F.format_string(f"Your {site} feed: %d posts from %d accounts, captured %s UTC", "n", "a", shown)
    posts = by.select("conv_id", F.lit("feed").alias("kind"), F.concat(F.lit("feed-"), F.unix_timestamp(at).cast("string")).alias("post_id"), F.lit(f"your {site} feed").alias("author"), text.alias("text"), (F.col("oldest") - F.expr("INTERVAL 1 SECOND")).alias("created_at"))
    return posts, replies.drop("handle"), _handles(replies)


def _handles(replies: DataFrame) -> DataFrame:
    none = F.lit(None).cast("int")
    by = replies.groupBy("conv_id", "account_id").agg(F.min_by("handle", "pos").alias("username"), F.min("pos").alias("first_pos"))
    return by.select("*", none.alias("account_age_days"), none.alias("followers"), none.alias("following"), none.alias("total_posts"))


def next_wait(now: int, since: int | None, config: Config = Config()) -> tuple[int, int]:
    """since (when the first item still unanalysed came) and the milliseconds to wait for more, 0 when time is up."""
    since = now if since is None else since
    return since, max(0, min(config.quiet_ms, since + config.longest_wait_ms - now))


def due(merged: DataFrame, config: Config = Config()) -> DataFrame:
    """A stream of merged items to conv_id and the number of new items, once a conversation has been quiet for
    config.quiet_ms, at the latest config.longest_wait_ms after the first of them."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, n = state.get if state.exists else (None, 0)
        wait = 0
        if not state.hasTimedOut:
            n += sum(len(f) for f in frames)
            since, wait = next_wait(state.getCurrentProcessingTimeMs(), since, config)
        if wait:
            state.update((since, n))
            state.setTimeoutDuration(wait)
            return
        if state.exists:
            state.remove()
        yield pd.DataFrame({"conv_id": [key[0]], "items": [n]})

    return merged.groupBy("conv_id").applyInPandasWithState(step, "conv_id string, items long", "since long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def reanalyse(merged: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 6, once: bool = False):
    """Runs `run` on the conversations that grew in each batch, at most every `seconds` (the longest wait)."""

    def batch(df: DataFrame, n: int) -> None:
        grown = df.select("conv_id").distinct()
        if not grown.isEmpty():
            run(grown, n)

    writer = merged.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def watch(items: DataFrame, folder: str, run: Callable[[DataFrame, int], None], config: Config = Config(), stops: DataFrame | None = None) -> tuple:
    """Captures a stream of items and analyses conversations anew as they grow: the two running queries.

    The first merges scans and appends what is new to the table folder/items. The second follows that table, waits for each
    conversation until it has been quiet for config.quiet_ms, at most config.longest_wait_ms, and then gives `run` all
    merged rows of the conversations that are due and the number of the batch. Both keep their places in the folder, so
    they go on where they were after a restart; a batch that is repeated gives `run` its number again.
    """
    spark, table = items.sparkSession, f"{folder}/items"
    first = merge_scans(items, config, stops=stops).writeStream.format("parquet").option("path", table).option("checkpointLocation", f"{folder}/merge-state").start()
    new = spark.readStream.schema(MERGED).parquet(f"{table}*")

    def batch(df: DataFrame, n: int) -> None:
        grown = df.select("conv_id").distinct()
        if not grown.isEmpty():
            run(spark.read.schema(MERGED).parquet(table).join(grown, "conv_id", "left_semi"), n)

    second = due(new, config).writeStream.option("checkpointLocation", f"{folder}/due-state").foreachBatch(batch).start()
    return first, second


def progress(df: DataFrame, name: str = "progress") -> DataFrame:
    """df with counters of its rows and conversations, which listeners and batch observers can poll."""
    return df.observe(name, F.count("*").alias("items"), F.approx_count_distinct("conv_id").alias("conversations"))


def live_status(spark: SparkSession, checkpoint: str) -> DataFrame:
    """conv_id, status, replies, has_post, waiting (items seen without text) of the conversations that a capture of
    `merge_scans` holds in the state of its checkpoint, as of its last whole batch; it may run or have stopped.

    status is COLLECTING, or FULL once the conversation takes nothing more: at the cap, stopped by the user, idle, or out of
    time. The rows come from the state stores in parallel; a conversation whose state has gone has none. A capture that
    has not finished a batch is an error, as it has no state yet.
    """

    def size(c: str) -> Column:
        return F.size(F.filter(F.split(c, SEP), lambda x: x != "")).cast("long")

    held = spark.read.format("statestore").load(checkpoint).select("key.conv_id", "value.groupState.*")
    status = F.when(F.col("full"), "FULL").otherwise("COLLECTING").alias("status")
    return held.select("conv_id", status, size("ids").alias("replies"), F.col("post").isNotNull().alias("has_post"), size("skipped").alias("waiting"))


def batches(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """batch, rows_in, items, conversations, state_rows, millis of the query's last batches (Spark keeps 100 by default),
    which may run; items and conversations are null without `progress`."""
    rows = []
    for p in query.recentProgress:
        seen = next((m.asDict() for m in p.observedMetrics.values()), {})
        state = [o.numRowsTotal for o in p.stateOperators]
        rows.append((p.batchId, p.numInputRows, seen.get("items"), seen.get("conversations"), sum(state) if state else None, p.batchDuration))
    return spark.createDataFrame(rows, "batch long, rows_in long, items long, conversations long, state_rows long, millis long")
