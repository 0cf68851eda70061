"""Line dedup by distinct-site spread, in DataFrame functions only.

A line's key is the 64-bit hash of its text without outer white space. The sites (sources) of each key are sketched
with HyperLogLog, partially in each task and merged by key. Keys whose estimate clearly reaches `min_sites` are
boilerplate; those whose estimate lies within NEAR of the threshold get an exact distinct count. (At 2^10 registers the
standard error is 3.3 %, so NEAR is six of them; up to some dozen sites sketches count without error.) Of a
boilerplate line the occurrence in the document with the least id stays (of several in it, the first), all others go, so
no text leaves the corpus entirely.

Defined cases. Lines without a word are never boilerplate. A null source counts as one site. A null text stays null, an
empty one empty. Ties between rows with one doc_id, null ids last, fall to the least hash of all columns. Of rows that
agree in all columns one keeps the line, the others lose it. Texts of any length are taken whole; the work on one is
linear in its lines. Documents keep their other lines and line order; `emptied` marks those that have lost every word.
An empty table gives an empty one. The names of the two new columns get underscores where the input has such columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choralis.llm.common import free_name, quoted, row_key_of, written

#: Boilerplate keys up to this number (16 bytes each) may be broadcast; more are joined by a shuffle on salted keys.
BROADCAST_KEYS = 500_000
SALTS = 16
LG_K, NEAR = 10, 0.2
EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def line_rows(docs: DataFrame) -> DataFrame:
    """key, site, doc, row, pos, of each line that has a word; docs: doc_id, text, source, row."""
    lines = docs.select(
        F.col("doc_id").alias("doc"),
        "row",
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("none")).alias("site"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    )
    trimmed = F.regexp_replace("line", EDGE, "")
    return lines.withColumn("line", trimmed).where("line <> ''").select(F.xxhash64("line").alias("key"), "site", "doc", "row", "pos")


def boilerplate(lines: DataFrame, min_sites: int, most_broadcast: int = BROADCAST_KEYS) -> DataFrame:
    """Keys on at least min_sites distinct sites, with the place that stays."""
    first = F.min(F.struct(F.col("doc").isNull().alias("n"), "doc", "row", "pos")).alias("first")
    many = lines.groupBy("key").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), first)
    sized = many.select("key", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - NEAR))
    sized = written(sized, "line-spread")
    clear = sized.where(F.col("sites") > min_sites * (1 + NEAR)).select("key", "first")
    near = sized.where(F.col("sites") <= min_sites * (1 + NEAR))
    exact = lines.join(F.broadcast(near.select("key")) if near.count() <= most_broadcast else near.select("key"), "key", "left_semi")
    exact = exact.select("key", "site").distinct().groupBy("key").count().where(F.col("count") >= min_sites).select("key")
    return clear.unionByName(near.join(exact, "key", "left_semi").select("key", "first"))


def _gone(rows: DataFrame, spread: DataFrame, most_broadcast: int) -> DataFrame:
    """Of each row with boilerplate: its positions in `others`, those but the places that stay in `gone`, and how many
    copies the row has, if it has such places."""
    if spread.count() <= most_broadcast:
        met = rows.join(F.broadcast(spread), "key")
    else:
        salt = F.pmod(F.hash("row"), F.lit(SALTS))
        met = rows.withColumn("salt", salt).join(spread.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), ["key", "salt"])
    met = met.select("row", "pos", (F.col("first.row").eqNullSafe(F.col("row")) & (F.col("first.pos") == F.col("pos"))).alias("stays"))
    each = met.groupBy("row", "pos", "stays").agg(F.count("*").alias("copies"))  # copies of a row meet here
    return each.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.col("pos")))).alias("gone"),
        F.sort_array(F.collect_list("pos")).alias("others"),
        F.coalesce(F.max(F.when(F.col("stays"), F.col("copies"))), F.lit(1).cast("long")).alias("copies"),
    )


def dedup_lines(docs: DataFrame, min_sites: int = 3, most_broadcast: int = BROADCAST_KEYS) -> DataFrame:
    """docs (doc_id, text, source and any others) with cleaned text, and n_removed and emptied besides."""
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("whole"), "doc_id", "text", "source", row_key_of(docs).alias("row"))
    rows = written(line_rows(whole), "line-keys")
    gone = _gone(rows, written(boilerplate(rows, min_sites, most_broadcast), "line-boilerplate"), most_broadcast)
    gone = written(gone, "line-gone")
    # texts meet by their keys at any size, for a broadcast would only do where `gone` is small
    joined = whole.select("whole", "row").join(gone.hint("merge"), "row", "left")
    plain = joined.where("copies is null or copies = 1").select("whole", "gone")
    # rows that agree in all columns and hold a place that stays: one of them keeps it
    twins = whole.select("whole", "row").join(gone.where("copies > 1"), "row")
    twins = twins.groupBy("row").agg(F.first("whole").alias("whole"), F.first("gone").alias("gone"), F.first("others").alias("others"), F.first("copies").alias("copies"))
    twins = twins.select("whole", "gone", "others", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("k"))
    twins = twins.select("whole", F.when(F.col("k") == 1, F.col("gone")).otherwise(F.col("others")).alias("gone"))
    cut = plain.unionByName(twins).select("whole", "gone", F.split("whole.text", "\n").alias("lines"))
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda x: x + 1))
    ends = F.concat("gone", F.array(F.size("lines")))
    kept = F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("lines", a + 1, b - a))), "\n")
    n = F.when(F.size("gone") > 0, F.size("gone")).otherwise(0).cast("long")
    out = cut.select("whole", F.when(n > 0, kept).otherwise(F.col("whole.text")).alias("text"), n.alias("n"))
    cols = [F.col("text").alias(c) if c == "text" else F.col("whole").getField(c).alias(c) for c in docs.columns]
    empty = (F.col("n") > 0) & (F.regexp_replace("text", EDGE, "") == "")
    removed = free_name("n_removed", docs.columns)
    return out.select(*cols, F.col("n").alias(removed), empty.alias(free_name("emptied", [*docs.columns, removed])))
