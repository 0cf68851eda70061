"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source gets the expected number of copies r = target / size of its source, between 0 and 3. Rows
that agree in all columns are one unit: k of them are worth k r copies. The whole part of that is taken for certain, the
rest is the unit's inclusion probability, which is worth one copy of its size. The flight phase moves the probabilities
of three units at a time along the null-space of the constraints (number of documents, number of words) until one of
them is 0 or 1, in either direction with the odds that keep each expectation. It runs in blocks of about `block` units;
the at most two units that a block leaves open meet those of other blocks of their source in the next round, until a
source has at most two. These land on the choice that comes nearest to the source's words. All draws come from hashes of
the rows, so reruns agree.

Defined cases. Null sources are a source, the last one; null and empty texts have size 0, and sources without words are
taken 0 times. The copies of a unit of equal rows are dealt out evenly among them. An empty table gives an empty mix.
Texts of any length count whole; columns besides doc_id, text and source only tell rows apart, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choralis.llm.common import lean_worker, quoted, row_key_of, word_count, written

WEIGHTS = (5, 2, 1)
MOST = 3
NEAR = 1e-9
#: Copies of one unit that a task puts out.
COPIES = 100_000


def ranked_sources(sized: DataFrame) -> DataFrame:
    """source, n, source_size and sid, the source's rank by code point, nulls last. Ranks are counted within ranges of
    sources, behind the numbers of the ranges before, so sources may be many."""
    by = sized.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = F.col("source").asc_nulls_last()
    ranged = written(by.repartitionByRange(order).select("*", F.spark_partition_id().alias("range")), "mix-sources")
    count = ranged.groupBy("range").agg(F.count("*").alias("in_range"))
    before = F.coalesce(F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    within = F.row_number().over(Window.partitionBy("range").orderBy(order))
    placed = ranged.withColumn("within", within).join(count.withColumn("before", before), "range")
    return placed.select("source", "n", "source_size", (F.col("before") + F.col("within") - 1).cast("long").alias("sid"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, sid, n (rows), source_size, target: one row for each source, of sized (source, size, n).

    Weights are filled up to a common level; sources that reach `most` times their size leave the rest to the others,
    whose level rises, until none is above.
    """
    cases = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    by = ranked_sources(sized).withColumn("w", cases.cast("double")).withColumn("cap", F.col("source_size") * float(most))
    by = written(by, "mix-weights")
    total = float(by.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("w") * level
        row = by.agg(F.sum(F.when(full, F.col("cap"))).alias("held"), F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        if not row.open or (total - (row.held or 0.0)) / row.open <= level:
            break
        level = (total - (row.held or 0.0)) / row.open
    return by.select("source", "sid", "n", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def fly(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Flight phase: p with all but at most two entries moved to 0 or 1; sums of p and of p * size stay."""
    p = p.astype(float).tolist()
    size = size.astype(float).tolist()
    coming = iter([i for i, x in enumerate(p) if NEAR < x < 1 - NEAR])
    held: list[int] = []
    turn = 0
    draw = draw.tolist()
    while True:
        while len(held) < 3 and (i := next(coming, None)) is not None:
            held.append(i)
        if len(held) == 3:
            a, b, c = held
            v = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
            if v == (0.0, 0.0, 0.0):
                v = (1.0, -1.0, 0.0)
        elif len(held) == 2 and size[held[0]] == size[held[1]]:
            v = (1.0, -1.0)
        else:
            return np.array(p)
        up = down = float("inf")
        for i, x in zip(held, v, strict=True):
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, -p[i] / x), min(down, (p[i] - 1) / x)
        step = up if draw[turn % len(draw)] * (up + down) < down else -down
        turn += 1
        for i, x in zip(held, v, strict=True):
            q = p[i] + step * x
            p[i] = 0.0 if q < NEAR else 1.0 if q > 1 - NEAR else q
        held = [i for i in held if 0 < p[i] < 1]


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of all ways to end the open entries (two at most after a flight), the nearest in words, then in number."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    ways = [[w >> k & 1 for k in range(len(open_))] for w in range(1 << len(open_))]
    p[open_] = min(ways, key=lambda w: (abs(((np.array(w) - p[open_]) * size[open_]).sum()), abs((np.array(w) - p[open_]).sum()), w))
    return p


def _round(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        with lean_worker():
            rows = rows.sort_values(["draw", "key"], kind="stable")
            p = fly(rows["p"].to_numpy(), rows["size"].to_numpy(), rows["draw"].to_numpy())
            return rows.assign(p=land(p, rows["size"].to_numpy()) if last else p)

    return run


def copies(units: DataFrame, seed: int = 1, block: int = 2048) -> DataFrame:
    """units (key, doc_id, source, size, n: one row for each unit of n equal rows) with source_size, target and copies,
    which all rows of the unit have together."""
    targets = written(source_targets(units), "mix-targets")
    told = targets.select(F.col("source").alias("its"), "sid", F.col("n").alias("in_source"), "source_size", "target")
    units = units.join(told, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    r = F.col("n") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    r = F.when(F.abs(r - F.round(r)) < NEAR, F.round(r)).otherwise(r)
    units = units.withColumn("whole", F.floor(r)).withColumn("p", r - F.floor(r))
    h = F.xxhash64(F.lit(seed), "key")
    units = units.withColumn("draw", F.pmod(h, F.lit(1 << 40)) / F.lit(float(1 << 40)))
    blocks = F.ceil(F.col("in_source") / block)
    units = written(units.withColumn("part", F.pmod(F.shiftright(h, 20), blocks)), "mix-units")
    schema = "key long, sid long, size long, p double, draw double, part long"
    open_ = units.where("p > 0").select("key", "sid", "size", "p", "draw", "part")
    most = targets.agg(F.max("n")).first()[0] or 0
    done = None
    while True:
        last = most <= block
        grouped = open_.withColumn("part", F.lit(0).cast("long")) if last else open_
        flown = written(grouped.groupBy("sid", "part").applyInPandas(_round(last), schema), "mix-flight")
        ended = flown.where("p = 0 or p = 1").select("key", F.col("p").cast("long").alias("more"))
        done = ended if done is None else done.unionByName(ended)
        if last:
            break
        open_ = flown.where("p > 0 and p < 1").withColumn("part", F.floor(F.col("part") / (block // 2)))
        most = 2 * (most // block + 1)
    out = units.join(done, "key", "left").withColumn("copies", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long"))
    return out.select("key", "doc_id", "size", "n", "copies", "source_size", "target")


def units_of(docs: DataFrame) -> DataFrame:
    """key, doc_id, source, size in words, and n, how many of docs (doc_id, text, source and any others) are this row."""
    rows = docs.select(row_key_of(docs).alias("key"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    units = rows.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("n"))
    return written(units, "mix-sizes")


def _times(rows: DataFrame, n: str) -> DataFrame:
    """rows, each n times, with k from 0; rows that come very often are dealt to several tasks."""
    zero = F.lit(0).cast("long")
    few = rows.where(F.col(n).between(1, COPIES)).select("*", F.explode(F.sequence(zero, F.col(n) - 1)).alias("k"))
    many = rows.where(F.col(n) > COPIES).select("*", F.explode(F.sequence(zero, F.floor((F.col(n) - 1) / COPIES))).alias("lot"))
    lot: Column = F.col("lot") * COPIES
    many = many.repartition("key", "lot").select(*rows.columns, F.explode(F.sequence(lot, F.least(lot + COPIES, F.col(n)) - 1)).alias("k"))
    return few.unionByName(many)


def mixed_sizes(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows = _times(copies(units_of(docs), seed), "n")
    own = F.floor(F.col("copies") / F.col("n")) + (F.col("k") < F.col("copies") % F.col("n")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * own).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    got = copies(units_of(docs), seed).where("copies > 0").select("key", "n", "copies")
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("whole"), row_key_of(docs).alias("key")).join(got, "key")
    # rows that agree in all columns are taken together, from one of them
    twins = whole.where("n > 1").groupBy("key").agg(F.first("whole").alias("whole"), F.first("n").alias("n"), F.first("copies").alias("copies"))
    return _times(whole.where("n = 1").unionByName(twins.select(*whole.columns)), "copies").select("whole.*")
