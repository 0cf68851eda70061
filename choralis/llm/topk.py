"""Exact top-k inner products with a bit-sliced index.

Vectors are quantised to whole numbers. The index holds them in blocks of about `block` rows as bit slices: for each
component and binary digit a bitmap over the block's rows, after the block's least value is taken off. A query's scores
are built for all rows of a block at once by bitmap arithmetic: each set digit of a query component adds the component's
slices, shifted (their complements where the component is negative), and carry-save adders reduce what has equal weight
to one bitmap a digit. The top rows are then found from the most significant slice downward; the rows that still tie at
the k-th score are told apart by id. Lots of up to `queries` queries meet blocks of the index; of each pair k rows for a
query are passed on, and the best k of all blocks remain. Lots are about as large as blocks, so what is moved is small
beside what is compared; only where there is little to search are they cut finer, so that all tasks have work.

Defined cases. Null vectors, and vectors with null or non-finite components, take no part, nor do rows with a null id.
Vectors meet those of equal length; those without components score 0 with each other. A query's own row is no candidate,
nor are other rows with its id. Fewer than k candidates give fewer rows, an empty table none; rows that repeat are
candidates, and queries, each; equal scores fall to the smaller id. Scores are 64-bit sums and wrap beyond. Columns
besides vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choralis.llm.common import written

SCALE = 64
INDEX = "dim int, block long, n int, low long, digits int, ids binary, slices binary"
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def slices_of(values: np.ndarray) -> tuple[int, np.ndarray]:
    """The least value, and bitmaps (component x digit x words) of what lies above it; row r is bit r % 64 of its word."""
    low = int(values.min(initial=0)) if not values.size else int(values.min())
    above = (values - low).T
    digits = max(1, int(above.max(initial=0)).bit_length())
    n = values.shape[0]
    pad = -n % 64
    out = np.empty((values.shape[1], digits, (n + pad) // 64), dtype=np.uint64)
    for j in range(digits):
        bits = np.pad((above >> j & 1).astype(np.uint8), ((0, 0), (0, pad)))
        out[:, j] = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u8")
    return low, out


def add_up(levels: list[list[np.ndarray]]) -> np.ndarray:
    """Bitmaps by weight, summed: the digits of the row sums, least first. Each step takes three bitmaps of a weight to
    one of that weight and one of the next."""
    out, j = [], 0
    while j < len(levels):
        if j + 1 == len(levels):
            levels.append([])
        held = np.concatenate(levels[j]) if levels[j] else None
        while held is not None and len(held) > 1:
            third = len(held) // 3
            if third:
                a, b, c = held[:third], held[third : 2 * third], held[2 * third : 3 * third]
                u = a ^ b
                levels[j + 1].append(a & b | u & c)
                held = np.concatenate([u ^ c, held[3 * third :]])
            else:
                levels[j + 1].append(held[:1] & held[1:])
                held = held[:1] ^ held[1:]
        if held is None and not any(len(x) for x in levels[j:]):
            break
        out.append(held[0] if held is not None else None)
        j += 1
    words = next(x for x in out if x is not None).shape
    return np.stack([np.zeros(words, np.uint64) if x is None else x for x in out])


def top_rows(digits: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the top k, and of those that tie for what is left."""
    sure, tied = np.zeros_like(valid), valid.copy()
    if int(np.bitwise_count(valid).sum()) <= k:
        return valid, np.zeros_like(valid)
    for s in digits[::-1]:
        with_ = tied & s
        n = int(np.bitwise_count(sure).sum() + np.bitwise_count(with_).sum())
        if n > k:
            tied = with_
        elif n < k:
            sure |= with_
            tied &= ~s
        else:
            return sure | with_, np.zeros_like(valid)
    return sure, tied


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search_block(q: np.ndarray, own: int, ids: np.ndarray, low: int, slices: np.ndarray, flipped: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of a query's top k in one block, whose rows are in the order of ids."""
    digits = slices.shape[1]
    levels: list[list[np.ndarray]] = []
    size = np.abs(q)
    for i in range(int(size.max()).bit_length() if len(size) else 0):
        at = size >> i & 1 == 1
        for part, source in ((at & (q > 0), slices), (at & (q < 0), flipped)):
            if part.any():
                took = source[part]
                while len(levels) < i + digits:
                    levels.append([])
                for j in range(digits):
                    levels[i + j].append(took[:, j])
    valid = np.zeros(slices.shape[2] * 64, dtype=np.uint8)
    valid[: len(ids)] = ids != own
    valid = np.packbits(valid, bitorder="little").view(np.uint64)
    sums = add_up(levels) if any(levels) else np.zeros((1, slices.shape[2]), np.uint64)
    sure, tied = top_rows(sums, valid, k)
    rows, rest = _rows(sure), _rows(tied)
    rows = np.r_[rows, rest[: max(0, k - len(rows))]]
    bits = sums[:, rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)
    score = (bits.astype(np.int64) << np.arange(len(sums))[:, None]).sum(axis=0)
    return ids[rows], score - int(size[q < 0].sum()) * ((1 << digits) - 1) + low * int(q.sum())


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, dim and whole-number components of the vectors (vec_id, embedding) that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where("vec_id is not null and embedding is not null").where(fine)
    return rows.select("vec_id", F.size("embedding").alias("dim"), F.transform(x, lambda v: F.floor(v * scale)).alias("q"))


def build_index(rows: DataFrame, n: int, block: int) -> DataFrame:
    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        values = np.stack(part["q"].to_numpy()).astype(np.int64)
        low, slices = slices_of(values)
        head = part.iloc[0]
        return pd.DataFrame(
            {"dim": [head["dim"]], "block": [head["block"]], "n": [len(part)], "low": [low], "digits": [slices.shape[1]], "ids": [part["vec_id"].to_numpy("<i8").tobytes()], "slices": [slices.tobytes()]}
        )

    blocks = max(1, -(-n // block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    return dealt.groupBy("dim", "block").applyInPandas(build, INDEX)


def search(vectors: DataFrame, every: int = 20, k: int = 20, block: int = 12_000, queries: int = 4_096) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = written(quantised(vectors), "topk-rows")
    n = rows.count()
    asked = rows.where(F.col("vec_id") % every == 0)
    n_asked = asked.count()
    blocks, slots = max(1, -(-n // block)), 2 * spark.sparkContext.defaultParallelism
    lots = max(1, -(-n_asked // queries), min(-(-n_asked // 64), -(-slots // blocks)))
    index = written(build_index(rows, n, block), "topk-index")

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(part["q"].to_numpy()).astype("<i8")
        return pd.DataFrame({"dim": [part["dim"].iloc[0]], "lot": [part["lot"].iloc[0]], "asked": [part["vec_id"].to_numpy("<i8").tobytes()], "q": [values.tobytes()]})

    dealt = asked.withColumn("lot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lots)))
    lot_rows = dealt.groupBy("dim", "lot").applyInPandas(gather, "dim int, lot long, asked binary, q binary")
    lot_rows = written(lot_rows, "topk-queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in batch.to_pylist()):
            ids, asked_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["asked"], "<i8")
            slices = np.frombuffer(r["slices"], "<u8").reshape(r["dim"], r["digits"], -(-r["n"] // 64))
            flipped = ~slices
            q = np.frombuffer(r["q"], "<i8").reshape(len(asked_ids), r["dim"])
            found = [search_block(x, a, ids, r["low"], slices, flipped, k) for a, x in zip(asked_ids.tolist(), q, strict=True)]
            which = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": pa.array(asked_ids[which]),
                    "query": pa.array(which + (r["lot"] << 20)),
                    "vec_id": pa.array(np.concatenate([f[0] for f in found])),
                    "score": pa.array(np.concatenate([f[1] for f in found])),
                }
            )

    lot = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("lot")
    met = index.select("*", lot).repartition(max(lots, 1), "dim", "lot").join(lot_rows, ["dim", "lot"])
    best = met.mapInArrow(run, "query_id long, query long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
