"""Ranked lexical search over inverted treaps.

`build_index` cuts documents into blocks of about `block` terms as they lie in the input's partitions, so no text moves.
A block is one row: its documents' ids and sizes, its terms, and each term's postings (document, occurrences) in the
order of documents. `search` gathers from all blocks the document frequencies of the items' terms, and then makes, block
by block, an inverted treap of each such term's postings: in search order the documents' places in the block, in heap
order their impacts. Ties in impact are ordered by a hash of the place, so that treaps stay shallow.

The treaps of an item's terms are walked together. A state is an interval of documents with, for each term, the node of
the greatest impact inside it; the sum of these impacts bounds every document of the interval. States whose sum can't
reach the item's k-th best score so far are pruned with all their subtrees; of the others those with the greatest sums
go first: the document of the state's greatest impact is scored, and the interval is split there, each term's nodes
walking down to the greatest impact on either side. Intervals of up to LEAF documents are scored whole. A task carries
each item's k-th best score from block to block, hands on k rows for each item, and windows that Spark cuts down in each
task rank them.

Scores are whole numbers, as `impact` and `weight` have them, so they are the same however blocks are cut. Items are
taken in batches of about `batch`, dealt by hash, which bounds what is broadcast: a batch's terms and weights.

Defined cases. A null text has no terms, nor has an empty one; documents without a term count nowhere and are never
found; items without a term, or whose terms no document holds, have no rows. Documents with equal or null ids are
documents each, null ids coming last among equal scores; of repeated items each gets its rows. Texts are taken whole,
whatever their length. Columns besides the two that are named are not read. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from choralis.llm.common import CHUNK_CHARS, chunks, map_arrow, written

#: ASCII but digits and letters separates; A-Z become a-z; all other bytes of UTF-8 stay.
FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
#: Documents of an interval that is scored whole.
LEAF = 64
#: States that are expanded together.
AT_ONCE = 256
INDEX = "block long, ids array<long>, sizes array<long>, terms array<string>, counts array<long>, docs array<int>, times array<long>"


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(times: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence of a term adds to a document's score, by unit of the term's weight."""
    m = 100 - 75 + 75 * size * n_docs // n_terms
    return 1_000_000_000 * times // (1000 * times + 8 * m)


# -- the index


class _Block:
    def __init__(self) -> None:
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids: list[int | None] = []
        self.found: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        self.ids.append(doc_id)
        self.found.append(np.fromiter(map(self.vocabulary.__getitem__, terms), np.int64, len(terms)))
        self.held += len(terms)

    def row(self, block: int) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in self.found], dtype=np.int64)
        n = max(1, len(sizes))
        key, times = np.unique(np.concatenate(self.found) * n + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
        counts = np.bincount(key // n, minlength=len(self.vocabulary))
        columns = [
            pa.array(self.ids, pa.int64()), pa.array(sizes), pa.array([t.decode("utf-8", "replace") for t in self.vocabulary], pa.string()),
            pa.array(counts.astype(np.int64)), pa.array((key % n).astype(np.int32)), pa.array(times.astype(np.int64)),
        ]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        names = ["ids", "sizes", "terms", "counts", "docs", "times"]
        return pa.RecordBatch.from_pydict({"block": pa.array([block])} | dict(zip(names, lists, strict=True)))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = 3_000_000) -> DataFrame:
    """A row for each block of documents that hold a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k = _Block(), 0
        for batch, texts in chunks(batches):
            for i, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                found = terms_of(t)
                if found:
                    now.add(i, found)
                if now.held >= block:
                    yield now.row(k)
                    now, k = _Block(), k + 1
        if now.held:
            yield now.row(k)

    return map_arrow(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, INDEX)


def written_index(index: DataFrame) -> DataFrame:
    """index as a table with a row group for each block. Readers take a group's rows into memory together and writers hold
    them till it ends, so a task has one block at a time, however many blocks its file has."""
    return written(index, "ranked-index", {"parquet.block.row.count.limit": "1"})


# -- treaps


def treaps(priority: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right children of each posting, and the roots, of one treap for each range of postings; -1 is no node."""
    left, right, roots = [-1] * len(priority), [-1] * len(priority), []
    height = priority.tolist()
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        spine: list[int] = []  # nodes from the root along right children
        for v in range(a, b):
            last = -1
            h = height[v]
            while spine and height[spine[-1]] < h:
                last = spine.pop()
            left[v] = last
            if spine:
                right[spine[-1]] = v
            spine.append(v)
        roots.append(spine[0] if spine else -1)
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(roots, dtype=np.int64)


@dataclass
class Postings:
    """The treaps of some terms of a block. Arrays over postings end with one for no node (-1)."""

    n: int  # documents of the block
    key: np.ndarray  # term * n + document, ascending
    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: np.ndarray  # by term

    @classmethod
    def of(cls, row: dict[str, np.ndarray], wanted: np.ndarray, n_docs: int, n_terms: int) -> Postings:
        """wanted: places in the block's terms; they become terms 0, 1, ..."""
        n = len(row["sizes"])
        upto = np.cumsum(row["counts"])
        size = row["counts"][wanted]
        ends = np.cumsum(size)
        at = np.repeat(upto[wanted] - ends, size) + np.arange(size.sum())
        doc = row["docs"][at].astype(np.int64)
        worth = impact(row["times"][at].astype(np.int64), row["sizes"][doc], n_docs, n_terms)
        mixed = (doc + 1) * np.int64(0x9E3779B97F4A7C1) >> 16 & 0xFFFFF
        left, right, root = treaps(worth << 20 | mixed, ends - size, ends)
        key = np.repeat(np.arange(len(wanted)), size) * n + doc
        return cls(n, key, np.append(doc, -1), np.append(worth, 0), np.append(left, -1), np.append(right, -1), root)

    def inside(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """From nodes (state x term) down to those of the greatest impact with low <= document < high."""
        node = node.copy()
        flat, low, high = node.reshape(-1), np.repeat(low, node.shape[1]), np.repeat(high, node.shape[1])
        out = np.flatnonzero(flat >= 0)
        while len(out):
            v = flat[out]
            d = self.doc[v]
            under, over = d < low[out], d >= high[out]
            off = under | over
            out, v = out[off], v[off]
            flat[out] = np.where(under[off], self.right[v], self.left[v])
            out = out[flat[out] >= 0]
        return node

    def worth_of(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Impacts (document x term), 0 where the document doesn't hold the term."""
        want = terms * self.n + docs[:, None]
        at = np.searchsorted(self.key, want)
        return np.where(np.append(self.key, -1)[at] == want, self.impact[at], 0)


def best_of_block(p: Postings, terms: np.ndarray, weights: np.ndarray, k: int, least: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the block, best first, and scores: the k best of those with a score of at least `least`, above 0.
    ids order equal scores."""
    score = np.zeros(p.n, dtype=np.int64)
    known = np.zeros(p.n, dtype=bool)
    least = max(1, least)
    node, low, high = p.root[terms][None, :], np.zeros(1, np.int64), np.full(1, p.n)
    bound = (p.impact[node] * weights).sum(axis=1)
    leaves: list[np.ndarray] = []
    tops = np.zeros(0, dtype=np.int64)
    while len(node):
        alive = bound >= least
        small = alive & (high - low <= LEAF)
        if small.any():
            leaves.append(np.c_[low, high][small])
        alive &= ~small
        node, low, high, bound = node[alive], low[alive], high[alive], bound[alive]
        if not len(node):
            break
        now = np.argsort(-bound, kind="stable")[:AT_ONCE]
        head, a, b = node[now], low[now], high[now]
        part = p.impact[head] * weights
        pivot = p.doc[head[np.arange(len(head)), part.argmax(axis=1)]]
        score[pivot] = p.worth_of(terms, pivot) @ weights
        known[pivot] = True
        tops = np.sort(np.r_[tops, score[pivot]])[-k:]
        if len(tops) == k:
            least = max(least, int(tops[0]))
        sides = [p.inside(head, a, pivot), p.inside(head, pivot + 1, b)]
        rest = np.ones(len(node), dtype=bool)
        rest[now] = False
        node = np.concatenate([node[rest], *sides])
        low, high = np.r_[low[rest], a, pivot + 1], np.r_[high[rest], pivot, b]
        bound = np.r_[bound[rest], *((p.impact[x] * weights).sum(axis=1) for x in sides)]
    if leaves:
        spans = np.concatenate(leaves)
        spans = spans[spans[:, 0].argsort()]
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            first, last = np.searchsorted(p.key, spans + t * p.n).T
            size = last - first
            at = np.repeat(last - np.cumsum(size), size) + np.arange(size.sum())
            score[p.doc[at]] += np.where(known[p.doc[at]], 0, w * p.impact[at])
    found = np.flatnonzero(score >= least)
    if len(found) > k:
        cut = np.partition(score[found], len(found) - k)[len(found) - k]
        found = found[score[found] >= cut]
    order = np.lexsort((ids[found], -score[found]))[:k]
    return found[order], score[found[order]]


# -- the search


@dataclass
class Batch:
    ids: list[int | None]  # of its items
    lexicon: list[str]
    terms: list[np.ndarray]  # of each item, places in the lexicon
    weights: list[np.ndarray]  # an item's weights of them, repeats included


def item_terms(items: DataFrame, item_id: str, text: str, batches: int) -> DataFrame:
    """item_id, its terms and their repeats, and the batch it is dealt to."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(rows):
            told = [Counter(terms_of(t)) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "item_id": batch.column(0), "batch": batch.column(1), "terms": pa.array([[t.decode("utf-8", "replace") for t in c] for c in told], pa.list_(pa.string())),
                "repeats": pa.array([list(c.values()) for c in told], pa.list_(pa.int64())),
            })

    dealt = F.pmod(F.xxhash64(item_id, text), F.lit(batches)).alias("batch")
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), dealt, F.col(text).alias("text"))
    return map_arrow(rows, run, "item_id long, batch long, terms array<string>, repeats array<long>").where("size(terms) > 0")


def _search_batch(index: DataFrame, batch: Batch, n_docs: int, n_terms: int, k: int) -> DataFrame:
    held = index.sparkSession.sparkContext.broadcast(batch)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = held.value
        best: list[list[tuple[int, bool, int | None]]] = [[] for _ in b.ids]  # (-score, no id, id), best first
        lexicon = pa.array(b.lexicon, pa.string())
        for batch in rows:
            for r in range(batch.num_rows):
                lists = {name: batch.column(name)[r].values for name in batch.schema.names if name != "block"}
                place = pc.fill_null(pc.index_in(lexicon, value_set=lists["terms"]), -1).to_numpy(zero_copy_only=False)
                own = np.flatnonzero(place >= 0)
                if not len(own):
                    continue
                local = np.full(len(place), -1)
                local[own] = np.arange(len(own))
                row = {name: lists[name].to_numpy(zero_copy_only=False) for name in ("sizes", "counts", "docs", "times")}
                p = Postings.of(row, place[own], n_docs, n_terms)
                ids = pc.fill_null(lists["ids"], 2**63 - 1).to_numpy(zero_copy_only=False)
                for i, (terms, weights) in enumerate(zip(b.terms, b.weights, strict=True)):
                    mine = local[terms]
                    there = mine >= 0
                    if there.any():
                        least = -best[i][-1][0] if len(best[i]) == k else 0
                        docs, scores = best_of_block(p, mine[there], weights[there], k, least, ids)
                        told = [(lists["ids"][d].as_py(), s) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
                        best[i] = sorted([*best[i], *((-s, d is None, d or 0) for d, s in told)])[:k]
        which = [i for i, x in enumerate(best) for _ in x]
        flat = [x for y in best for x in y]
        yield pa.RecordBatch.from_pydict({
            "item": pa.array(which, pa.int64()), "item_id": pa.array([b.ids[i] for i in which], pa.int64()),
            "doc_id": pa.array([None if none else d for _, none, d in flat], pa.int64()), "score": pa.array([-s for s, _, _ in flat], pa.int64()),
        })

    return map_arrow(index, run, "item long, item_id long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", batch: int = 1_000) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of a written index for each item."""
    total = index.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y)).alias("l")).head()
    n_docs, n_terms = total.n or 0, total.l or 0
    n_items = items.count()
    batches = max(1, -(-n_items // batch))
    asked = written(item_terms(items, item_id, text, batches), "ranked-items")
    wanted = asked.select("batch", F.explode("terms").alias("term")).distinct()
    each = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    df = each.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    df = written(wanted.join(df, "term"), "ranked-df")  # terms that no document holds are out
    found = []
    for b in range(batches):
        own = {r.term: r.df for r in df.where(F.col("batch") == b).toLocalIterator()}
        at = {t: i for i, t in enumerate(sorted(own))}
        told = Batch([], list(at), [], [])
        for r in asked.where(F.col("batch") == b).toLocalIterator():
            kept = [(at[t], c * weight(n_docs, own[t])) for t, c in zip(r.terms, r.repeats, strict=True) if t in at]
            told.ids.append(r.item_id)
            told.terms.append(np.array([x for x, _ in kept], dtype=np.int64))
            told.weights.append(np.array([x for _, x in kept], dtype=np.int64))
        found.append(_search_batch(index, told, n_docs, max(1, n_terms), k).withColumn("batch", F.lit(b)))
    order = Window.partitionBy("batch", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
