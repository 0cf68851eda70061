"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order up to `order`. A byte's code length is found from the longest
context that the tree has: a context with n bytes of q kinds gives a byte seen c times the probability c / (n + q) and
an escape q / (n + q) to the next shorter context; below the empty context all 256 bytes are equally likely. Statistics
are frozen after training, so a byte's code length depends on it and the `order` bytes before it alone: it is computed
exactly once for each run of bytes in a chunk and summed over whole texts. The language with the shortest code wins,
ties fall to the first by code point; the score is its posterior under equal priors.

Learning is bounded: at most `max_docs` distinct texts of each language, of `max_chars` characters together, go to the
driver, the least by the hash of the text, whatever the number of documents. Each language has a tree of its own, and
all trees are broadcast, so more than `max_langs` distinct languages end with an error.

Null and empty texts, texts without a letter, and all texts where nothing was learnt, as from an empty table, are `und`
with score 0. Very long texts are coded whole, one at a time. A text under several languages is learnt for each; rows
that repeat are learnt from once and predicted each. Input columns named lang_pred or score, in any case of
letters, are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choralis.llm.common import chunks, few, least_hashes, map_arrow, schema_without, without, written

LETTER = regex.compile(r"\p{L}")
BEFORE = b"\n"
#: Keys of sampled texts up to this number (some 30 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n-byte runs of data as integers, by their last byte; the first n - 1 are left out."""
    key = np.zeros(max(0, len(data) - n + 1), dtype=np.uint64)
    for k in range(n):
        key = key << np.uint64(8) | data[k : len(data) - n + 1 + k]
    return key


def _joined(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, each behind `order` line ends, and where each text begins."""
    data = np.frombuffer(b"".join(BEFORE * order + t for t in texts), dtype=np.uint8)
    sizes = np.fromiter((len(t) + order for t in texts), dtype=np.int64, count=len(texts))
    return data, np.cumsum(sizes) - sizes + order


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), dtype=bool)


@dataclass
class ContextTree:
    """For each order k: sorted runs of k + 1 bytes with counts, sorted contexts of k bytes with totals and kinds."""

    runs: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def learn(texts: list[bytes], order: int) -> ContextTree:
        data, starts = _joined(texts, order)
        inside = np.ones(len(data), dtype=bool)
        for k in range(1, order + 1):
            inside[starts - k] = False
        runs, contexts = [], []
        for k in range(order + 1):
            keys, counts = np.unique(_grams(data, k + 1)[inside[k:]], return_counts=True)
            context, first = np.unique(keys >> np.uint64(8), return_index=True)
            kinds = np.diff(np.r_[first, len(keys)])
            runs.append((keys, counts))
            contexts.append((context, np.add.reduceat(counts, first) if len(first) else counts, kinds))
        return ContextTree(runs, contexts)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths of the last byte of each run of order + 1 bytes."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        for k in range(len(self.runs) - 1, -1, -1):
            g = grams[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            keys, counts = self.runs[k]
            context, total, kinds = self.contexts[k]
            at, hit = _find(keys, g)
            cat, known = _find(context, g >> np.uint64(8))
            n = (total[cat] + kinds[cat]).astype(float) if len(context) else np.ones(len(g))
            out[left[hit]] -= np.log2(counts[at[hit]] / n[hit])
            escape = known & ~hit
            out[left[escape]] -= np.log2(kinds[cat[escape]] / n[escape])
            left = left[~hit]
        out[left] += 8
        return out


@dataclass
class LanguageModel:
    names: list[str]
    trees: list[ContextTree]
    order: int

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        total = np.zeros((len(texts), len(self.names)))
        data, starts = _joined(texts, self.order)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        keys = _grams(data, self.order + 1)
        kinds, at = _kinds(keys, self.order)
        full = np.flatnonzero(sizes)
        if not len(full):
            return total
        first = starts[full] - self.order
        # sums run from one text's first byte to the next one's: leave out what lies between
        cuts = np.ravel(np.column_stack([first, first + sizes[full]]))
        cuts = cuts[cuts < len(at)]
        for j, tree in enumerate(self.trees):
            cost = tree.bits(kinds)[at]
            total[full, j] = np.add.reduceat(cost, cuts)[::2]
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        told = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        if told and self.names:
            bits = self.code_lengths([texts[i].encode() for i in told])
            best = bits.argmin(axis=1)
            sure = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
            for i, b, s in zip(told, best.tolist(), sure.tolist(), strict=True):
                names[i], scores[i] = self.names[b], s
        return names, scores


def _kinds(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs, and which of them each place has."""
    if order == 3 and len(keys):
        pairs = np.zeros(1 << 16, dtype=bool)
        high, low = (keys >> np.uint64(16)).astype(np.int64), (keys & np.uint64(0xFFFF)).astype(np.int64)
        pairs[high] = pairs[low] = True
        met = np.flatnonzero(pairs)
        if len(met) <= 6_000:
            rank = np.zeros(1 << 16, dtype=np.int64)
            rank[met] = np.arange(len(met))
            cell = rank[high] * len(met) + rank[low]
            seen = np.zeros(len(met) ** 2, dtype=bool)
            seen[cell] = True
            cells = np.flatnonzero(seen)
            index = np.zeros(len(seen), dtype=np.int32)
            index[cells] = np.arange(len(cells), dtype=np.int32)
            return (met[cells // len(met)].astype(np.uint64) << np.uint64(16)) | met[cells % len(met)].astype(np.uint64), index[cell]
    return np.unique(keys, return_inverse=True)


def learn_languages(docs: DataFrame, max_docs: int = 800, order: int = 3, max_chars: int = 20_000_000, max_langs: int = 200) -> LanguageModel:
    """docs: text, lang; only rows that may be learnt from. Learns from at most max_docs distinct texts of each language, of
    max_chars characters together besides a single longer text; more than max_langs languages are an error."""
    told = docs.where("lang is not null and text <> ''").select("lang", F.xxhash64("text").alias("h"), F.length("text").alias("size"))
    each = told.groupBy("lang", "h").agg(F.min("size").alias("size"))  # copies count once
    drawn = written(least_hashes(each, "lang", "h", max_docs, "size", max_chars).drop("size"), "language-sample")
    few(drawn.select("lang").distinct().limit(max_langs + 1).collect(), max_langs, "languages")
    if drawn.count() <= BROADCAST_ROWS:
        drawn = F.broadcast(drawn)
    whole = docs.where("lang is not null and text <> ''").select("lang", "text", F.xxhash64("text").alias("h"))
    texts: dict[str, list[bytes]] = {}
    for r in whole.join(drawn, ["lang", "h"]).groupBy("h", "lang").agg(F.first("text").alias("text")).toLocalIterator():
        texts.setdefault(r.lang, []).append(r.text.encode())
    names = sorted(texts)
    return LanguageModel(names, [ContextTree.learn(sorted(texts[x]), order) for x in names], order)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred and score. The model is bounded by the training texts, so it is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    new = ("lang_pred", "score")
    schema = schema_without(docs, *new).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch, texts in chunks(batches):
            names, scores = m.predict(texts)
            yield pa.RecordBatch.from_pydict(without(batch, *new) | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return map_arrow(docs, run, schema)
