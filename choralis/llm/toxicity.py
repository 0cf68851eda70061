"""Toxicity by two class-conditional Kneser-Ney models over words and word pairs.

Counts are numbers of training texts, so what a text repeats counts once. Each model is absolutely discounted and
interpolated, and sums to 1 over the vocabulary and the unknown word in every context:

  shared(w)      texts of both classes but for what the classes keep, backed off to the continuation counts (in how
                 many contexts a word stands)
  P_c(w)         what the discount leaves of class c's count, and the freed mass times shared(w)
  shared(w | h)  what the discount leaves of the pair's count in both classes, and the freed mass times P_c(w)
  P_c(w | h)     what the discount leaves of class c's count of the pair, and the freed mass times shared(w | h)

The discount is what the next level lets expect, `spread` Poisson deviations and `rare` (for pairs, of which there are
far more, `rare_pair`) besides. So an expression keeps mass of its own in a class only by what it has there beyond the
shared counts, and both classes know rare expressions by the shared counts alone. One constant discount of 0 to 1, as
Kneser-Ney has it, leaves words of a few texts that one class holds by chance as telling as real ones; see the README.

A text's evidence is the largest length-normalised difference of the two log-likelihoods over windows of `window`
words that overlap by half, besides that of the whole text. Toxic language in a small part of a long text thus isn't
thinned out. A logistic curve, fitted on training texts that the counts had not seen, turns both into a score. Its weights
are 0 or more, so more evidence never lowers a score, and without evidence it stays at or below `nothing`.

Learning is bounded: at most `max_docs` distinct labelled texts of each class, of `max_chars` characters together, go to
the driver, the least by the hash of their text; near copies among them count once. Scoring covers every row and whole texts of any length.

Null and empty texts have no evidence; they get the curve's value there, at most `nothing` (0.2). Without labels of both classes, as with empty
tables, each text gets score 0. A doc_id with several labels counts as toxic if one of them says so; a text that
several rows share is learnt from once and counts as toxic if one of the rows does. Rows that repeat, and rows that tie
in any other way, are scored each. A column of the input named like the score, in any case of letters, gives way to it; the
score's column may be named so that none does.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choralis.llm.common import chunks, least_hashes, lean_worker, map_arrow, schema_without, without

ROUNDS = 50
TOKEN_PY = re.compile(r"[^\W_]+")


@dataclass
class ToxicModel:
    words: dict[str, int]  # from 1; 0 is the unknown word
    uni: np.ndarray  # log P(word) of both classes: 2 x (words + 1)
    free: np.ndarray  # log of the mass that a context's pairs leave to the unigram: 2 x (words + 1)
    pair_keys: np.ndarray  # sorted context * (words + 1) + word
    pair: np.ndarray  # log P(word | context) of both classes: 2 x pairs
    curve: tuple[float, float, float]
    window: int
    empty: bool = False

    def log_likelihoods(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log P(w | h) of both classes; h -1: the text's start, which has no context."""
        out = self.uni[:, w].copy()
        inner = h >= 0
        out[:, inner] += self.free[:, h[inner]]
        if len(self.pair_keys):
            key = h * self.uni.shape[1] + w
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            hit = inner & (self.pair_keys[at] == key)
            out[:, hit] = self.pair[:, at[hit]]
        return out

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Two columns: largest window mean and whole mean of log P(w|toxic) - log P(w|ordinary)."""
        found = np.zeros((len(texts), 2))
        ids, ends = [], []
        get = self.words.get
        for t in texts:
            ids += [get(w, 0) for w in TOKEN_PY.findall(t.lower())]
            ends.append(len(ids))
        if not ids:
            return found
        w = np.array(ids, dtype=np.int64)
        h = np.r_[-1, w[:-1]]
        first = np.array([0, *ends[:-1]])
        h[first[first < len(w)]] = -1
        logs = self.log_likelihoods(h, w)
        total = np.r_[0.0, np.cumsum(logs[1] - logs[0])]
        for i, (a, b) in enumerate(zip(first.tolist(), ends, strict=True)):
            if b > a:
                found[i, 1] = (total[b] - total[a]) / (b - a)
                if b - a <= self.window:
                    found[i, 0] = (total[b] - total[a]) / max(b - a, self.window // 2)
                else:
                    at = np.append(np.arange(a, b - self.window, self.window // 2), b - self.window)
                    found[i, 0] = (total[at + self.window] - total[at]).max() / self.window
        return found

    def telling(self) -> ToxicModel:
        """The model for evidence alone: without the words whose classes' log-likelihoods differ by as much as those of the
        unknown word, wherever they stand."""
        gap = self.uni[1] - self.uni[0]
        loose = self.free[1] - self.free[0]
        n = self.uni.shape[1]
        own = (np.abs(gap - gap[0]) > 1e-12) | (np.abs(loose - loose[0]) > 1e-12)
        own[0] = True
        own[self.pair_keys // n] = own[self.pair_keys % n] = True
        new = np.cumsum(own) - 1
        keys = new[self.pair_keys // n] * int(own.sum()) + new[self.pair_keys % n]
        words = {w: int(new[i]) for w, i in self.words.items() if own[i]}
        return replace(self, words=words, uni=self.uni[:, own], free=self.free[:, own], pair_keys=keys)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.empty:
            return np.zeros(len(texts))
        x = self.evidence(texts)
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * x[:, 0] + c * x[:, 1], -30, 30)))


def training_texts(docs: DataFrame, labels: DataFrame, max_docs: int, max_chars: int = 20_000_000) -> DataFrame:
    """text, toxic (0/1) and fold (0 to 3) of the distinct labelled texts of each class whose hashes are the least, at most
    max_docs and, behind the first, of max_chars characters. Only ids and hashes meet the labels."""
    wide = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = docs.where("text <> ''").select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("size")).join(wide, "doc_id")
    each = told.groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"), F.min("size").alias("size"))  # copies count once
    one = least_hashes(each, "toxic", "h", max_docs, "size", max_chars).drop("size")
    texts = docs.select("doc_id", "text").join(F.broadcast(one), "doc_id")  # at most 2 * max_docs rows of 20 bytes
    texts = texts.where(F.xxhash64("text") == F.col("h")).groupBy("h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return texts.select("text", "toxic", F.pmod(F.col("h"), F.lit(4)).alias("fold"))


def near_key(tokens: list[str]) -> int:
    """The least hash of the text's three-word runs: near copies mostly agree in it."""
    return min(map(_hash3, zip(tokens, tokens[1:], tokens[2:], strict=False)), default=_hash3(tuple(tokens)))


def _hash3(run: tuple) -> int:
    return zlib.crc32(" ".join(run).encode())


def learn_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 4_000, window: int = 8, spread: float = 2.0, rare: float = 1.0, rare_pair: float = 10.0, nothing: float = 0.2, max_chars: int = 20_000_000) -> ToxicModel:
    """docs: doc_id, text; labels: doc_id, toxic. Only rows that may be learnt from. Learns from at most max_docs distinct
    texts of each class, of max_chars characters together besides a single longer text; nothing: the highest score that a
    text without evidence may get."""
    told = training_texts(docs, labels, max_docs, max_chars)
    with lean_worker():  # the driver lives on as a worker does
        return _fitted(told, window, spread, rare, rare_pair, nothing)


def _fitted(told: DataFrame, *settings: float) -> ToxicModel:
    """The model of training_texts; their texts and counts go with this call."""
    return fit_toxicity([(r.text, r.toxic, r.fold) for r in told.toLocalIterator()], *settings)  # at most 2 * max_docs texts


def _held(n: np.ndarray, total: np.ndarray | float, expected: np.ndarray, spread: float, rare: float) -> np.ndarray:
    """The shares of total that discounted counts n keep; expected: shares that the next level gives them."""
    e = total * expected
    return np.maximum(n - (e + spread * np.sqrt(e) + rare), 0) / np.maximum(total, 1)


def fit_toxicity(rows: list[tuple[str, int, int]], window: int = 8, spread: float = 2.0, rare: float = 1.0, rare_pair: float = 10.0, nothing: float = 0.2) -> ToxicModel:
    """rows: text, class, fold of 0 to 3; fold 0 fits the curve, the others are counted."""
    rows = sorted(rows)
    words: dict[str, int] = {}
    cut: list[tuple[int, np.ndarray]] = []
    seen: set[tuple[int, int]] = set()
    for text, c, fold in rows:
        if fold:
            t = TOKEN_PY.findall(text.lower())
            if t and (key := (c, near_key(t))) not in seen:
                seen.add(key)
                cut.append((c, np.array([words.setdefault(w, len(words) + 1) for w in t], dtype=np.int32)))
    if {c for c, _ in cut} != {0, 1}:
        return ToxicModel({}, np.zeros((2, 1)), np.zeros((2, 1)), np.zeros(0, np.int64), np.zeros((2, 0)), (0.0, 0.0, 0.0), window, True)
    size = len(words) + 1
    single, follow = np.zeros((2, size)), np.zeros((2, size))  # follow: pairs that begin with the word
    pairs: list[list[np.ndarray]] = [[], []]
    for c, ids in cut:
        single[c, np.unique(ids)] += 1
        pairs[c].append(np.unique(ids[:-1].astype(np.int64) * size + ids[1:]))
    del cut
    counted = []
    for c in (0, 1):
        counted.append(np.unique(np.concatenate(pairs[c]), return_counts=True))
        pairs[c].clear()
        follow[c] = np.bincount(counted[c][0] // size, counted[c][1], minlength=size)
    kinds = np.concatenate([counted[0][0], np.setdiff1d(counted[1][0], counted[0][0], assume_unique=True)])
    contexts = np.bincount(kinds % size, minlength=size).astype(float)
    del kinds
    # no other pairs than these can keep mass of their own
    keys = np.unique(np.concatenate([*(k[n > rare_pair] for k, n in counted), np.intersect1d(counted[0][0], counted[1][0], assume_unique=True)]))
    own = np.zeros((2, len(keys)))
    for c, (k, n) in enumerate(counted):
        at = np.minimum(np.searchsorted(k, keys), max(0, len(k) - 1))
        own[c] = np.where(k[at] == keys, n[at], 0) if len(k) else 0
    del counted
    often = own.sum(axis=0) > rare_pair
    keys, own = keys[often], own[:, often]
    h, w = keys // size, keys % size
    held = np.maximum(contexts - 0.75, 0) / max(1.0, contexts.sum())
    ends = held + (1 - held.sum()) / size
    texts = single.sum(axis=1)
    kept = np.zeros((2, size))
    for _ in range(ROUNDS):  # what a class keeps is not shared, and what isn't shared isn't expected of a class
        both = (single - kept).sum(axis=0)
        held = np.maximum(both - 0.75, 0) / both.sum()
        shared = held + (1 - held.sum()) * ends
        before, kept = kept, np.stack([texts[c] * _held(single[c], texts[c], shared, spread, rare) for c in (0, 1)])
        if np.abs(kept - before).max() < 0.01:
            break
    uni = kept / texts[:, None] + (1 - kept.sum(axis=1) / texts)[:, None] * shared
    bound = _held(own.sum(axis=0), follow.sum(axis=0)[h], shared[w], spread, rare_pair)
    freed = 1 - np.bincount(h, bound, minlength=size)
    free, pair = np.zeros((2, size)), np.zeros((2, len(keys)))
    for c in (0, 1):
        expected = bound + freed[h] * uni[c, w]
        held = _held(own[c], follow[c, h], expected, spread, rare_pair)
        left = 1 - np.bincount(h, held, minlength=size)
        free[c] = left * freed
        pair[c] = held + left[h] * expected
    told = (bound > 0) | (np.abs(pair - free[:, h] * uni[:, w]) > 1e-15).any(axis=0)  # the others follow from the unigram
    model = ToxicModel(words, np.log(uni), np.log(free), keys[told], np.log(pair[:, told]), (0.0, 1.0, 0.0), window)
    seen_rows = [(t, c) for t, c, fold in rows if not fold]
    if {c for _, c in seen_rows} != {0, 1}:
        seen_rows = [(t, c) for t, c, _ in rows]
    short = model.telling()
    x = np.concatenate([short.evidence([t for t, _ in seen_rows[k : k + 100]]) for k in range(0, len(seen_rows), 100)])
    model.curve = _logistic(x, np.array([c for _, c in seen_rows], dtype=float), math.log(nothing / (1 - nothing)))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, top: float) -> tuple[float, float, float]:
    """Balanced logistic regression with weights of 0 or more and an intercept of at most `top`, by projected Newton steps,
    with a small ridge in units of the features' deviations."""
    unit = np.maximum(x.std(axis=0), 1e-9)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    a = np.c_[np.ones(len(x)), x / unit]
    ridge = np.array([0.0, 0.1, 0.1])

    def loss(b: np.ndarray) -> float:
        z = a @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (ridge * b * b).sum() / 2)

    b = np.array([top, 0.0, 0.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * b
        free = ~np.r_[b[0] >= top and g[0] < 0, (b[1:] <= 0) & (g[1:] > 0)]  # the others stay at their bounds
        s = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9)
        step = np.zeros(3)
        step[free] = np.linalg.solve(s[np.ix_(free, free)], -g[free])
        share, now, new = 1.0, loss(b), b
        while share > 1e-6:
            new = np.maximum(b + share * step, [-np.inf, 0, 0])
            new[0] = min(new[0], top)
            if loss(new) <= now:
                break
            share /= 2
        moved, b = np.abs(new - b).max(), new
        if moved < 1e-9:
            break
    return float(b[0]), float(b[1] / unit[0]), float(b[2] / unit[1])


def score_toxicity(docs: DataFrame, model: ToxicModel, score: str = "score") -> DataFrame:
    """docs with column `score`, 0 to 1. The model has at most the expressions of 2 * max_docs texts, so it is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model.telling())
    schema = schema_without(docs, score).add(score, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_pydict(without(batch, score) | {score: pa.array(m.score(texts), pa.float64())})

    return map_arrow(docs, run, schema)
