"""Document quality by a regularised quadratic discriminant over transformed document statistics.

A text becomes NAMES numbers: logarithms of counts and lengths, square roots of shares, which bring both classes nearer
to normal. One pass over the whole texts computes them. Of each class Spark adds up count, sums and products over all
labelled rows that may be learnt from, so nothing is sampled and what reaches the driver is a few hundred numbers. Each
class's covariance, in units of the pooled deviations, is shrunk towards the pooled one (`pooled`) and the unit matrix
(`ridge`), factored by Cholesky once and broadcast. A text's evidence is the difference of the classes' log-densities:
half the difference of the squared Mahalanobis distances, found by solving with the factors, and of the log-determinants.
A logistic curve with the slope 1 / `temper` turns it into a score, at equal priors: how often labellers met a class
says nothing of the next text.

Defined cases. Null and empty texts, and texts of white space, have the statistics of no words and get the score that
these have. Without labels of both classes, as with empty tables, each text scores 0.5. A doc_id with several labels is
of class 1 only if all say so; labels that are neither 0 nor 1 are left out; rows that repeat count and are scored each;
ties can't arise. Texts are taken whole, whatever their length. Columns of any name may stand beside doc_id and text;
they are not read, and the results have none of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choralis.llm.common import CHUNK_CHARS, chunks, map_arrow

NAMES = (
    "words", "word_length", "line_words", "upper", "digits", "commas_stops", "loud_marks", "symbols", "bars", "other_marks",
    "no_letter_words", "repeated_words", "distinct_words", "repeated_lines", "capital_words",
)

_REST, _WHITE, _UPPER, _LOWER, _LEAD, _DIGIT, _STOP, _LOUD, _SYMBOL, _BAR, _MARK = _ALL = range(11)
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[33:127] = _MARK
_KINDS[65:91], _KINDS[97:123], _KINDS[0xC2:0xF5] = _UPPER, _LOWER, _LEAD
for _bytes, _kind in ((b" \t\n\v\f\r", _WHITE), (b"0123456789", _DIGIT), (b".,;:", _STOP), (b"!?", _LOUD), (b"#*$%&<>", _SYMBOL), (b"|", _BAR)):
    _KINDS[list(_bytes)] = _kind
#: An odd number, by whose powers bytes are weighted in the hashes of words and lines.
_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 2**64)


def _runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of true bytes; a run ends where a text does."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[starts] = True
    at = np.flatnonzero(edge)
    first = at[:-1][inside[at[:-1]]]
    return first, at[1:][inside[at[:-1]]]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


@lru_cache(maxsize=1)
def _usual_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, CHUNK_CHARS + 1), _powers(_INVERSE, CHUNK_CHARS + 1)


class Hashes:
    """Of runs of bytes; the same for equal runs, wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.back = _usual_powers() if n <= CHUNK_CHARS else (_powers(_BASE, n + 1), _powers(_INVERSE, n + 1))
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (self.sums[last] - self.sums[first]) * self.back[first]


def _seen_before(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """By owner, how many of its hashes equal an earlier one."""
    if not len(h):
        return np.zeros(n)
    order = np.lexsort((h, owner))
    a, b = owner[order], h[order]
    again = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return np.bincount(a[1:][again], minlength=n).astype(float)


def statistics(texts: list[str]) -> np.ndarray:
    """A row of NAMES for each text."""
    n = len(texts)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(b) for b in raw])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    if not len(data):
        return np.zeros((n, len(NAMES)))
    kinds = _KINDS[data]
    text_of = np.repeat(np.arange(n), sizes)
    count = np.bincount(text_of * len(_ALL) + kinds, minlength=n * len(_ALL)).reshape(n, -1).astype(float)
    # of the letters beyond ASCII, the Latin ones from U+00C0 to U+00DE but the times sign are upper case
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] <= 0x9E) & (data[lead + 1] != 0x97)]
    n_upper = count[:, _UPPER] + np.bincount(text_of[lead], minlength=n)
    n_letter = count[:, [_UPPER, _LOWER, _LEAD]].sum(axis=1)
    behind = np.bincount(text_of[(data & 0xC0) == 0x80], minlength=n)  # bytes of a character behind its first
    seen = sizes - behind - count[:, _WHITE]

    borders = starts[starts < len(data)]
    first, last = _runs(kinds != _WHITE, borders)
    owner = text_of[first]
    words = np.bincount(owner, minlength=n).astype(float)
    hashes = Hashes(data)
    h = hashes.of(first, last)
    same = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    letters = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum((kinds >= _UPPER) & (kinds <= _LEAD), out=letters[1:])
    no_letter = np.bincount(owner, letters[last] == letters[first], minlength=n)
    capital = np.zeros(len(data), dtype=bool)
    capital[lead] = True
    capital = np.bincount(owner, (kinds[first] == _UPPER) | capital[first], minlength=n)

    line_first, line_last = _runs(data != 10, borders)
    full = np.searchsorted(first, line_first) < np.searchsorted(first, line_last)  # lines with a word
    line_first, line_last = line_first[full], line_last[full]
    line_owner = text_of[line_first]
    lines = np.bincount(line_owner, minlength=n).astype(float)

    def share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.sqrt(x / np.maximum(of, 1))

    return np.c_[
        np.log1p(words), np.log1p(seen / np.maximum(words, 1)), np.log1p(words / np.maximum(lines, 1)), share(n_upper, n_letter),
        *(share(count[:, k], seen) for k in (_DIGIT, _STOP, _LOUD, _SYMBOL, _BAR, _MARK)),
        share(no_letter, words), share(np.bincount(owner[1:][same], minlength=n), words),
        np.log1p(words - _seen_before(owner, h, n)) / np.maximum(np.log1p(words), 1),
        share(_seen_before(line_owner, hashes.of(line_first, line_last), n), lines), share(capital, words),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of its whole text, for each row of docs (doc_id, text)."""
    schema = docs.select("doc_id").schema.add("x", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            x = statistics(texts)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "x": rows})

    return map_arrow(docs.select("doc_id", "text"), run, schema)


@dataclass
class Discriminant:
    middle: np.ndarray  # of both classes: 2 x statistics
    factor: np.ndarray  # inverse Cholesky factors: 2 x statistics x statistics
    log_size: np.ndarray  # half the log-determinants
    temper: float
    empty: bool = False

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0."""
        d = [0.5 * (((x - self.middle[c]) @ self.factor[c].T) ** 2).sum(axis=1) + self.log_size[c] for c in (0, 1)]
        return d[0] - d[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.empty:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.evidence(x) / self.temper, -30, 30)))


def from_sums(count: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float, ridge: float, temper: float) -> Discriminant:
    """count: 2, sums: 2 x d, products: 2 x d x d, of class 0 and 1."""
    d = sums.shape[1]
    if (count < 1).any():
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), temper, True)
    middle = sums / count[:, None]
    own = products / count[:, None, None] - middle[:, :, None] * middle[:, None, :]
    both = (own * count[:, None, None]).sum(axis=0) / count.sum()
    unit = np.sqrt(np.maximum(np.diag(both), 1e-6))
    size = unit[:, None] * unit[None, :]
    factors, logs = [], []
    for c in (0, 1):
        s = (1 - pooled) * own[c] / size + pooled * both / size
        s = (1 - ridge) * s + ridge * np.eye(d)
        low = np.linalg.cholesky((s + s.T) / 2)
        factors.append(np.linalg.solve(low, np.eye(d)) / unit[None, :])
        logs.append(np.log(np.diag(low)).sum())
    return Discriminant(middle, np.stack(factors), np.array(logs), temper)


def learn_discriminant(stats: DataFrame, labels: DataFrame, label: str = "quality", pooled: float = 0.2, ridge: float = 0.05, temper: float = 4.0) -> Discriminant:
    """stats: doc_id, x of rows that may be learnt from; labels: doc_id and the label's column."""
    one = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    told = stats.join(one, "doc_id").select("y", "x")
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            for c in (0, 1):
                z = x[y == c]
                total[c] += np.r_[len(z), z.sum(axis=0), (z.T @ z).reshape(-1)]
        size = total.shape[1]
        yield pa.RecordBatch.from_pydict({"y": np.repeat([0, 1], size), "i": np.tile(np.arange(size), 2), "v": total.reshape(-1)})

    added = map_arrow(told, run, "y long, i long, v double").groupBy("y", "i").agg(F.sum("v").alias("v"))
    total = np.zeros((2, 1 + d + d * d))
    for r in added.collect():  # 2 * (1 + d + d * d) rows
        total[r.y, r.i] = r.v
    return from_sums(total[:, 0], total[:, 1 : d + 1], total[:, d + 1 :].reshape(2, d, d), pooled, ridge, temper)


def score_quality(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score, 0 to 1, of each row of stats (doc_id, x)."""
    held = stats.sparkSession.sparkContext.broadcast(model)
    schema = stats.select("doc_id").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": held.value.score(x)})

    return map_arrow(stats.select("doc_id", "x"), run, schema)
