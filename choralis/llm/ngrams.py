"""Language-model scoring by an interpolated modified Kneser-Ney trigram model.

Tokens. Texts are cut into words in place, on their bytes, all texts of a chunk at once: a word's 64-bit hash is the sum
of random numbers drawn for each byte at each place (tabulation hashing).

Counting. A first pass counts words; a word's id is the rank of its hash among all hashes. Further passes count triples
(u, v, w) of ids, each for a part of the buckets, so that only that part of the triples is in the shuffle at a time; u
and v may be the start and w the end of a text. Workers pass on sorted keys with counts, packed by bucket; each bucket is
merged by itself. Buckets are ranges of the middle word's id, so both what a context (u, v) needs and in how many
contexts each pair (v, w) was seen are complete in one bucket. Middle words with more than a bucket's share of all
tokens are dealt out by hash of (u, v) instead, and their pairs are added up by a second, smaller shuffle. In how many
contexts each word was seen is merged in a last one.

Storage. Each bucket is a file of sorted hashes in the shared folder: 32 bits of each hash behind a table of where
each value of the bits before begins, so two n-grams are taken for one with odds of a few in 2^32 for each look-up of an
unseen one. Scoring maps the files into memory, so a worker holds only the pages it touches. A store that can't be mapped
is copied file by file to an unlinked local file first.

Model. p(w | u v) = max(0, c(uvw) - D) / c(uv) + g(uv) p(w | v), with Chen and Goodman's three discounts and g the mass
they free; p(w | v) and p(w) are the same over the numbers of contexts (over counts, where v is a text's start, which has
no other context), and p(w) backs off to 1 / (V + 1), V the number of distinct tokens, which is also what unknown words
share. An unknown context leaves the shorter one. Counts and sums have 64 bits; V must stay below 2^32 - 1.

Defined cases. Null and empty texts have one token, their end. Without training texts every token has probability 1.
Texts of any length are scored whole. Rows that repeat are counted, and scored, each; nothing depends on their order, so
ties can't matter. Columns besides doc_id and text are not read. An empty table has no rows.
"""

from __future__ import annotations

import gc
import json
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choralis.llm.common import fresh_path, lean_worker, map_arrow, written

U = np.uint64
#: Bytes of text that are cut and scored at once, besides a longer text.
CHUNK = 2_000_000
#: Triples and distinct words that a task holds before it passes them on.
KEPT_TRIPLES = 3_000_000
KEPT_WORDS = 1_000_000
SATURATED = 255


# -- tokens

_draw = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 64 * 256 + 2, dtype=np.uint64)
DRAWN, END, ODD = _draw[:-2], _draw[-2], _draw[-1] | U(1)  # for byte b at place i: DRAWN[(i % 64) * 256 + b]
BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.int64)
SPACE = (BYTES == 0x20) | ((BYTES >= 0x09) & (BYTES <= 0x0D))


def hashed_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of the texts (null: empty), each text's words and its end; and where each text begins."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inner = ~SPACE[data]
    begins = inner.copy()
    begins[1:] &= ~inner[:-1]
    at = ends[:-1][ends[:-1] < len(data)]
    begins[at] = inner[at]
    held = np.flatnonzero(inner)
    first = np.flatnonzero(begins[held])
    starts = held[first]
    place = np.arange(len(held)) - np.repeat(first, np.diff(np.r_[first, len(held)]))
    drawn = DRAWN[((place & 63) << 8) | LOWER[data[held]]]
    if len(place) and (most := int(place.max()) >> 6):
        drawn *= np.cumprod(np.r_[U(1), np.full(most, ODD)])[place >> 6]
    hashes = np.add.reduceat(drawn, first) if len(first) else np.zeros(0, np.uint64)
    text = np.searchsorted(ends[1:], starts, side="right")
    sizes = np.bincount(text, minlength=len(texts)) + 1
    last = np.cumsum(sizes)
    out = np.full(int(last[-1]) if len(last) else 0, END, dtype=np.uint64)
    out[np.arange(len(first)) + text] = hashes
    return out, last - sizes


def text_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their tokens, each of about CHUNK bytes or of one longer text."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("text"))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(col):
            end = max(at + 1, int(np.searchsorted(sizes, (int(sizes[at - 1]) if at else 0) + CHUNK, side="right")))
            yield batch.slice(at, end - at), *hashed_tokens(col.slice(at, end - at))
            at = end


# -- files in the shared folder


def _local(uri: str) -> str | None:
    return uri[len("file:") :].replace("//", "/", 1) if uri.startswith("file:") else uri if uri.startswith("/") else None


def save(uri: str, arrays: list[np.ndarray]) -> None:
    """The arrays' types and lengths in a line of JSON, then one after the other, each padded to 8 bytes. Written aside and
    moved, so a retried task does no harm."""
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    data = b"".join([head + b" " * (-(len(head) + 1) % 8) + b"\n", *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)])
    path = _local(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        aside = f"{path}.{uuid.uuid4().hex}"
        with open(aside, "wb") as f:
            f.write(data)
        os.replace(aside, path)
    else:
        store, path = pafs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        aside = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(aside) as f:
            f.write(data)
        store.move(aside, path)


def load(uri: str) -> list[np.ndarray] | None:
    """The arrays of a file, mapped into memory; None if there is no such file."""
    path = _local(uri)
    try:
        if path:
            f = open(path, "rb")
        else:
            store, path = pafs.FileSystem.from_uri(uri)
            f = tempfile.TemporaryFile()
            with store.open_input_stream(path) as source:
                while block := source.read(1 << 22):
                    f.write(block)
            f.flush()
    except FileNotFoundError:
        return None
    held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    f.close()
    at = held.find(b"\n") + 1
    out = []
    for kind, n in json.loads(held[:at]):
        a = np.frombuffer(held, dtype=kind, count=n, offset=at) if n else np.zeros(0, kind)
        at += a.nbytes + (-a.nbytes % 8)
        out.append(a)
    return out


def small(values: np.ndarray) -> list[np.ndarray]:
    """Whole numbers in a byte each; where and what those are that don't fit."""
    over = np.flatnonzero(values >= SATURATED)
    return [np.minimum(values, SATURATED).astype(np.uint8), over.astype(np.uint64), values[over].astype(np.uint64)]


def number(held: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    out = held[0][at].astype(np.int64)
    full = np.flatnonzero(out == SATURATED)
    if len(full):
        out[full] = held[2][np.searchsorted(held[1], at[full].astype(np.uint64))].astype(np.int64)
    return out


def coded(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of four whole numbers as codes in a list of the distinct ones."""
    kinds, code = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
    width = np.uint8 if len(kinds) <= 1 << 8 else np.uint16 if len(kinds) <= 1 << 16 else np.uint32
    return [code.ravel().astype(width), kinds.astype(np.int64).ravel()]


def decoded(held: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    return held[1].reshape(-1, 4)[held[0][at]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair_hash(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return _mix(_mix(a.astype(np.uint64) + U(salt)) + b.astype(np.uint64) * U(0x9E3779B97F4A7C15))


def sorted_table(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of the keys, and the arrays by which they are found: where each value of the leading bits begins, and the
    32 bits behind these."""
    bits = max(0, (len(keys) >> 3).bit_length())
    order = np.argsort(keys)
    keys = keys[order]
    top = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    begin = np.searchsorted(top, np.arange((1 << bits) + 1)).astype(np.uint32)
    return order, [begin, (keys << U(bits) >> U(32)).astype(np.uint32)]


def find(held: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Where the keys are in a sorted table; -1: nowhere."""
    begin, low = held[0], held[1]
    bits = (len(begin) - 1).bit_length() - 1
    top = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    want = (keys << U(bits) >> U(32)).astype(np.uint32)
    lo, hi = begin[top].astype(np.int64), begin[top + 1].astype(np.int64)
    end = hi.copy()
    on = np.flatnonzero(lo < hi)
    while len(on):  # all binary searches at once
        mid = (lo[on] + hi[on]) >> 1
        less = low[mid] < want[on]
        lo[on[less]] = mid[less] + 1
        hi[on[~less]] = mid[~less]
        on = on[lo[on] < hi[on]]
    out = np.full(len(keys), -1, dtype=np.int64)
    inside = np.flatnonzero(lo < end)
    hit = inside[low[lo[inside]] == want[inside]]
    out[hit] = lo[hit]
    return out


# -- packing


def planes(a: np.ndarray) -> bytes:
    """By byte planes: most planes are nearly zeros, which the shuffle's compression takes away."""
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=U(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, "<u8"), dtype=np.uint64)


def _runs(*cols: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    if not len(cols[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(cols[0]), dtype=bool)
    new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, np.int64)


def _sum_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = _runs(keys)
    return keys[first], _sums(counts[order], first)


def _rows(kind: int, bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray, words: np.ndarray | None = None) -> dict[str, list]:
    """One row for each bucket; the keys are in the order of bucket and key."""
    first = _runs(bucket)
    cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=False))
    return {
        "kind": [kind] * len(cuts),
        "bucket": [int(bucket[a]) for a, _ in cuts],
        "keys": [pack(keys[a:b]) for a, b in cuts],
        "words": [b"" if words is None else planes(words[a:b]) for a, b in cuts],
        "counts": [planes(counts[a:b].astype(np.uint64)) for a, b in cuts],
    }


PACKED = "kind int, bucket long, keys binary, words binary, counts binary"
ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])


def _merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    counts = np.concatenate([unplanes(c, "<u8").astype(np.int64) for c in rows["counts"]])
    return _sum_up(np.concatenate([unpack(k) for k in rows["keys"]]), counts)


def _spectrum(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


# -- the model


@dataclass
class Trigrams:
    """Where a counted model lies, and its few totals."""

    at: str
    buckets: int
    ends: np.ndarray  # of the ids of each word bucket
    tokens: int
    hot: np.ndarray  # sorted ids of the middle words that are dealt out, the start among them
    hot_sums: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))  # of these as contexts: sum, kinds of 1, 2, more
    discounts: tuple[tuple[float, float, float], ...] = ((0.5, 1.0, 1.5),) * 3  # of words, pairs, triples
    pairs: int = 0
    word_kinds: tuple[int, int, int] = (0, 0, 0)

    @property
    def words(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    @property
    def start(self) -> int:
        return self.words  # the id of a text's start

    def is_hot(self, v: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
        return self.hot[at] == v

    def bucket_of(self, v: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Of the pairs that a middle word v is in, by the other word."""
        own = self.range_of(v)
        spread = np.flatnonzero(self.is_hot(v))
        own[spread] = (pair_hash(v[spread], other[spread], 3) % U(self.buckets)).astype(np.int64)
        return own

    def range_of(self, ids: np.ndarray) -> np.ndarray:
        return (ids.astype(np.uint64) * U(self.buckets) // U(self.words + 1)).astype(np.int64)

    def bounds(self, bucket: int) -> tuple[int, int]:
        """The least id that range_of puts in a bucket, and the next bucket's."""
        n, b = self.words + 1, self.buckets
        return -(-bucket * n // b), -(-(bucket + 1) * n // b)


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Of counts of counts n[1] to n[4]."""
    if min(n[1], n[2]) <= 0:
        return 0.5, 1.0, 1.5
    y = n[1] / (n[1] + 2 * n[2])
    raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * 0.5 for k in (1, 2, 3)]
    return tuple(float(min(max(x, 0.05), k - 0.05)) for k, x in zip((1, 2, 3), raw, strict=True))


class Files:
    """A model's files as far as they were asked for."""

    def __init__(self, m: Trigrams):
        self.m = m
        self.open: dict[tuple[str, int], list[np.ndarray] | None] = {}

    def file(self, name: str, b: int) -> list[np.ndarray] | None:
        if (name, b) not in self.open:
            self.open[name, b] = load(f"{self.m.at}/{name}-{b}")
        return self.open[name, b]

    def each(self, name: str, bucket: np.ndarray) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
        """The buckets' files that there are, each with the places that it is for."""
        order = np.argsort(bucket, kind="stable")
        first = _runs(bucket[order])
        for a, e in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=False):
            b = int(bucket[order[a]])
            if held := self.file(name, b):
                yield b, held, order[a:e]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct hashes."""
        ids, counts = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        for b, held, at in self.each("word", word_bucket(hashes, self.m.buckets)):
            p = np.minimum(np.searchsorted(held[0], hashes[at]), len(held[0]) - 1)
            hit = held[0][p] == hashes[at]
            at, p = at[hit], p[hit]
            ids[at] = p + (int(self.m.ends[b - 1]) if b else 0)
            counts[at] = number(held[1:], p)
        return ids, counts

    def values(self, name: str, bucket: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
        """What the tables hold for the keys: one number, or rows of four; zeros where there is nothing."""
        out = np.zeros((len(keys), 4) if width == 4 else len(keys), dtype=np.int64)
        for _, held, at in self.each(name, bucket):
            p = find(held, keys[at])
            hit = p >= 0
            out[at[hit]] = decoded(held[2:], p[hit]) if width == 4 else number(held[2:], p[hit])
        return out

    def dense(self, name: str, ids: np.ndarray, width: int) -> np.ndarray:
        """The same from files by ranges of ids."""
        out = np.zeros((len(ids), 4) if width == 4 else len(ids), dtype=np.int64)
        for b, held, at in self.each(name, self.m.range_of(ids)):
            p = ids[at] - self.m.bounds(b)[0]
            out[at] = decoded(held, p) if width == 4 else number(held, p)
        return out


def word_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> U(64 - (buckets.bit_length() - 1))).astype(np.int64)


_files: dict[str, Files] = {}


def files_of(m: Trigrams) -> Files:
    if m.at not in _files:
        _files.clear()
        _files[m.at] = Files(m)
    _files[m.at].m = m  # the worker may know an earlier state, from before the triples were counted
    return _files[m.at]


def _triples(ids: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """u and v of every token."""
    v = np.r_[start, ids[:-1]]
    v[first] = start
    u = np.r_[start, v[:-1]]
    u[first] = start
    return u, v


def _no_tables(docs: DataFrame) -> None:
    """Lets Spark remove the shuffles of tables that are no longer used."""
    gc.collect()
    docs.sparkSession._jvm.System.gc()


def count_trigrams(docs: DataFrame, passes: int = 2, buckets: int | None = None) -> Trigrams:
    """docs: text; a row without text is an empty text. passes: over how many parts of the triples."""
    spark = docs.sparkSession
    docs = docs.select("text")
    parts = max(1, docs.rdd.getNumPartitions())
    buckets = buckets or 1 << max(4, (2 * parts - 1).bit_length())
    at = fresh_path(spark, "ngrams")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, counts, size = [], [], 0

        def out() -> pa.RecordBatch:
            keys, n = _sum_up(np.concatenate(kept), np.concatenate(counts))
            kept.clear()
            counts.clear()
            return pa.RecordBatch.from_pydict(_rows(0, word_bucket(keys, buckets), keys, n), schema=ARROW)

        for _, tokens, _ in text_chunks(batches):
            keys, n = np.unique(tokens, return_counts=True)
            kept.append(keys)
            counts.append(n)
            size += len(keys)
            if size > KEPT_WORDS:
                yield out()
                size = 0
        if kept:
            yield out()

    def merge_words(rows: pd.DataFrame) -> pd.DataFrame:
        with lean_worker():
            keys, counts = _merged(rows)
            b = int(rows["bucket"].iloc[0])
            save(f"{at}/word-{b}", [keys, *small(counts)])
            return pd.DataFrame({"bucket": [b], "n": [len(keys)], "total": [int(counts.sum())]})

    spread = map_arrow(docs, count_words, PACKED).repartition(buckets, "bucket")
    met = written(spread.groupBy("bucket").applyInPandas(merge_words, "bucket long, n long, total long"), "ngram-words").collect()
    del spread
    n = np.zeros(buckets, dtype=np.int64)
    for r in met:
        n[r.bucket] = r.n
    ends, tokens = np.cumsum(n), sum(r.total for r in met)
    m = Trigrams(at, buckets, ends, tokens, np.zeros(0, np.int64))
    if m.words >= 2**32 - 1:
        raise OverflowError("more distinct words than ids of 32 bits")

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                if held := load(f"{at}/word-{b}"):
                    big = np.flatnonzero(number(held[1:], np.arange(len(held[0]))) * buckets > tokens)
                    yield pa.RecordBatch.from_pydict({"id": pa.array(big + (int(ends[b - 1]) if b else 0), pa.int64())})

    hot = [r.id for r in map_arrow(spark.range(buckets), often, "id long").collect()]  # fewer than buckets
    m.hot = np.array(sorted([*hot, m.start]), dtype=np.int64)

    def count(part: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files = files_of(m)
            held: list[tuple[np.ndarray, ...]] = []
            size = 0

            def out() -> pa.RecordBatch:
                bucket, vu, w = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                order = np.lexsort((w, vu, bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket))
                bucket, vu, w = bucket[order], vu[order], w[order]
                first = _runs(vu, w)  # a context is in one bucket
                sizes = np.diff(np.r_[first, len(vu)])
                return pa.RecordBatch.from_pydict(_rows(0, bucket[first], vu[first], sizes, w[first]), schema=ARROW)

            for _, tokens, first in text_chunks(batches):
                kinds, back = np.unique(tokens, return_inverse=True)
                w = files.ids(kinds)[0][back]
                u, v = _triples(w, first, m.start)
                bucket = m.bucket_of(v, u)
                mine = np.flatnonzero(bucket % passes == part)
                held.append((bucket[mine], v[mine].astype(np.uint64) << U(32) | u[mine].astype(np.uint64), w[mine].astype(np.uint32)))
                size += len(mine)
                if size > KEPT_TRIPLES:
                    yield out()
                    size = 0
            if held:
                yield out()
            _files.clear()

        return run

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        with lean_worker():
            return _merge_triples(m, rows)

    def merge_pairs(rows: pd.DataFrame) -> pd.DataFrame:
        with lean_worker():
            return _merge_hot_pairs(m, rows)

    wide = PACKED + ", info array<long>"
    tables = []
    for part in range(passes):
        spread = map_arrow(docs, count(part), PACKED).repartition(buckets, "bucket")
        tables.append(written(spread.groupBy("bucket").applyInPandas(merge, wide), "ngram-triples"))
        del spread
        _no_tables(docs)
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.unionByName(t)
    pairs = merged.where("kind = 1").select("kind", "bucket", "keys", "words", "counts").repartition(buckets, "bucket")
    pairs = written(pairs.groupBy("bucket").applyInPandas(merge_pairs, wide), "ngram-pairs")

    def sums(rows: DataFrame, kind: int, width: int) -> list:
        """Of the info rows, which are short, summed by their first number."""
        cols = [F.sum(F.get("info", F.lit(i))).alias(f"x{i}") for i in range(1, width)]
        return rows.where(F.col("kind") == kind).groupBy(F.get("info", F.lit(0)).alias("x0")).agg(*cols).collect()

    triple_counts, pair_counts = np.zeros(5, dtype=np.int64), np.zeros(5, dtype=np.int64)
    for r in sums(merged, 4, 9):  # one row in all
        triple_counts[1:] += r[1:5]
        pair_counts[1:] += r[5:9]
    for r in sums(pairs, 4, 9):
        pair_counts[1:] += r[5:9]
    m.hot_sums = np.zeros((len(m.hot), 4), dtype=np.int64)
    for r in sums(pairs, 3, 5):  # fewer than buckets
        m.hot_sums[np.searchsorted(m.hot, r[0])] = r[1:5]

    def merge_seen(rows: pd.DataFrame) -> pd.DataFrame:
        with lean_worker():
            keys, counts = _merged(rows)
            b = int(rows["bucket"].iloc[0])
            low, high = m.bounds(b)
            dense = np.zeros(high - low, dtype=np.int64)
            dense[(keys - U(low)).astype(np.int64)] = counts
            save(f"{at}/seen-{b}", small(dense))
            return pd.DataFrame({"info": [[*_spectrum(counts), len(counts), int(counts.sum())]]})

    seen = merged.unionByName(pairs).where("kind = 2").select("kind", "bucket", "keys", "words", "counts").repartition(buckets, "bucket")
    rows = written(seen.groupBy("bucket").applyInPandas(merge_seen, "info array<long>"), "ngram-seen")
    total = np.array(rows.agg(*[F.coalesce(F.sum(F.get("info", F.lit(i))), F.lit(0)) for i in range(6)]).first(), dtype=np.int64)
    word_counts = np.r_[0, total[:4]]
    m.word_kinds = (int(total[0]), int(total[1]), int(total[4] - total[0] - total[1]))
    m.pairs = int(total[5])
    m.discounts = (_discounts(word_counts), _discounts(pair_counts), _discounts(triple_counts))
    return m


def _kinds(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each run: the sum, and how many are 1, 2 and more."""
    return np.stack([_sums(counts, first), *(_sums(x.astype(np.int64), first) for x in (counts == 1, counts == 2, counts > 2))], axis=1)


def _seen_rows(m: Trigrams, w: np.ndarray) -> dict[str, list]:
    """In how many of the pairs at hand each word is the second one."""
    seen, times = np.unique(w, return_counts=True)
    return _rows(2, m.range_of(seen), seen.astype(np.uint64), times)


def _framed(parts: list[dict[str, list]], info: list[tuple[int, list[int]]]) -> pd.DataFrame:
    out = {c: [x for p in parts for x in p[c]] for c in ("kind", "bucket", "keys", "words", "counts")}
    n = len(out["kind"])
    out["info"] = [None] * n + [x for _, x in info]
    out["kind"] += [k for k, _ in info]
    out["bucket"] += [0] * len(info)
    for c in ("keys", "words", "counts"):
        out[c] += [b""] * len(info)
    return pd.DataFrame(out)


def _merge_triples(m: Trigrams, rows: pd.DataFrame) -> pd.DataFrame:
    """Writes a bucket's triples, contexts and pairs. Out go, by kind: 1 the pairs of hot words, 2 in how many pairs words
    are second, 4 the counts of counts of triples and pairs."""
    b = int(rows["bucket"].iloc[0])
    vu = np.concatenate([unpack(k) for k in rows["keys"]])
    w = np.concatenate([unplanes(x, "<u4") for x in rows["words"]])
    n = np.concatenate([unplanes(c, "<u8").astype(np.int64) for c in rows["counts"]])
    order = np.lexsort((w, vu))
    vu, w, n = vu[order], w[order], n[order]
    first = _runs(vu, w)
    vu, w, n = vu[first], w[first], _sums(n, first)
    v, u = vu >> U(32), vu & U(0xFFFFFFFF)
    order, found = sorted_table(_mix(pair_hash(v, u, 1) + w.astype(np.uint64) * U(0xD6E8FEB86659FD93)))
    save(f"{m.at}/triple-{b}", [*found, *small(n[order])])
    first = _runs(vu)
    order, found = sorted_table(pair_hash(v[first], u[first], 1))
    save(f"{m.at}/context-{b}", [*found, *coded(_kinds(n, first)[order])])
    spectrum = _spectrum(n)
    vw = v << U(32) | w.astype(np.uint64)
    order = np.argsort(vw, kind="stable")
    vw, n = vw[order], n[order]
    first = _runs(vw)
    actual = _sums(n, first)
    vw, times = vw[first], np.diff(np.r_[first, len(vw)])
    v, w = (vw >> U(32)).astype(np.int64), vw & U(0xFFFFFFFF)
    times = np.where(v == m.start, actual, times)  # a text's start has no context of its own
    hot = m.is_hot(v)
    to = m.bucket_of(v[hot], w[hot].astype(np.int64))
    order = np.argsort(to, kind="stable")
    parts = [_rows(1, to[order], vw[hot][order], times[hot][order])]
    v, w, times = v[~hot], w[~hot], times[~hot]
    order, found = sorted_table(pair_hash(v, w, 2))
    save(f"{m.at}/pair-{b}", [*found, *small(times[order])])
    first = _runs(v)
    low, high = m.bounds(b)
    dense = np.zeros((high - low, 4), dtype=np.int64)
    dense[v[first] - low] = _kinds(times, first)
    save(f"{m.at}/word-context-{b}", coded(dense))
    parts.append(_seen_rows(m, w.astype(np.int64)))
    return _framed(parts, [(4, [0, *spectrum, *_spectrum(times)])])


def _merge_hot_pairs(m: Trigrams, rows: pd.DataFrame) -> pd.DataFrame:
    """Writes the pairs of hot words in a bucket. Out go, by kind: 2 and 4 as above, 3 the sums of the hot words."""
    b = int(rows["bucket"].iloc[0])
    vw, times = _merged(rows)
    v, w = (vw >> U(32)).astype(np.int64), vw & U(0xFFFFFFFF)
    order, found = sorted_table(pair_hash(v, w, 2))
    save(f"{m.at}/hot-pair-{b}", [*found, *small(times[order])])
    first = _runs(v)
    own = [(3, [int(v[a]), *map(int, k)]) for a, k in zip(first, _kinds(times, first), strict=True)]
    return _framed([_seen_rows(m, w.astype(np.int64))], [*own, (4, [0, 0, 0, 0, 0, *_spectrum(times)])])


def _left(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(0, counts - np.array([0.0, *d])[np.minimum(counts, 3)])


def _backed(counts: np.ndarray, kinds: np.ndarray, d: tuple[float, float, float], shorter: np.ndarray) -> np.ndarray:
    """Interpolated probabilities; where the context is unknown, the shorter one's."""
    total = np.maximum(1, kinds[:, 0])
    p = (_left(counts, d) + kinds[:, 1:] @ np.array(d) * shorter) / total
    return np.where(kinds[:, 0] > 0, p, shorter)


def log10_probability(m: Trigrams, tokens: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of each text."""
    files = files_of(m)
    kinds, back = np.unique(tokens, return_inverse=True)
    ids, count = files.ids(kinds)
    known = ids >= 0
    base = np.log10((count + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
    seen = np.zeros(len(kinds), dtype=np.int64)
    seen[known] = files.dense("seen", ids[known], 1)
    words = np.tile(np.array([[m.pairs, *m.word_kinds]]), (len(kinds), 1))
    single = _backed(seen, words, m.discounts[0], np.full(len(kinds), 1 / (m.words + 1)))
    w = ids[back]
    u, v = _triples(w, first, m.start)
    after = np.zeros((len(kinds) + 1, 4), dtype=np.int64)  # of each kind as a context; the last: the start
    plain = np.flatnonzero(known)
    plain = plain[~m.is_hot(ids[plain])]
    after[plain] = files.dense("word-context", ids[plain], 4)
    hot = np.flatnonzero(known)
    hot = hot[m.is_hot(ids[hot])]
    after[hot] = m.hot_sums[np.searchsorted(m.hot, ids[hot])]
    after[-1] = m.hot_sums[np.searchsorted(m.hot, m.start)]
    which = np.r_[len(kinds), back[:-1]]
    which[first] = len(kinds)
    pair = np.zeros(len(w), dtype=np.int64)
    both = np.flatnonzero((v >= 0) & (w >= 0))
    spread = m.is_hot(v[both])
    for name, part in (("pair", both[~spread]), ("hot-pair", both[spread])):
        pair[part] = files.values(name, m.bucket_of(v[part], w[part]), pair_hash(v[part], w[part], 2), 1)
    p = _backed(pair, after[which], m.discounts[1], single[back])
    context, triple = np.zeros((len(w), 4), dtype=np.int64), np.zeros(len(w), dtype=np.int64)
    real = np.flatnonzero((u >= 0) & (v >= 0))
    bucket, keys = m.bucket_of(v[real], u[real]), pair_hash(v[real], u[real], 1)
    context[real] = files.values("context", bucket, keys, 4)
    some = np.flatnonzero((w[real] >= 0) & (context[real, 0] > 0))
    full = _mix(keys[some] + w[real[some]].astype(np.uint64) * U(0xD6E8FEB86659FD93))
    triple[real[some]] = files.values("triple", bucket[some], full, 1)
    p = _backed(triple, context, m.discounts[2], p)
    sums = [np.add.reduceat(x, first) for x in (np.log10(p), base[back], (count[back] > 0).astype(np.int64))]
    return {"n_tokens": np.diff(np.r_[first, len(w)]), "n_known": sums[2], "base_score": sums[1], "score": sums[0]}


def learn_ngrams(docs: DataFrame, passes: int = 2, buckets: int | None = None) -> Trigrams:
    return count_trigrams(docs, passes, buckets)


def score_ngrams(docs: DataFrame, m: Trigrams) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity of docs (doc_id, text)."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tokens, first in text_chunks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {k: pa.array(v) for k, v in log10_probability(m, tokens, first).items()})
        _files.clear()

    out = map_arrow(docs.select("doc_id", "text"), run, schema).withColumn("train_tokens", F.lit(m.tokens).cast("long"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
