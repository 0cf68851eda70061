"""Byte-level BPE: encoding by batched merge rounds over flat numpy arrays, and decoding.

Many words are merged together. Their symbols lie in one flat array; in each round every word that still has a known
pair merges all places of its lowest-ranked pair, left to right. A pair's rank is found by binary search in the sorted
array of pair keys, and only for pairs that the last round changed. Words that are done leave the arrays.

Nulls count as empty text, an empty text has no ids; null ids decode to the empty text. The text of an added token in a
document becomes that token's id. Of two pairs in a word the lower rank merges first, and places of one pair from left
to right, so nothing is left to ties. Very long texts are coded whole, one at a time; rows that repeat are coded each;
empty tables stay empty. Columns of the input named like a result, in any case of letters, are replaced, others stay.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from choralis.llm.common import chunks, map_arrow, schema_without, without

#: Fixed value: how byte-level BPE of this kind cuts a text into words.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Words whose ids a task remembers; further words are encoded anew in each chunk.
REMEMBERED = 300_000
#: Marks an added token among the words; no word can begin with it, as a lone surrogate is not text.
ADDED = "\udc00"
OTHER_SPACE = re.compile(r" (?:\s|$)")
NO_PAIR = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it can be printed, else the next from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BytePairs:
    """A vocabulary with its merges, ready to encode and decode."""

    def __init__(self, spec: str):
        found = json.loads(spec)
        vocab = found["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = np.array([vocab[x] for x in letters], dtype=np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in found["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks, self.made = keys[order], order.astype(np.int64), made
        value = {x: bytes([b]) for b, x in enumerate(letters)}
        self.token_bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = b"".join(value[x] for x in token)
        self.added = {a["content"]: a["id"] for a in found.get("added_tokens", [])}
        for content, i in self.added.items():
            self.token_bytes.extend([b""] * (i + 1 - len(self.token_bytes)))
            self.token_bytes[i] = content.encode()
        self.added_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.split = regex.compile(SPLIT)
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_PAIR)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbol = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(symbol), NO_PAIR)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self._rank(symbol[inner], symbol[inner + 1])
        done_symbol, done_word = [], []
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbol)])
            spread = np.repeat(best, sizes)
            live = spread < NO_PAIR
            if not live.all():
                done_symbol.append(symbol[~live])
                done_word.append(word[~live])
                symbol, word, rank, spread = symbol[live], word[live], rank[live], spread[live]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == spread)
            if len(hit) > 1 and (np.diff(hit) == 1).any():  # runs of one symbol: every other place, from the left
                first = np.r_[True, np.diff(hit) != 1]
                run_start = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            stay = np.ones(len(symbol), dtype=bool)
            stay[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged symbols come to stand
            symbol, word, rank = symbol[stay], word[stay], rank[stay]
            rank[at] = NO_PAIR
            touched = np.r_[at, at[at > 0] - 1]
            touched = touched[touched + 1 < len(symbol)]
            same = word[touched] == word[touched + 1]
            rank[touched[~same]] = NO_PAIR
            touched = touched[same]
            rank[touched] = self._rank(symbol[touched], symbol[touched + 1])
        symbols, of = np.concatenate(done_symbol), np.concatenate(done_word)
        packed = symbols[np.argsort(of, kind="stable")].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(of, minlength=len(words))) * 4
        cut = [0, *ends.tolist()]
        return [packed[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def _has_added(self, text: str) -> bool:
        for x in self.added:
            if x in text:
                return True
        return False

    def _words(self, text: str) -> list[str]:
        if self._has_added(text):
            words: list[str] = []
            for k, piece in enumerate(self.added_split.split(text)):
                words += [ADDED + piece] if k % 2 else self.split.findall(piece)
            return words
        return self.split.findall(text)

    def _encode_new(self, pieces: list[str]) -> list[bytes]:
        parts = [self._words(x) for x in pieces]
        here: dict[str, bytes] = {}
        fresh = []
        for w in set().union(*parts):
            if w in self.known:
                continue
            if w[0] == ADDED and w[1:] in self.added:
                here[w] = self.added[w[1:]].to_bytes(4, "little")
            else:
                fresh.append(w)
        here.update(zip(fresh, self.merge([w.encode() for w in fresh]), strict=True))
        if len(self.known) + len(here) <= REMEMBERED:
            self.known.update(here)
        get = self.known.get
        return [b"".join([get(w) or here[w] for w in words]) for words in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """A space before anything but white space always begins a word, so texts are cut there first and the ids of
        what lies between are remembered. A text with other spaces or with added tokens is one piece."""
        cut: list[list[str]] = []
        first: list[str] = []
        new: set[str] = set()
        for text in texts:
            if OTHER_SPACE.search(text) or self._has_added(text):
                rest = []
                first.append(text)
            else:
                rest = text.split(" ")
                first.append(rest.pop(0))
            new.update(rest)
            cut.append(rest)
        fresh = [x for x in new if x not in self.pieces]
        here = dict(zip(fresh, self._encode_new([" " + x for x in fresh]), strict=True))
        look = self.pieces
        if len(look) + len(here) <= REMEMBERED:
            look.update(here)
        elif here:
            look = look | here
        return [a + b"".join(map(look.__getitem__, rest)) for a, rest in zip(self._encode_new(first), cut, strict=True)]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[int, BytePairs] = {}


def _pairs(spec) -> BytePairs:
    """One vocabulary for each broadcast and worker."""
    if spec.id not in _loaded if hasattr(spec, "id") else True:
        _loaded.clear()
        _loaded[getattr(spec, "id", 0)] = BytePairs(spec.value)
    return _loaded[getattr(spec, "id", 0)]


def bpe_encode(docs: DataFrame, spec: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with column `ids`: the tokens of the whole text, little-endian unsigned 32-bit integers in a binary value; if
    asked for, also with column `decoded`: what these ids decode to, by the same worker.

    spec: the vocabulary file's content (a few MB at any size of the corpus, so it is broadcast).
    """
    held = docs.sparkSession.sparkContext.broadcast(spec)
    names = [ids, *([decoded] if decoded else [])]
    new = [T.StructField(ids, T.BinaryType()), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    schema = T.StructType([*schema_without(docs, *names), *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(held)
        for batch, texts in chunks(batches, text):
            kept = without(batch, *names)
            coded = pairs.encode(texts)
            back = {decoded: pa.array(map(pairs.decode, coded), pa.string())} if decoded else {}
            yield pa.RecordBatch.from_pydict(kept | {ids: pa.array(coded, pa.binary())} | back)
        pairs.known.clear()  # the worker's memory is for other operators' tasks too
        pairs.pieces.clear()

    return map_arrow(docs, run, schema)


def bpe_decode(docs: DataFrame, spec: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with column `decoded`: the text that the ids stand for, special tokens kept; null ids give an empty text."""
    held = docs.sparkSession.sparkContext.broadcast(spec)
    schema = T.StructType([*schema_without(docs, decoded), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _pairs(held)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                kept = without(batch, decoded)
                values = batch.column(batch.schema.get_field_index(ids)).to_pylist()
                yield pa.RecordBatch.from_pydict(kept | {decoded: pa.array([pairs.decode(v or b"") for v in values], pa.string())})

    return map_arrow(docs, run, schema)


def token_digests(docs: DataFrame, spec: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document's encoding and its decoding."""
    coded = bpe_encode(docs.select("doc_id", "text"), spec, decoded="decoded").drop("text")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
