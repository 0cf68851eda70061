"""Quality rules by distribution divergence.

For each language the corpus gives two references: the shares of character classes, and the shares of its common words
(those that make up at least `common` of its words), with one share for all other words. A document is compared with
the references of every language by Jensen-Shannon distance and the nearest counts, so its own language tag isn't
needed. It fails if its character classes or its words lie too far off. Short texts scatter more: each limit is widened
by its slack / sqrt(number of words or characters), and below `min_words` words no divergence is judged at all.

References come from whole texts of all documents whose language is not null, counted in Spark; what reaches the driver
is at most 1 / common words for each of at most `max_langs` languages; more languages end with an error. A language that
only texts without words have gives no reference.

Null and empty texts have no words and fail the base rules. Without references, as from an empty table, the base rules
decide. Rows that repeat count and are judged each; ties between references don't matter, for only the distance is used.
Very long texts are counted and judged whole, one at a time. The result has the columns named below alone, so columns of
the input can't clash with them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choralis.llm.common import WORD, chunks, few, map_arrow, written

WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "other letter", "digit", "space", "line end", "symbol", "sentence mark", "other mark", "other")
#: Words that a task counts before it passes the counts on.
COUNTED = 300_000


def _class_of(c: str) -> int:
    if c in SYMBOLS:
        return 6
    kind = unicodedata.category(c)
    if kind[0] in "LM":
        return {"Ll": 0, "Lu": 1}.get(kind, 2)
    if kind[0] == "N":
        return 3
    if c == "\n":
        return 5
    if c.isspace():
        return 4
    if c in ".,;:?-'\"()":
        return 7
    return 8 if kind[0] in "PS" else 9


_table: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _table:
        table = np.full(0x110000, 9, dtype=np.uint8)
        table[:0x3000] = [_class_of(chr(i)) for i in range(0x3000)]
        table[0x3000:0xD800] = 2
        table[0x20000:0x32000] = 2
        _table.append(table)
    return _table[0]


def classes(text: str) -> np.ndarray:
    """How many characters of each class the text has."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.bincount(class_table()[points], minlength=len(CLASSES))


@dataclass
class References:
    langs: list[str]
    words: dict[str, int]
    word_share: np.ndarray  # language x (common words of all languages, other)
    of: np.ndarray  # language x word: whether the word is common there
    class_share: np.ndarray


def learn_references(docs: DataFrame, common: float = 0.002, max_langs: int = 200) -> References:
    """docs: text, lang. More than max_langs languages are an error."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        marks: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in words.items() for w, n in c.items()]
            rows += [(lang, f" {i}", int(n)) for lang, m in marks.items() for i, n in enumerate(m)]
            words.clear()
            marks.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

        for batch, texts in chunks(batches):
            for lang, text in zip(batch.column(1).to_pylist(), texts, strict=True):
                words.setdefault(lang, Counter()).update(WORDS.findall(text))
                marks[lang] = marks.get(lang, 0) + classes(text)
            if sum(map(len, words.values())) > COUNTED:
                yield out()
        yield out()

    counted = map_arrow(docs.where("lang is not null and text is not null").select("text", "lang"), count, "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = written(counted, "quality-counts")
    sums = counted.where("word not like ' %'").groupBy("lang").agg(F.sum("n")).limit(max_langs + 1).collect()
    totals = {r[0]: r[1] for r in few(sums, max_langs, "languages")}
    marks = counted.where(F.col("lang").isin(list(totals))).where("word like ' %'").collect()
    if not totals:
        return References([], {}, np.zeros((0, 1)), np.zeros((0, 0), bool), np.zeros((0, len(CLASSES))))
    least = F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, float(max(2, v * common)))])
    rows = counted.where("word not like ' %'").where(F.col("n") >= least[F.col("lang")]).collect()
    langs = sorted(totals)
    words = {w: i for i, w in enumerate(sorted({r.word for r in rows}))}
    share = np.zeros((len(langs), len(words) + 1))
    for r in rows:
        share[langs.index(r.lang), words[r.word]] = r.n / totals[r.lang]
    of = share[:, :-1] > 0
    share[:, -1] = 1 - share[:, :-1].sum(axis=1)
    kinds = np.zeros((len(langs), len(CLASSES)))
    for r in marks:
        if r.lang in totals:
            kinds[langs.index(r.lang), int(r.word)] = r.n
    return References(langs, words, share, of, kinds / np.maximum(1, kinds.sum(axis=1, keepdims=True)))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, in the last axis: square root of the divergence in bits."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=-1)
    return np.sqrt(np.maximum(0, (a + b) / 2))


def divergences(refs: References, words: list[str], kinds: np.ndarray) -> tuple[float, float]:
    """Distance of the words' and of the characters' shares to the nearest reference."""
    if not refs.langs or not words:
        return 0.0, 0.0
    met = [i for i in map(refs.words.get, words) if i is not None]
    n = np.bincount(met, minlength=len(refs.words)) / len(words)
    own = np.where(refs.of, n, 0)
    own = np.c_[own, 1 - own.sum(axis=1)]
    return float(distance(own, refs.word_share).min()), float(distance(kinds / max(1, kinds.sum()), refs.class_share).min())


def repeated(words: list[list[str]]) -> list[int]:
    """Of each text, the words in three-word windows that it has twice or more."""
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for ws in words for w in ws], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    text = np.repeat(np.arange(len(words)), sizes)
    out = np.zeros(len(words), dtype=np.int64)
    if len(ids) > 2:
        at = np.flatnonzero(text[:-2] == text[2:])
        key = text[at].astype(np.uint64)
        for k in range(3):  # three 64-bit rounds: equal keys mean equal windows, but for odds of 1e-8 a chunk
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[at + k] + np.uint64(1)
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        marked = np.zeros(len(ids), dtype=bool)
        for k in range(3):
            marked[at[twice] + k] = True
        out = np.bincount(text[marked], minlength=len(words))
    return out.tolist()


def judge_quality(docs: DataFrame, refs: References, max_word_jsd: float = 0.34, max_class_jsd: float = 0.15, word_slack: float = 0.8, class_slack: float = 1.6, min_words: int = 50) -> DataFrame:
    """docs (doc_id, text) with the base counts, word_jsd, class_jsd, base_failed and kept. The references are small
    (see above), so they are broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(refs)
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in longs) + ", word_jsd double, class_jsd double, base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = held.value
        for batch, texts in chunks(batches):
            words = [WORDS.findall(t) for t in texts]
            cols: dict[str, list] = {x: [] for x in (*longs, "word_jsd", "class_jsd", "base_failed", "kept")}
            for text, ws, twice in zip(texts, words, repeated(words), strict=True):
                kinds = classes(text)
                lines = [x for x in text.split("\n") if WORDS.search(x)] if "\n" in text else []
                a, b = divergences(r, ws, kinds)
                failed = len(ws) < 50 or 100 * twice > 50 * len(ws)
                far = len(ws) >= min_words and (a > max_word_jsd + word_slack / len(ws) ** 0.5 or b > max_class_jsd + class_slack / max(1, len(text)) ** 0.5)
                row = (len(ws), sum(map(len, ws)), int(kinds[6]), len(lines) - len(set(lines)), twice, a, b, failed, not failed and not far)
                for c, v in zip(cols.values(), row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | cols)

    return map_arrow(docs.select("doc_id", "text"), run, schema)
