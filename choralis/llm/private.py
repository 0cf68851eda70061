"""Personal data: patterns for direct identifiers, and information-theoretic sanitisation of the terms that reveal them.

Base. E-mail addresses, IPv4 addresses, card numbers and phone numbers are found by pattern, leftmost and without
overlap for each kind, in whole texts and in time linear in the text.

Secrets. What stands outside these and carries at least `SECRET_BITS` bits by its own letters (length times entropy), in a
run of at least 16 letters and digits that has both, is a `secret`; 13 to 19 digits that fail the card check are a
`number`.

Disclosure. What a match of any of these says (its text in lower case) is a protected entity. Terms are all words of the
documents that hold one, outside its identifiers. Over the corpus, an entity e with document frequency d(e) carries
log2(N / d(e)) bits; a term t that shares d(e, t) documents with it reveals log2(N d(e, t) / (d(e) d(t))) of them. A term
that reveals at least `share` of an entity's bits is marked as kind `term` wherever it occurs, also in documents without
the entity. One meeting is no estimate: a word and an entity that each occur once reveal each other whole, whatever they
are. With a `support` of 2 or more, a term must share that many different texts with the entity; copies are one text.
Where it is `coarse`, the rungs of the ladders below (an address's domain, a network, ...) are protected too, unless they
say little, so that terms which reveal these, by many identifiers, are found where no identifier comes twice.

Sanitised texts. An identifier becomes the first rung of its kind's ladder (an address's domain, a network, a country
code, an issuer; then the kind alone) that says little: one that at least N ** share documents have. Terms go.

Document frequencies count all documents; d(t) is counted for every term that shares enough texts with entities. Offsets
count code points; ends are exclusive.

Defined cases. Null texts are empty and have no spans, and stay null when sanitised. Rows that repeat count, and are
marked, each; of rows that tie in id and text all get the same. Very long texts are searched whole, in linear time. An
empty table has no rows. Other columns are not read by the search, and stay beside a sanitised text, whose column gets
underscores where its name is taken.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choralis.llm.common import WORD, chunks, free_name, map_arrow, quoted, row_key, written

KINDS = ("email", "ip", "card", "phone")
#: The patterns, each taken from where a match can begin at the earliest.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORDS = re.compile(WORD)
EDGE = re.compile(r"^\W+|\W+$")
RUN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}(?![A-Za-z0-9])")
SECRET_BITS = 40.0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and not NOT_LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1  # no local part reaches over an @
        at = text.find("@", max(done, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return out


def extra_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Secrets, then numbers, that no base span touches."""
    if not DIGIT.search(text):
        return []
    starts, ends = _merged(base)

    def free(a: int, b: int) -> bool:
        k = bisect_right(ends, a)
        return k == len(starts) or starts[k] >= b

    out = []
    for m in RUN.finditer(text):
        run, n = m[0], len(m[0])
        digits = len(DIGIT.findall(run))
        if 0 < digits < n and free(*m.span()) and -sum(c * math.log2(c / n) for c in Counter(run).values()) >= SECRET_BITS:
            out.append(("secret", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and free(*m.span()):
            out.append(("number", *m.span()))
    return out


def all_spans(text: str) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    return base + extra_spans(text, base)


def ladder(kind: str, said: str) -> list[str]:
    """Ever more general stand-ins for an identifier."""
    digits = "".join(DIGIT.findall(said))
    if kind == "email":
        rungs = [f"[EMAIL {said[said.rindex('@'):].lower()}]"]
    elif kind == "ip":
        a = said.split(".")
        rungs = [f"[IP {a[0]}.{a[1]}.{a[2]}.x]", f"[IP {a[0]}.{a[1]}.x.x]"]
    elif kind == "phone":
        rungs = [f"[PHONE +{digits[:2]}...]", f"[PHONE +{digits[:1]}...]"]
    else:
        rungs = [f"[CARD {digits[:4]}...]"] if kind == "card" else []
    return [*rungs, f"[{kind.upper()}]"]


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - 2**63


def term_of(word: str) -> str:
    """A word in lower case without outer marks."""
    return EDGE.sub("", word).lower()


def _merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the base spans' union."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def free_words(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """The words that no base span touches."""
    starts, ends = _merged(spans)
    for m in WORDS.finditer(text):
        k = bisect_right(ends, m.start())
        if k == len(starts) or starts[k] >= m.end():
            yield m


def find_holders(docs: DataFrame) -> DataFrame:
    """text_hash, entities and terms (distinct hashes) and rungs of those of docs (doc_id, text) that have an identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            found = [(t, s) for t in texts if (s := all_spans(t))]
            entities = [sorted({_hash(f"{k}:{t[a:b].lower()}") for k, a, b in s}) for t, s in found]
            terms = [sorted({_hash(x) for w in {m[0] for m in free_words(t, s)} if (x := term_of(w))}) for t, s in found]
            rungs = [sorted({r for k, a, b in s for r in ladder(k, t[a:b])[:-1]}) for t, s in found]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict(
                {"text_hash": pa.array([_hash(t) for t, _ in found], pa.int64()), "entities": pa.array(entities, longs), "terms": pa.array(terms, longs), "rungs": pa.array(rungs, pa.list_(pa.string()))}
            )

    return map_arrow(docs.select("text"), run, "text_hash long, entities array<long>, terms array<long>, rungs array<string>")


#: Term hashes up to this number (8 bytes each) are sent to the workers, more are joined.
SENT_TERMS = 1_000_000


def _sent(terms: DataFrame, most: int) -> np.ndarray | None:
    """The sorted hashes in terms (t), or None if they are too many to be sent."""
    return np.sort(terms.toArrow().column("t").to_numpy()) if terms.count() <= most else None


def term_frequency(docs: DataFrame, terms: DataFrame, most_sent: int = SENT_TERMS) -> DataFrame:
    """t and the number of documents that hold the term, for the hashes in terms (t)."""
    wanted = _sent(terms, most_sent)
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held.value
        known: dict[str, int | None] = {}
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"t": pa.array(list(total.keys()), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})
            total.clear()
            return batch

        for _, texts in chunks(batches):
            for text in texts:
                words = set(WORDS.findall(text))
                new = [w for w in words if w not in known]
                if new:
                    if len(known) > 400_000:
                        known.clear()
                        new = list(words)
                    h = np.array([_hash(term_of(w)) for w in new], dtype=np.int64)
                    if keys is not None:
                        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                        hit = (keys[at] == h).tolist() if len(keys) else [False] * len(h)
                    else:
                        hit = [True] * len(h)
                    known.update((w, x if y else None) for w, x, y in zip(new, h.tolist(), hit, strict=True))
                total.update({known[w] for w in words} - {None})
            if len(total) > 400_000:
                yield out()
        yield out()

    counted = map_arrow(docs.select("text"), run, "t long, n long")
    return counted.groupBy("t").agg(F.sum("n").alias("n_t")).join(terms, "t", "left_semi")


SPAN = "struct<kind:string,a:int,b:int>"


def marked(docs: DataFrame, terms: DataFrame, most_sent: int = SENT_TERMS) -> DataFrame:
    """doc_id, row, spans (base spans), extra (secrets and numbers) and terms (spans of all words whose hash is in
    terms (t)) of docs (doc_id, text)."""
    wanted = _sent(terms, most_sent)
    held = docs.sparkSession.sparkContext.broadcast(wanted)
    span = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))
    word = pa.list_(pa.struct([("t", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))

    def structs(spans: list[list[tuple[str, int, int]]]) -> pa.Array:
        return pa.array([[dict(zip(("kind", "a", "b"), x, strict=True)) for x in s] for s in spans], span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held.value
        known: dict[str, int | None] = {}
        for batch, texts in chunks(batches):
            base = [base_spans(t) for t in texts]
            extra = [extra_spans(t, s) for t, s in zip(texts, base, strict=True)]
            found = []
            for text, s in zip(texts, map(list.__add__, base, extra), strict=True):
                words = set(WORDS.findall(text))
                new = [w for w in words if w not in known]
                if new:
                    if len(known) > 400_000:
                        known.clear()
                        new = list(words)
                    names = [term_of(w) for w in new]
                    h = np.array([_hash(x) for x in names], dtype=np.int64)
                    hit = np.ones(len(h), bool)
                    if keys is not None:
                        hit = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h if len(keys) else ~hit
                    known.update((w, x if y and n else None) for w, x, y, n in zip(new, h.tolist(), hit.tolist(), names, strict=True))
                here = any(known[w] is not None for w in words)
                found.append([{"t": t, "a": m.start(), "b": m.end()} for m in free_words(text, s) if (t := known[m[0]]) is not None] if here else [])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "row": batch.column(1), "spans": structs(base), "extra": structs(extra), "words": pa.array(found, word)})

    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_arrow(rows, run, f"doc_id {kind}, row long, spans array<{SPAN}>, extra array<{SPAN}>, words array<struct<t:long,a:int,b:int>>")
    if wanted is not None:
        return out.select("doc_id", "row", "spans", "extra", F.transform("words", lambda w: F.struct(F.lit("term").alias("kind"), w["a"].alias("a"), w["b"].alias("b"))).alias("terms"))
    out = written(out, "private-marked")
    added = out.select("row", F.explode("words").alias("w")).select("row", "w.*").join(terms, "t", "left_semi")
    added = added.groupBy("row").agg(F.sort_array(F.collect_set(F.struct(F.lit("term").alias("kind"), "a", "b"))).alias("terms"))
    return out.join(added, "row", "left").select("doc_id", "row", "spans", "extra", F.coalesce("terms", F.array().cast(f"array<{SPAN}>")).alias("terms"))


def learn_disclosure(docs: DataFrame, share: float = 0.8, most_sent: int = SENT_TERMS, support: int = 1, coarse: bool = False) -> tuple[DataFrame, list[str]]:
    """t, the hashes of the terms that reveal an entity of docs (doc_id, text) and share at least `support` different texts
    with it, and the rungs that say little. `coarse`: rungs of ladders are entities too, but for these. There are fewer of these than rungs in all documents, at most two for each
    identifier, over N ** share.

    Entities and terms that fewer texts hold go before they meet, and so do common terms: as d(e, t) is at most d(e), a
    term that reveals enough has d(t) of at most N ** (1 - share) * d(e) ** share."""
    n = docs.count()
    holders = find_holders(docs).groupBy("text_hash").agg(F.count("*").alias("n"), *(F.first(x).alias(x) for x in ("entities", "terms", "rungs")))
    holders = written(holders, "private-holders")
    little = max(2.0, n**share)
    each = holders.select("text_hash", "n", F.explode("entities").alias("e"), F.lit(float(n)).alias("below"))
    if coarse:
        wide = holders.select("text_hash", "n", F.explode("rungs").alias("rung")).select("text_hash", "n", F.xxhash64("rung").alias("e"), F.lit(float(little)).alias("below"))
        each = each.unionByName(wide)
    d_e = each.groupBy("e").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts"), F.min("below").alias("below"))
    d_e = d_e.where((F.col("texts") >= support) & (F.col("n_e") < F.col("below"))).select("e", "n_e")
    each = written(each.drop("below").join(d_e, "e"), "private-entities")
    own = holders.join(each.select("text_hash").distinct(), "text_hash", "left_semi").select("text_hash", F.explode("terms").alias("t"))
    often = own.groupBy("t").agg(F.count("*").alias("texts")).where(F.col("texts") >= support).select("t")
    d_t = written(term_frequency(docs, often, most_sent), "private-terms")
    most = each.agg(F.max("n_e")).first()[0] or 1
    rare = d_t.where(F.col("n_t") <= n ** (1 - share) * most**share * (1 + 1e-9))
    met = own.join(rare, "t").join(each, "text_hash").groupBy("e", "n_e", "t", "n_t").agg(F.sum("n").alias("n_et"), F.count("*").alias("texts"))
    bits = F.log2(F.lit(float(n)) / F.col("n_e"))
    told = met.where((F.col("texts") >= support) & (F.log2(F.lit(float(n)) * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) >= share * bits))
    rungs = holders.select("n", F.explode("rungs").alias("rung")).groupBy("rung").agg(F.sum("n").alias("n")).where(F.col("n") >= little)
    return written(told.select("t").distinct(), "private-told"), sorted(r.rung for r in rungs.collect())


def find_private(docs: DataFrame, share: float = 0.8, most_sent: int = SENT_TERMS, support: int = 1, coarse: bool = False) -> DataFrame:
    """doc_id, row, spans (base spans), extra and terms (spans of revealing terms) of docs (doc_id, text)."""
    return marked(docs, learn_disclosure(docs, share, most_sent, support, coarse)[0], most_sent)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")


def cleaned(text: str | None, spans: list[tuple[str, int, int]], rungs: set[str]) -> str | None:
    """The text with its identifiers as the first rungs that may be told, and without the terms."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            steps = [""] if kind == "term" else ladder(kind, text[a:b])
            out += [text[at:a], next((r for r in steps[:-1] if r in rungs), steps[-1])]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, share: float = 0.8, support: int = 1, coarse: bool = False) -> DataFrame:
    """docs (doc_id, text and others) with `sanitised`."""
    terms, rungs = learn_disclosure(docs.select("doc_id", "text"), share, support=support, coarse=coarse)
    found = marked(docs.select("doc_id", "text"), terms)
    told = docs.sparkSession.sparkContext.broadcast(set(rungs))
    name = free_name("sanitised", docs.columns)
    spans = found.select("row", F.concat("spans", "extra", "terms").alias("found")).dropDuplicates(["row"])
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("whole"), row_key("doc_id", "text").alias("row"))
    keyed = whole.join(spans, "row").select("whole", F.col("whole.text").alias("text"), "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in chunks(batches):
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = [cleaned(t, [(s["kind"], s["a"], s["b"]) for s in x], told.value) for t, x in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_pydict({"whole": batch.column(0), "cleaned": pa.array(out, pa.string())})

    schema = keyed.select("whole").schema.add("cleaned", "string")
    return map_arrow(keyed, run, schema).select("whole.*", F.col("cleaned").alias(name))
