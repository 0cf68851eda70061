"""Document statistics one by one in plain Python, the densities by their formula, held-out accuracy."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from choralis.llm import discriminant, queries
from choralis.llm.discriminant import NAMES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
JUNK = [" | ".join(["menu", "home", "page"] * 9), "BUY THIS NOW!! " * 8, "spam$$$ and### more*** " * 9, "same same same same " * 12]


def plain(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    black = [c for c in text if not re.match(r"[\x20\x09-\x0D]", c)]
    letter = [c for c in black if c.isascii() and c.isalpha() or ord(c) > 127]
    upper = [c for c in letter if c.isascii() and c.isupper() or "À" <= c <= "Þ" and c != "×"]

    def share(x, of):
        return math.sqrt(x / max(1, of))

    def kind(chars):
        return share(sum(c in chars for c in black), len(black))

    marks = set(map(chr, range(33, 127))) - set("0123456789.,;:!?#*$%&<>|") - {chr(c) for c in range(128) if chr(c).isalpha()}
    return [
        math.log1p(len(words)), math.log1p(len(black) / max(1, len(words))), math.log1p(len(words) / max(1, len(lines))), share(len(upper), len(letter)),
        kind("0123456789"), kind(".,;:"), kind("!?"), kind("#*$%&<>"), kind("|"), kind(marks),
        share(sum(not any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w) for w in words), len(words)),
        share(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words)), math.log1p(len(set(words))) / max(1, math.log1p(len(words))),
        share(len(lines) - len(set(lines)), len(lines)), share(sum(w[0] in upper for w in words), len(words)),
    ]


def test_statistics_match_plain_ones():
    rng = random.Random(3)
    texts = ["", " \n\t ", "a", "A b\nA b\n\nA b", "Été Über × Çà 漢字 42 x_y", *JUNK, "x" * 30_000, "\n".join(["one two", " one two", "one two"] * 40)]
    texts += ["".join(rng.choices("aB é|#\n1.!?<~", k=rng.randint(0, 300))) for _ in range(60)]
    for some in (texts, texts[::-1], texts[7:9]):
        assert np.allclose(discriminant.statistics(some), [plain(t) for t in some])
    assert len(NAMES) == len(plain("a"))


def test_a_text_longer_than_a_chunk_is_taken_whole():
    rng = random.Random(4)
    text = " ".join(rng.choices([f"w{i}" for i in range(3000)], k=260_000)) + " END!!\nlast\nlast"
    assert len(text) > discriminant.CHUNK_CHARS
    assert np.allclose(discriminant.statistics([text, "a"]), [plain(text), plain("a")])


def test_evidence_is_the_difference_of_the_normal_densities():
    rng = np.random.default_rng(1)
    d = len(NAMES)
    x = [rng.normal(size=(50, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d) for _ in (0, 1)]
    m = discriminant.from_sums(np.array([50.0, 50.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]), 0.3, 0.1, 1.0)
    own = [np.cov(a.T, bias=True) for a in x]
    unit = np.diag(np.sqrt(np.diag((own[0] + own[1]) / 2)))
    flat = np.linalg.inv(unit)
    s = [unit @ (0.9 * (flat @ (0.7 * o + 0.3 * (own[0] + own[1]) / 2) @ flat) + 0.1 * np.eye(d)) @ unit for o in own]

    def density(v, c):
        e = v - x[c].mean(0)
        return -0.5 * (e @ np.linalg.inv(s[c]) @ e + np.linalg.slogdet(s[c])[1])

    probe = rng.normal(size=(9, d))
    assert np.allclose(m.evidence(probe), [density(v, 1) - density(v, 0) for v in probe])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    prose = "the of and to in river house Walks, green. Again morning. They over stone window, quietly".split()
    docs = []
    for i in range(400):
        good = i % 3 > 0
        words = [rng.choice(prose) + rng.choice(["", "", "a", "er"]) for _ in range(rng.randint(20, 90))]
        text = " ".join(words) if good else rng.choice([" | ".join(words), " ".join(words).upper().replace(" ", "!! "), " ".join(w + rng.choice(["###", "$$$"]) for w in words)])
        docs.append((i, text, int(good)))
    docs += [(900, None, 1), (901, "", 0), (902, "x" * 30_000, None), (None, "no id here at all", None), (3, docs[3][1], None)]
    at = tmp_path_factory.mktemp("quality")
    table = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    table.select("doc_id", "text", F.lit("z").alias("X"), F.lit(1).alias("Score")).write.parquet(f"{at}/documents.parquet")
    told = table.where("quality is not null and doc_id is not null").select("doc_id", "quality")
    told.unionAll(told.where("doc_id = 1").select("doc_id", F.lit(7))).write.parquet(f"{at}/labels.parquet")
    return str(at), docs


def test_query_tells_held_out_junk_from_prose(spark, folder):
    rows = queries.op12_discriminant(spark, folder[0]).collect()
    assert len(rows) == len(folder[1])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = {i: y for i, t, y in folder[1] if i is not None and i < 900}
    told = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert len(told) > 80 and sum(a == b for a, b in told) >= 0.98 * len(told)


def test_learning_reads_no_held_out_row(spark, folder):
    stats = discriminant.document_statistics(spark.read.parquet(f"{folder[0]}/documents.parquet"))
    seen = queries.common.crc_mod(F.col("doc_id"), 3) != 1
    told = spark.read.parquet(f"{folder[0]}/labels.parquet")
    a = discriminant.learn_discriminant(stats.where(seen), told)
    b = discriminant.learn_discriminant(stats.where(seen), told.where(seen))
    assert np.allclose(a.middle, b.middle) and np.allclose(a.factor, b.factor)


def test_without_labels_of_both_classes_all_score_half(spark, odd, none):
    stats = discriminant.document_statistics(odd.select("doc_id", "text"))
    for told in (none.selectExpr("doc_id", "1 as quality"), odd.selectExpr("doc_id", "1 as quality"), odd.selectExpr("doc_id", "3 as quality")):
        found = discriminant.score_quality(stats, discriminant.learn_discriminant(stats, told)).collect()
        assert [r.score for r in found] == [0.5] * odd.count()
    assert discriminant.score_quality(stats.limit(0), discriminant.learn_discriminant(stats, told)).count() == 0
