"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from choralis.llm import bpe, common, language, lines, minhash, mixing, ngrams, private, quality, queries, topk, toxicity

WORD = re.compile(common.WORD)


def documents(rng, n, words=("the of and to in is was for on that with as at by from " + " ".join(f"w{i}" for i in range(200))).split()):
    return [" ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(n)]


# -- 1


def bag_of(t):
    w = WORD.findall(t or "")
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def classes(rows):
    bags = [(d, bag_of(t)) for d, t in rows]
    root = list(range(len(bags)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(bags)):
        for j in range(i):
            a, b = bags[i][1], bags[j][1]
            met = sum((a & b).values())
            if a and b and met >= 0.8 * (sum(a.values()) + sum(b.values()) - met):
                x, y = find(i), find(j)
                root[x] = y
    least = defaultdict(list)
    for i, (d, _) in enumerate(bags):
        least[find(i)].append(d)
    return {i: min(least[find(i)]) for i in range(len(bags))}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    shingles = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    s = minhash.signatures([(shingles, a), (shingles, b)], 4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_signatures_do_not_depend_on_the_chunk():
    rng = random.Random(14)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=n)) for n in [*range(1, 40), 300, 300] for _ in range(40)]
    bags = [minhash.bag(t) for t in texts]
    together = minhash.band_keys(minhash.signatures(bags))
    assert all((minhash.band_keys(minhash.signatures([bags[i]]))[0] == together[i]).all() for i in range(0, len(bags), 7))


def test_near_classes_match_brute_force(spark):
    rng = random.Random(2)
    texts = documents(rng, 40)
    for t in list(texts[:12]):
        for _ in range(rng.randint(1, 6)):
            w = t.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_near_classes_across_leaders(spark):
    """A chain of texts, each near the next one only, and a group around one text."""
    base = [f"t{i}" for i in range(200)]
    chain = [" ".join([f"c{k}_{i}" if i < 4 * k else w for i, w in enumerate(base)]) for k in range(6)]
    star = []
    for k in range(30):
        w = [f"z{i}" for i in range(120)]
        for p in random.Random(k).sample(range(120), 1 + k % 4):
            w[p] = f"e{k}_{p}"
        star.append(" ".join(w))
    rows = list(enumerate(chain + star))
    got = {r.doc_id: r.class_id for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


@pytest.mark.parametrize("sent", [0, 1000])
def test_near_classes_of_hot_leaders(spark, monkeypatch, sent):
    """One group of near copies that many tasks compare, and sets that are joined instead of sent."""
    monkeypatch.setattr(minhash, "HOT_MEMBERS", 4)
    rng = random.Random(4)
    base = [f"t{i}" for i in range(90)]
    texts = documents(rng, 10)
    for k in range(60):
        w = list(base)
        for p in rng.sample(range(90), k % 3):
            w[p] = f"n{k}_{p}"
        texts.append(" ".join(w))
    rows = [*enumerate(texts), *((500 + i, texts[20]) for i in range(30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_classes(docs, sent_keys=sent).collect()}
    want = classes(rows[:70])
    assert got == want | {500 + i: want[20] for i in range(30)}


def test_near_odd(odd, none):
    got = [(r.doc_id, r.class_id) for r in minhash.near_classes(odd).collect()]
    assert len(got) == 10 and got.count((1, 1)) == 2 and (6, 1) in got and (3, 3) in got and (2, 2) in got
    assert minhash.near_classes(none).count() == 0
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 8


def test_keep_one_with_missing_and_shared_ids(spark):
    """Unlike texts are of different classes, also without an id or under one id."""
    texts = documents(random.Random(15), 8)
    rows = [*((None, t) for t in texts[:5]), (None, texts[0]), (7, texts[5]), (7, texts[6]), (8, texts[6]), (9, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(docs).collect()]
    assert Counter(kept) == Counter([*((None, t) for t in texts[:5]), (7, texts[5]), (7, texts[6]), (9, texts[7])])
    found = minhash.near_classes(docs).select("doc_id", "class_id", "root").collect()
    assert len({r.root for r in found}) == 8 and len({r.root for r in found if r.class_id == 7}) == 2


# -- 2


def test_bpe_equals_library():
    tokenizers = pytest.importorskip("tokenizers")
    pt = pytest.importorskip("public_tokenizers")
    path = pt.path("byte_bpe_50k.json")
    theirs, ours = tokenizers.Tokenizer.from_file(path), bpe.BytePairs(queries.vocabulary())
    rng = random.Random(1)
    letters = list("abc  eeeaaaTHE'sdlvt \n\t\r0129.,!?é€𝒳你好\x1c\x85\xa0​　\x00½") + ["<|endoftext|>", " the", " hello", "'re"]
    texts = ["", "a" * 999, "<|endoftext|>"] + ["".join(rng.choices(letters, k=rng.randint(0, 99))) for _ in range(800)]
    for t, ids in zip(texts, ours.encode(texts), strict=True):
        want = theirs.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert ours.decode(ids) == theirs.decode(want, skip_special_tokens=False)
    for _ in range(100):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert ours.decode(np.array(ids, "<u4").tobytes()) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_odd(odd, none):
    pytest.importorskip("public_tokenizers")
    rows = {r.doc_id: r for r in bpe.token_digests(odd, queries.vocabulary()).collect()}
    assert rows[2].n_tokens == 0 and rows[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[5].decoded_sha256 == hashlib.sha256(b"x" * 30_000).hexdigest()
    assert bpe.token_digests(none, queries.vocabulary()).count() == 0


# -- 3


def toxic_rows(seed=1, n=600):
    rng = random.Random(seed)
    out = []
    for i, t in enumerate(documents(rng, n)):
        bad = i % 6 == 0
        w = t.split()
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "rotten", "foul"]))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(docs.where("doc_id % 3 <> 1"), labels)
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    right = [(scored[i] >= 0.7) == bool(y) for i, _, y in rows if i % 3 == 1]
    assert sum(right) / len(right) > 0.97
    long = " ".join(documents(random.Random(9), 200)) + " vile rotten foul"
    assert model.score([long])[0] > 0.7  # a small toxic part of a long text


def test_copies_do_not_shrink_the_samples(spark, monkeypatch):
    texts = ["a copied text"] * 600 + [f"text number {i}" for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    assert {r.text for r in toxicity.training_texts(docs, labels, 40).collect()} == set(texts)
    learnt = []
    monkeypatch.setattr(language.ContextTree, "learn", lambda texts, order: learnt.extend(texts))
    monkeypatch.setattr(language, "LanguageModel", lambda *x: None)
    language.learn_languages(docs.select("text", "lang"), 40)
    assert set(learnt) == {t.encode() for t in texts}


def test_least_hashes(spark):
    """As many rows of a group as asked for, the least by unsigned hash, whatever their number; in order of size limits."""
    rng = random.Random(3)
    rows = [(g, rng.randrange(-(2**63), 2**63), 10) for g, n in (("a", 5000), ("b", 30), (None, 70)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, h long, size int")
    got = defaultdict(list)
    for r in common.least_hashes(df, "g", "h", 50).collect():
        got[r.g].append(r.h)
    for g in ("a", "b", None):
        assert sorted(h % 2**64 for h in got[g]) == sorted(h % 2**64 for k, h, _ in rows if k == g)[:50]
    assert common.least_hashes(df, "g", "h", 50, "size", 105).groupBy("g").count().toDF("g", "n").where("n <> 10").count() == 0


def test_toxicity_models_sum_to_one():
    rows = [(t, y, i % 4) for i, t, y in toxic_rows(2, 400)]
    model = toxicity.fit_toxicity(rows, rare_pair=1.0)
    every = np.arange(model.uni.shape[1])
    assert len(model.pair_keys) > 10
    for h in [-1, 0, *sorted({int(k) // len(every) for k in model.pair_keys})[:20]]:
        assert np.exp(model.log_likelihoods(np.full(len(every), h), every)).sum(axis=1) == pytest.approx([1, 1])
    texts = [t for t, _, _ in rows] + ["", "vile", "never seen"]
    assert model.evidence(texts) == pytest.approx(model.telling().evidence(texts), abs=1e-9)


def brute_unigrams(cut, spread, rare, rounds):
    """P(w) of both classes from texts (class, words), by the definition."""
    n = [Counter(w for c, t in cut if c == k for w in set(t)) for k in (0, 1)]
    words = sorted({w for _, t in cut for w in t})
    size = len(words) + 1
    ends = Counter(b for _, b in {p for _, t in cut for p in zip(t, t[1:], strict=False)})
    kinds = max(1, sum(ends.values()))
    held = {w: max(0, ends[w] - 0.75) / kinds for w in words}
    low = {w: held[w] + (1 - sum(held.values())) / size for w in words}
    total = [sum(x.values()) for x in n]
    kept = [dict.fromkeys(words, 0.0), dict.fromkeys(words, 0.0)]
    for _ in range(rounds):
        both = {w: n[0][w] + n[1][w] - kept[0][w] - kept[1][w] for w in words}
        all_ = sum(both.values())
        own = {w: max(0, both[w] - 0.75) / all_ for w in words}
        shared = {w: own[w] + (1 - sum(own.values())) * low[w] for w in words}
        new = [{w: max(0, n[c][w] - total[c] * shared[w] - spread * (total[c] * shared[w]) ** 0.5 - rare) for w in words} for c in (0, 1)]
        change = max(abs(new[c][w] - kept[c][w]) for c in (0, 1) for w in words)
        kept = new
        if change < 0.01:
            break
    return [{w: kept[c][w] / total[c] + (1 - sum(kept[c].values()) / total[c]) * shared[w] for w in words} for c in (0, 1)], shared


def test_toxicity_unigrams_match_brute_force():
    rows = [(t, y, 1) for _, t, y in toxic_rows(4, 150)]
    model = toxicity.fit_toxicity(rows)
    cut, seen = [], set()
    for t, y, _ in sorted(rows):
        w = t.lower().split()
        if (key := (y, toxicity.near_key(w))) not in seen:
            seen.add(key)
            cut.append((y, w))
    want, _ = brute_unigrams(cut, 2.0, 1.0, toxicity.ROUNDS)
    for w, i in model.words.items():
        assert np.exp(model.uni[:, i]) == pytest.approx([want[0][w], want[1][w]])


def test_toxicity_curve():
    """Weights of 0 or more and a low score without evidence, whichever texts fit the curve; more evidence never scores less."""
    for seed in range(4):
        for folds in (2, 4):
            rows = [(t, y, (i * 7 + seed) % folds) for i, t, y in toxic_rows(seed, 180)]
            model = toxicity.fit_toxicity(rows)
            assert min(model.curve[1:]) >= 0
            assert model.score(["", "neverseen"]).max() <= 0.2 + 1e-9
    # what mostly toxic texts without evidence would pull up
    x, y = np.r_[np.zeros((40, 2)), [[2.0, 1.0]] * 3, [[0.0, 0.0]]], np.r_[np.ones(43), 0]
    a, b, c = toxicity._logistic(x, y, -1.5)
    assert a <= -1.5 and b >= 0 and c >= 0
    a, b, c = toxicity._logistic(np.c_[np.arange(50.0), -np.arange(50.0)], np.r_[np.zeros(25), np.ones(25)], -1.5)
    assert b > 0 and c == 0 and 1 / (1 + np.exp(-(a + 40 * b))) > 0.7


def test_toxicity_pairs_and_scores_match_brute_force():
    """Pairs, windows and scores by the definition, word by word."""
    rows = [(t, y, i % 4) for i, t, y in toxic_rows(6, 240)]
    model = toxicity.fit_toxicity(rows, rare_pair=1.0)
    cut, seen = [], set()
    for t, y, fold in sorted(rows):
        w = t.lower().split()
        if fold and (key := (y, toxicity.near_key(w))) not in seen:
            seen.add(key)
            cut.append((y, w))
    single, shared = brute_unigrams(cut, 2.0, 1.0, toxicity.ROUNDS)
    n = [Counter(p for c, t in cut if c == k for p in set(zip(t, t[1:], strict=False))) for k in (0, 1)]
    begun = [Counter(), Counter()]
    for k in (0, 1):
        for (h, _), m in n[k].items():
            begun[k][h] += m

    def kept(count, of, share):
        return max(0, count - of * share - 2 * (of * share) ** 0.5 - 1) / max(of, 1)

    ends = {}
    for h, w in {*n[0], *n[1]}:
        ends.setdefault(h, []).append(w)
    told = 0
    for h, found in ends.items():
        bound = {w: kept(n[0][h, w] + n[1][h, w], begun[0][h] + begun[1][h], shared[w]) for w in found}
        freed = 1 - sum(bound.values())
        got = np.exp(model.log_likelihoods(np.full(len(found), model.words[h]), np.array([model.words[w] for w in found])))
        for k in (0, 1):
            expected = {w: bound[w] + freed * single[k][w] for w in found}
            held = {w: kept(n[k][h, w], begun[k][h], expected[w]) if n[0][h, w] + n[1][h, w] > 1 else 0 for w in found}
            rest = 1 - sum(held.values())
            assert got[k] == pytest.approx([held[w] + rest * expected[w] for w in found])
        told += sum(x > 0 for x in bound.values())
    assert told > 10

    def brute_evidence(text):
        w = [model.words.get(x, 0) for x in text.lower().split()]
        gap = []
        for k, x in enumerate(w):
            p = model.log_likelihoods(np.array([w[k - 1] if k else -1]), np.array([x]))
            gap.append(float(p[1, 0] - p[0, 0]))
        if not gap:
            return 0.0, 0.0
        size = model.window
        if len(gap) <= size:
            best = sum(gap) / max(len(gap), size // 2)
        else:
            at = [*range(0, len(gap) - size, size // 2), len(gap) - size]
            best = max(sum(gap[k : k + size]) for k in at) / size
        return best, sum(gap) / len(gap)

    some = ["", "vile", "never seen words", *[t for t, _, _ in rows[:60]], " ".join(t for t, _, _ in rows[:30])]
    want = [brute_evidence(t) for t in some]
    assert model.evidence(some) == pytest.approx(np.array(want), abs=1e-9)
    a, b, c = model.curve
    assert model.score(some) == pytest.approx([1 / (1 + np.exp(-(a + b * x + c * y))) for x, y in want])


def test_toxicity_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (6, 1)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(odd, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd, model).collect())
    empty = toxicity.learn_toxicity(none, labels.limit(0))
    assert [r.score for r in toxicity.score_toxicity(odd, empty).collect()] == [0.0] * 10


# -- 4


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choices(["a", "b", "c", "d#", "e$"], k=rng.randint(0, 6))) for _ in range(rng.randint(0, 9))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality.judge_quality(docs, quality.learn_references(docs)).collect():
        t = texts[r.doc_id]
        w = WORD.findall(t)
        runs = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {i + k for i in range(len(w) - 2) if runs[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(again))
        assert r.base_failed == (len(w) < 50 or 2 * len(again) > len(w)) and not (r.base_failed and r.kept)


def test_quality_verdict(spark):
    rng = random.Random(4)
    plain = [" ".join(rng.choices(["the", "of", "and", "to"] * 9 + [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)], k=200)) for _ in range(300)]
    junk = [" ".join(f"X{rng.randrange(10**6)}$$$" for _ in range(200)) for _ in range(3)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(plain + junk)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality.judge_quality(docs, quality.learn_references(docs)).collect()}
    assert all(got[i] for i in range(300)) and not any(got[i] for i in range(300, 303))


def test_quality_odd(odd, none):
    rows = {r.doc_id: r for r in quality.judge_quality(odd, quality.learn_references(odd)).collect()}
    assert rows[2].n_words == 0 and rows[2].base_failed and not rows[2].kept
    assert quality.judge_quality(none, quality.learn_references(none)).count() == 0


# -- 5


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_trigrams(train, texts):
    """Of each text: tokens, known ones, training tokens, base score, score; and the probability function."""
    toks = lambda t: [*WORD.findall((t or "").translate(LOWER)), "\n"]
    train = [toks(t) for t in train]
    uni = Counter(w for t in train for w in t)
    total, kinds = sum(uni.values()), len(uni)
    three = Counter(x for t in train for x in zip(["<s>", "<s>", *t], ["<s>", *t], t, strict=False))
    two, one = Counter(), Counter()
    for (_, v, w), n in three.items():
        two[v, w] += n if v == "<s>" else 1
    for _, w in two:
        one[w] += 1

    def discounts(counts):
        n = Counter(counts)
        if not (n[1] and n[2]):
            return 0.5, 1.0, 1.5
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * 0.5, 0.05), k - 0.05) for k in (1, 2, 3)]

    d1, d2, d3 = discounts(one.values()), discounts(two.values()), discounts(three.values())

    def grouped(counts):
        by = defaultdict(list)
        for gram, n in counts.items():
            by[gram[:-1]].append(n)
        return by

    of2, of3 = grouped(two), grouped(three)

    def backed(n, ns, d, shorter):
        if not ns:
            return shorter
        return (max(0, n - (0, *d)[min(n, 3)]) + sum(d[min(x, 3) - 1] for x in ns) * shorter) / sum(ns)

    def p(u, v, w):
        low = backed(one[w], list(one.values()), d1, 1 / (kinds + 1))
        low = backed(two[v, w], of2.get((v,), []), d2, low)
        return backed(three[u, v, w], of3.get((u, v), []), d3, low)

    out = []
    for t in map(toks, texts):
        base = sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t)
        out.append((len(t), sum(uni[w] > 0 for w in t), total, base, sum(math.log10(p(*x)) for x in zip(["<s>", "<s>", *t], ["<s>", *t], t, strict=False))))
    return out, p, [*uni, "not a word"]


@pytest.mark.parametrize(("passes", "buckets"), [(2, None), (1, 2), (3, 64)])
def test_ngrams_match_brute_force(spark, passes, buckets, monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK", 3000)  # texts in many chunks, one longer than a chunk
    rng = random.Random(5)
    texts = [*documents(rng, 120), None, "", "unseen Words ÄB " + "z" * 300, "the " * 900, "two\x0bwords\u00a0here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = docs.where("doc_id % 4 <> 0")
    got = {r.doc_id: r for r in ngrams.score_ngrams(docs, ngrams.learn_ngrams(train.select("text"), passes, buckets)).collect()}
    want, p, words = brute_trigrams([t for i, t in enumerate(texts) if i % 4], texts)
    for context in (("<s>", "<s>"), ("<s>", words[0]), tuple(words[:2]), ("not a word", words[1])):
        assert sum(p(*context, w) for w in words) == pytest.approx(1)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3]) and r.score == pytest.approx(w[4])


def test_numbers_of_any_size():
    values = np.array([0, 1, 254, 255, 256, 2**32, 2**40 + 1])
    assert ngrams.number(ngrams.small(values), np.arange(7)[::-1]).tolist() == values[::-1].tolist()
    rows = np.array([[2**40, 1, 2, 3], [5, 4, 3, 2], [2**40, 1, 2, 3]])
    assert ngrams.decoded(ngrams.coded(rows), np.array([2, 1, 0])).tolist() == rows[::-1].tolist()
    keys = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    order, held = ngrams.sorted_table(keys)
    assert (order[ngrams.find(held, keys)] == np.arange(5000)).all() and (ngrams.find(held, ~keys) < 0).all()


def test_ngrams_odd(odd, none):
    rows = ngrams.score_ngrams(odd, ngrams.learn_ngrams(odd.select("text"))).collect()
    assert len(rows) == 10 and all(math.isfinite(r.score) for r in rows)
    assert ngrams.score_ngrams(none, ngrams.learn_ngrams(odd.select("text"))).count() == 0
    assert all(math.isfinite(r.score) for r in ngrams.score_ngrams(odd, ngrams.learn_ngrams(none.select("text"))).collect())


# -- 6


def brute_targets(size):
    names = sorted((x for x in size if x is not None)) + [x for x in size if x is None]
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}
    fixed, open_, total = {}, set(names), sum(size.values())
    while True:
        rest = total - sum(fixed.values())
        share = {x: rest * weight[x] / sum(weight[y] for y in open_) for x in open_}
        above = {x for x in open_ if share[x] > 3 * size[x]}
        if not above:
            return fixed | share
        fixed |= {x: 3 * size[x] for x in above}
        open_ -= above


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, t, rng.choice(["a", "a", "a", "b", "c", "ä", None])) for i, t in enumerate(documents(rng, 900))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mixed_sizes(docs).collect()}
    again = {r.doc_id: r for r in mixing.mixed_sizes(docs.repartition(7)).collect()}
    assert got == again
    size, taken = Counter(), Counter()
    for i, t, s in rows:
        assert got[i].size == len(t.split()) and got[i].taken in {k * got[i].size for k in range(4)}
        size[s] += got[i].size
        taken[s] += got[i].taken
    want = brute_targets(size)
    for i, _, s in rows:
        assert got[i].target == pytest.approx(want[s]) and got[i].source_size == size[s]
    for s in size:
        assert abs(taken[s] - want[s]) <= 60  # one document at most
    assert mixing.mix(docs).count() == sum(r.taken // r.size for r in got.values())


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 500, 2000), rng.random(2000)
    q = mixing.fly(p, size, rng.random(2000))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())


def test_mixing_of_equal_rows(spark, monkeypatch):
    """A third of all rows are one text: its copies are dealt out evenly and come as near to the target as others do."""
    monkeypatch.setattr(mixing, "COPIES", 7)
    rng = random.Random(8)
    rows = [(1, "one two three four", "a", 5)] * 100 + [(i + 2, t, rng.choice("ab"), i) for i, t in enumerate(documents(rng, 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key int").withColumns({c: F.lit(1) for c in ("n", "copies", "whole", "k")})
    got = mixing.mixed_sizes(docs.select("doc_id", "text", "source")).collect()
    assert len(got) == 300 and len({r.taken for r in got if r.doc_id == 1}) <= 2
    source = {i: s for i, _, s, _ in rows}
    for s in "ab":
        own = [r for r in got if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60 and all(r.taken <= 3 * r.size for r in own)
    assert mixing.mix(docs).columns == docs.columns


def test_mixing_odd(odd, none):
    rows = mixing.mixed_sizes(odd.select("doc_id", "text", "source")).collect()
    assert len(rows) == 10
    assert all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mixed_sizes(none.select("doc_id", "text", "source")).count() == 0 and mixing.mix(none).count() == 0


# -- 7


def test_lines_match_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, "\n".join(rng.choice(["  shared one", "shared two ", "own %d" % rng.randrange(50), "", "rare"]) for _ in range(rng.randint(0, 6))), rng.choice(["a", "b", "c", "d", None])) for i in range(80)]
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for k, x in enumerate(t.split("\n")):
            if x.strip():
                sites[x.strip()].add(s)
                first.setdefault(x.strip(), (i, k))
    want = {}
    for i, t, _ in rows:
        kept = [x for k, x in enumerate(t.split("\n")) if not x.strip() or len(sites[x.strip()]) < 3 or first[x.strip()] == (i, k)]
        want[i] = "\n".join(kept)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), 3)
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_lines_odd(odd, none):
    out = lines.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_removed", "emptied"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[2].text is None and not rows[2].emptied and rows[5].n_removed == 0
    assert lines.dedup_lines(none).count() == 0


@pytest.mark.parametrize("most", [1000, 0])
def test_lines_of_repeated_rows(spark, most):
    """Of equal rows one keeps the line; columns may have any names; joins with and without a broadcast agree."""
    rows = [*[(1, "same line\nx", "a", 7)] * 3, (2, "same line", "b", 1), (3, "q\nsame line\nsame line\nz", "c", 2), (4, None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, N_removed int").withColumns({c: F.lit(1) for c in ("emptied", "row", "whole", "gone", "lines", "key")})
    out = lines.dedup_lines(docs, most_broadcast=most)
    assert out.columns == [*docs.columns, "n_removed_", "emptied_"]
    got = Counter((r.doc_id, r.text, r.n_removed_, r.emptied_) for r in out.collect())
    assert got == Counter([(1, "same line\nx", 0, False), *[(1, "x", 1, False)] * 2, (2, "", 1, True), (3, "q\nz", 2, False), (4, None, 0, False)])


# -- 8


def test_language(spark):
    rng = random.Random(8)
    stems = {"aa": "bak lom tur".split(), "bb": "xiz qey wop".split(), "cc": "ñor çal ßim".split()}
    rows = [(i, " ".join("".join(rng.choices(stems[k], k=3)) for _ in range(rng.randint(1, 40))), k) for i in range(300) for k in [rng.choice(list(stems))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn_languages(docs.where("doc_id % 3 <> 1").select("text", "lang"))
    got = {r.doc_id: r.lang_pred for r in language.predict_languages(docs.select("doc_id", "text"), model).collect()}
    right = [got[i] == k for i, _, k in rows if i % 3 == 1]
    assert sum(right) / len(right) > 0.98


def test_code_lengths_match_brute_force():
    texts, order = [b"abracadabra", b"abcabc", b"zebra"], 3
    tree = language.ContextTree.learn(texts, order)
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        padded = b"\n" * order + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[k][padded[i - k : i]][padded[i]] += 1

    def bits(t):
        padded, out = b"\n" * order + t, 0.0
        for i in range(order, len(padded)):
            for k in range(order, -1, -1):
                c = counts[k].get(padded[i - k : i])
                if c is None:
                    continue
                n = sum(c.values()) + len(c)
                if padded[i] in c:
                    out -= math.log2(c[padded[i]] / n)
                    break
                out -= math.log2(len(c) / n)
            else:
                out += 8
        return out

    model = language.LanguageModel(["x"], [tree], order)
    probe = [b"abra", b"", b"q", b"zzz\nabc"]
    assert model.code_lengths(probe)[:, 0] == pytest.approx([bits(t) for t in probe])


def test_language_odd(odd, none):
    model = language.learn_languages(odd.select("text", "lang"))
    rows = {r.doc_id: r for r in language.predict_languages(odd.select("doc_id", "text"), model).collect()}
    assert rows[2].lang_pred == rows[3].lang_pred == rows[4].lang_pred == "und" and rows[1].lang_pred == "en"
    nothing = language.learn_languages(none.select("text", "lang"))
    assert {r.lang_pred for r in language.predict_languages(odd.select("doc_id", "text"), nothing).collect()} == {"und"}


# -- 9


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 0.3, (330, 16)).astype(np.float32)
    x[40:60] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(330)] + [(1000, None), (1001, [None] * 16), (1002, [float("nan")] * 16), (1003, [float("inf")] + [0.0] * 15), (None, [0.1] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in topk.search(df, block=100, queries=8).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    q = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    for i in range(0, 330, 20):
        s = q @ q[i]
        assert got[i] == [(j, int(s[j])) for j in sorted((j for j in range(330) if j != i), key=lambda j: (-s[j], j))[:20]]
    assert set(got) == set(range(0, 330, 20))
    assert topk.search(df.limit(0)).count() == 0
    bare = spark.createDataFrame([(i, []) for i in range(4)] + [(40, [1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id, r.score) for r in topk.search(bare).collect()) == [(0, 1, 0), (0, 2, 0), (0, 3, 0)]
    few = topk.search(df.where("vec_id < 3")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]


# -- 10

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_base_spans_match_patterns():
    rng = random.Random(10)
    parts = ["a", "b1", "@", ".", "a.b", "c@d.e", " ", "-", "+", "1", "23", "255", "256", "0001", "4539 1488 0343 6467", "4539148803436467", "(", ")", "é", "%", "1.2.3.4", "+1 (555) 123-4567"]
    for _ in range(5000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        want = []
        for kind, p in PATTERNS.items():
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and private._luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
                if ok:
                    want.append((kind, *m.span()))
        assert private.base_spans(t) == want
    assert private.base_spans("1" * 200_000 + "a" * 200_000 + "@") == []  # linear in long runs


def test_revealing_terms(spark):
    rng = random.Random(11)
    plain = documents(rng, 200)
    rows = [(i, t) for i, t in enumerate(plain)]
    for k in range(6):
        w = plain[k].split()
        rows.append((1000 + k, " ".join([*w, "captain", "zanzibar", "boss@corp.example.com", "the", *w])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = private.find_private(docs)
    by = {r.doc_id: r for r in found.collect()}
    text = dict(rows)
    for k in range(6):
        r = by[1000 + k]
        assert [s["kind"] for s in r.spans] == ["email"]
        terms = {text[1000 + k][s["a"] : s["b"]] for s in r.terms}
        assert {"captain", "zanzibar"} <= terms and "the" not in terms
    assert all(not by[i].terms for i in range(200))
    clean = {r.doc_id: r.sanitised for r in private.sanitise(docs).collect()}
    assert "boss@" not in clean[1000] and "[EMAIL]" in clean[1000] and "zanzibar" not in clean[1000] and clean[0] == text[0]


def test_ladder_and_secrets(spark):
    """Rungs that many documents share may be told, others not; secrets and failing card numbers are found."""
    key = "0b96a8c8d79c4a5085c919698889f59b72ab7bb6"
    texts = [*(f"write to u{i}@mail.example.org or call +49 30 1234 567{i}" for i in range(8)), f'token = "{key}" at 10.0.0.1, 4736962573099582', "plain words only"]
    assert private.extra_spans(texts[8], private.base_spans(texts[8])) == [("secret", 9, 49), ("number", 64, 80)]
    assert private.extra_spans("4111111111111111 abcdefghijklmnopqrstuvwxyz a1a1a1a1a1a1a1a1a1a1", [("card", 0, 16)]) == []
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, row int, whole int, sanitised int")
    out = private.sanitise(docs)
    assert out.columns == [*docs.columns, "sanitised_"]
    clean = {r.doc_id: r.sanitised_ for r in out.collect()}
    assert "[EMAIL @mail.example.org]" in clean[0] and "[PHONE +49...]" in clean[0]
    assert "[IP]" in clean[8] and "[SECRET]" in clean[8] and key not in clean[8] and "[NUMBER]" in clean[8] and clean[9] == texts[9]


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_revealing_terms_in_whole_texts(spark, sent):
    """Terms far from an identifier, of an entity in one text only, and in texts without the identifier, as brute force."""
    plain = documents(random.Random(16), 120)
    texts = [*plain, f"Heading-Kuala {plain[0]} x@one.org {plain[1]} footer.", f"again heading-kuala {plain[2]}", f"{plain[3]} y@two.org", f"{plain[4]} y@two.org z1z", None]
    held = [({t[a:b].lower() for _, a, b in private.base_spans(t or "")}, {private.term_of(w) for w in WORD.findall(t or "")} - {""}) for t in texts]
    d_t, d_e, d_et = Counter(t for _, w in held for t in w), Counter(e for s, _ in held for e in s), Counter((e, t) for s, w in held for e in s for t in w if t not in s)
    told = {t for (e, t), k in d_et.items() if math.log2(len(texts) * k / (d_e[e] * d_t[t])) >= 0.8 * math.log2(len(texts) / d_e[e])}
    assert {"heading-kuala", "footer", "z1z"} <= told
    got = {r.doc_id: [(s["a"], s["b"]) for s in r.terms] for r in private.find_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most_sent=sent).collect()}
    assert got == {i: [m.span() for m in WORD.finditer(t or "") if private.term_of(m[0]) in told] for i, t in enumerate(texts)}


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_terms_need_support(spark, sent):
    """Terms that share two different texts with an entity, as brute force; copies of a text are one."""
    plain = documents(random.Random(17), 120)
    texts = [*plain, f"{plain[0]} boss@one.org krypton", f"{plain[1]} boss@one.org Krypton, once", f"{plain[2]} y@two.org zirkon", f"{plain[2]} y@two.org zirkon", f"{plain[3]} alone@three.org argon", None, ""]
    held = [({t[a:b].lower() for _, a, b in private.base_spans(t or "")}, {private.term_of(w) for w in WORD.findall(t or "")} - {""}) for t in texts]
    d_t, d_e = Counter(t for _, w in held for t in w), Counter(e for s, _ in held for e in s)
    d_et, of = Counter((e, t) for s, w in held for e in s for t in w if t not in s), defaultdict(set)
    for text, (s, w) in zip(texts, held, strict=True):
        for e in s:
            for t in w - s:
                of[e, t].add(text)
    told = {t for (e, t), k in d_et.items() if len(of[e, t]) >= 2 and math.log2(len(texts) * k / (d_e[e] * d_t[t])) >= 0.8 * math.log2(len(texts) / d_e[e])}
    assert "krypton" in told and not {"zirkon", "argon", "once"} & told
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s["a"], s["b"]) for s in r.terms] for r in private.find_private(docs, most_sent=sent, support=2).collect()}
    assert got == {i: [m.span() for m in WORD.finditer(t or "") if private.term_of(m[0]) in told] for i, t in enumerate(texts)}
    clean = {r.doc_id: r.sanitised for r in private.sanitise(docs, support=2).collect()}
    assert "krypton" not in clean[120] and clean[122].endswith("zirkon") and "y@two.org" not in clean[122]
    # no address comes twice here, but their domain does, and the firm's name gives it away
    texts = [*plain, *(f"{plain[i]} u{i}@firm.org Firmware" for i in range(3)), "firmware without an address"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = {texts[r.doc_id][x["a"] : x["b"]] for r in private.find_private(docs, most_sent=sent, support=2, coarse=True).collect() for x in r.terms}
    assert {"Firmware", "firmware"} == {t for t in told if t.lower().startswith("firm")} and len(told) < 6
    assert all(not r.terms for r in private.find_private(docs, most_sent=sent, support=2).collect())


def test_private_odd(odd, none):
    assert private.sanitise(odd).count() == 10 and private.sanitise(none).columns == [*none.columns, "sanitised"]
    rows = {r.doc_id: r for r in private.find_private(odd.select("doc_id", "text")).collect()}
    assert [s["kind"] for s in rows[8].spans] == ["email", "phone"] and rows[2].spans == []
    assert private.find_private(none.select("doc_id", "text")).count() == 0


# -- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = [(i, t, "en", f"s{i % 5}", len(t)) for i, t, _ in toxic_rows(13, 240)]
    rows += [(1000 + i, rows[i][1], "en", f"s{(i + 1) % 5}", rows[i][4]) for i in range(1, 6)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 == 0), 1) for i in range(240)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = common.documents(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, str(tmp_path)), "test-stage")
        if name != "bpe":
            assert out.columns == docs.columns, name
        if name == "toxicity":
            assert {r.doc_id for r in out.collect() if r.doc_id < 240} == {i for i in range(240) if i % 6}
        if name == "near dedup":
            ids = {r.doc_id for r in out.collect()}
            assert not any(1000 + i in ids for i in range(1, 6) if i % 6)
        docs = out
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 100
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_stages_odd(spark, tmp_path, odd, none):
    """Nulls, repeated rows, very long texts, columns of any names and empty tables, stage by stage."""
    import corpus_pipeline

    clash = ["score", "N_removed", "emptied", "whole", "row", "key", "gone", "lines", "copies", "n", "k", "root", "node", "ids", "decoded"]
    rows = [(1, "a line\nown words here", "s1"), (1, "a line\nown words here", "s1"), (2, "a line", "s2"), (3, "a line\nx " + "long words " * 30_000, "s3"), (None, "no id", None), (5, None, "s1"), (6, "", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in clash})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sizes = {"toxicity": 7, "line dedup": 6, "near dedup": 6}
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, str(tmp_path)), "test-odd-stage")
        if name != "bpe":
            assert out.columns == docs.columns
        assert out.count() == sizes.get(name, out.count()), name
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and empty.columns == out.columns
        docs = out


def test_common(odd):
    got = {r[0]: r[1] for r in odd.select("doc_id", common.word_count(F.col("text"))).collect()}
    assert got[2] == 0 and got[3] == 0 and got[7] == 2
    assert [r[0] for r in odd.select(common.crc_mod(F.col("doc_id"), 3)).limit(3).collect()] == [common.crc_mod_py(d, 3) for d in (1, 1, 2)]
