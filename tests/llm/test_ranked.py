"""Ranked search against a plain loop over all documents, and treaps by their invariants."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from choralis.llm import ranked
from choralis.llm.queries import op13_ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def looped(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def found(spark, docs, items, k=10, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = ranked.written(ranked.build_index(d, **{x: y for x, y in how.items() if x == "block"}), "test-index")
    q = spark.createDataFrame(items, "item_id long, text string")
    return Counter(map(tuple, ranked.search(index, q, k, **{x: y for x, y in how.items() if x == "batch"}).collect()))


def corpus(rng, n):
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)], [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(25)]


@pytest.mark.parametrize("how", [{}, {"block": 500}, {"block": 3000, "batch": 7}])
def test_search_matches_a_loop(spark, how):
    docs, items = corpus(random.Random(1), 700)
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # ties at the border of the k best
    assert found(spark, docs, items, **how) == looped(docs, items)


def test_pruning_changes_nothing_and_leaves_most_out():
    rng = np.random.default_rng(2)
    n, n_terms = 4000, 12
    docs = [np.sort(rng.choice(n, size=s, replace=False)) for s in (3, 9, 20, 40, *[800] * 8)]
    row = {"sizes": rng.integers(5, 900, n), "counts": np.array([len(d) for d in docs]), "docs": np.concatenate(docs), "times": np.concatenate([rng.integers(1, 4, len(d)) for d in docs])}
    p = ranked.Postings.of(row, np.arange(n_terms), n, int(row["sizes"].sum()))
    weights = np.array([9000, 8000, 7000, 6000, *[900] * 8])
    full = np.zeros(n, np.int64)
    np.add.at(full, p.doc[:-1], p.impact[:-1] * weights[p.key // n])
    for k in (1, 10, 5000):
        got, scores = ranked.best_of_block(p, np.arange(n_terms), weights, k, 0, np.arange(n))
        want = np.lexsort((np.arange(n), -full))[: min(k, int((full > 0).sum()))]
        assert (got == want).all() and (scores == full[want]).all()
    calls = []
    keep = p.worth_of
    p.worth_of = lambda t, d: calls.append(len(d)) or keep(t, d)
    ranked.best_of_block(p, np.arange(n_terms), weights, 10, 0, np.arange(n))
    assert sum(calls) < n / 4


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(3)
    priority = rng.permutation(500)
    left, right, root = ranked.treaps(priority, np.array([0, 200, 200]), np.array([200, 200, 500]))
    assert root[1] == -1

    def walk(v):
        if v < 0:
            return []
        for child in (left[v], right[v]):
            assert child < 0 or priority[child] < priority[v]
        return [*walk(left[v]), v, *walk(right[v])]

    assert walk(root[0]) == list(range(200)) and walk(root[2]) == list(range(200, 500))


def test_odd_rows_and_empty_tables(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (None, "Apple pie"), (4, "apple PIE"), (4, "apple PIE"), (5, "pie " * 9000), (6, "Äpfel apple\x00pear Straße"), (7, "x" * 60_000)]
    items = [(1, "apple pie apple"), (1, "apple pie apple"), (2, None), (3, "..."), (None, "ÄPFEL äpfel Äpfel"), (4, "unheard"), (5, "x" * 60_000), (6, "pear")]
    got = found(spark, docs, items, 3)
    assert got == looped(docs, items, 3)
    assert not found(spark, docs, items[2:4]) and not found(spark, [(1, None)], items) and not found(spark, docs[:0], items) and not found(spark, docs, items[:0])


def test_query_reads_the_tables_by_name(spark, tmp_path):
    docs, items = corpus(random.Random(9), 60)
    spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, TERMS int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, batch string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = op13_ranked(spark, str(tmp_path))
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, rows.collect())) == looped(docs, items)


def test_a_reader_holds_one_block_at_a_time(spark):
    docs, items = corpus(random.Random(5), 300)
    index = ranked.written_index(ranked.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), block=400))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert len(groups) > 3 * len(files) and set(groups) == {1}
    q = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, ranked.search(index, q).collect())) == looped(docs, items)
