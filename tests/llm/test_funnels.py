"""Funnels against a plain walk over each client's rows."""

import random
from bisect import bisect_right
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from choralis.llm import funnels, queries
from choralis.llm.funnels import MINUTE, Funnel

THREE = [
    Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
    Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
]
START = datetime(2024, 1, 1)


def walked(rows, told, within=15 * MINUTE, percent=50):
    """{(funnel, client): (n1, ..., deepest, t2, ...)} from (client, kind, microseconds)."""
    by = defaultdict(lambda: defaultdict(list))
    for c, k, t in sorted({r for r in rows if None not in r}, key=lambda r: r[2]):
        by[c][k].append(t)

    def after(times, t):
        i = bisect_right(times, t)
        return times[i] if i < len(times) else None

    most = max(len(f.steps) for f in told)
    out = {}
    for f in told:
        for c, kinds in by.items():
            n, took = [0] * most, [[] for _ in range(most)]
            for t in kinds.get(f.steps[0], []):
                n[0] += 1
                for s, k in enumerate(f.steps[1:], 1):
                    to = after(kinds.get(k, []), t)
                    stops = [after(kinds.get(x, []), t) for x in f.excluded]
                    if to is None or to - t > within or any(x is not None and x <= to for x in stops):
                        break
                    n[s] += 1
                    took[s].append(to - t)
                    t = to
            if n[0]:
                mid = [sorted(x)[-(-percent * len(x) // 100) - 1] if x else None for x in took[1:]]
                out[f.name, c] = (*n, max(i + 1 for i, x in enumerate(n) if x), *mid)
    return out


def got(df, most=4):
    names = [f"n{s}" for s in range(1, most + 1)] + ["deepest"] + [f"t{s}" for s in range(2, most + 1)]
    rows = df.collect()
    return {(r.funnel, r.client_id): tuple(r[x] for x in names) for r in rows}, rows


def table(spark, rows, tmp_path):
    """As the tables have them: times without a zone, further columns, one of them by a name of the operator's own."""
    d = [(None if t is None else START + timedelta(microseconds=t), c, k, i) for i, (c, k, t) in enumerate(rows)]
    df = spark.createDataFrame(d, "ts timestamp_ntz, client_id long, kind string, span int")
    df.write.parquet(str(tmp_path / "clicks.parquet"))
    return df


def some_rows(rng, n, clients, seconds):
    kinds = ["view"] * 5 + ["click"] * 3 + ["purchase", "signup", "error"]
    rows = [(rng.choice(clients), rng.choice(kinds), rng.randrange(seconds) * 1_000_000 + rng.choice([0, 0, 1, 999_999])) for _ in range(n)]
    return rows + rows[: n // 10] + [(None, "view", 5), (1, None, 5), (1, "view", None)]


def test_query_matches_a_walk(spark, tmp_path):
    rng = random.Random(5)
    rows = some_rows(rng, 1500, [1] * 6 + [2, 3, 4, -5], 12 * 3600)
    table(spark, rows, tmp_path)
    found, full = got(queries.op11_funnels(spark, str(tmp_path)))
    assert found == walked(rows, THREE)
    depth = defaultdict(int)
    for r in full:
        depth[r.funnel, r.deepest] += 1
    assert all(r.same_depth == depth[r.funnel, r.deepest] for r in full)


@pytest.mark.parametrize(("span", "within", "percent"), [(MINUTE, 5 * MINUTE, 50), (7 * MINUTE, 7 * MINUTE, 90), (600 * MINUTE, MINUTE, 1)])
def test_spans_and_bounds_change_nothing(spark, tmp_path, span, within, percent):
    rng = random.Random(span)
    rows = some_rows(rng, 600, [7], 3600)
    told = [*THREE, Funnel("short", ("view", "purchase"), ()), Funnel("two", ("view", "click", "purchase"), ("error", "signup"))]
    df = table(spark, rows, tmp_path)
    assert got(funnels.count_funnels(df, told, within, span, percent))[0] == walked(rows, told, within, percent)


def test_edges_of_the_rules(spark, tmp_path):
    m = MINUTE
    rows = [
        (1, "view", 0), (1, "click", 15 * m),  # just in time
        (2, "view", 0), (2, "click", 15 * m + 1),  # a microsecond late
        (3, "view", 9), (3, "click", 9),  # equal times never follow
        (4, "view", 0), (4, "click", 5), (4, "error", 5),  # an exclusion at the step's own time
        (5, "view", 0), (5, "error", 0), (5, "click", 5), (5, "error", 6),  # at the previous step's, and after the next
        (6, "view", -1), (6, "click", 0), (6, "view", 1), (6, "purchase", 2),  # before 1970 and over a span's border
    ]
    df = table(spark, rows, tmp_path)
    found, _ = got(funnels.count_funnels(df, THREE[:1]))
    assert found == walked(rows, THREE[:1])
    assert [found["A", c][1] for c in range(1, 7)] == [1, 0, 0, 0, 1, 2 - 1]


def test_an_empty_table_has_no_rows(spark, tmp_path):
    table(spark, [], tmp_path)
    assert queries.op11_funnels(spark, str(tmp_path)).count() == 0


def test_times_do_not_depend_on_the_zone(spark, tmp_path):
    df = table(spark, [(1, "view", 3 * 86_400_000_000 + 7)], tmp_path)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        day = (START - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        assert df.select(funnels.micros(df, "ts")).head()[0] == day + 3 * 86_400_000_000 + 7
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
