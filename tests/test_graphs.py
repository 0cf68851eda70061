"""Components of graphs of any size, and shortest paths from both ends, against plain searches."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from choralis.operators import graph


def plain_components(nodes, edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for start in sorted(nodes):
        todo = [start] if start not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


def found(spark, nodes, edges, finish):
    one = F.lit("g").alias("conv_id")
    n = spark.createDataFrame([(x,) for x in nodes], "account_id string").select(one, "account_id")
    e = spark.createDataFrame(edges, "source string, target string").select(one, "source", "target")
    rows = graph.components_iterative(n, e, finish).collect()
    assert len(rows) == len(nodes)
    return {r.account_id: r.component for r in rows}


def test_a_chain_of_ten_thousand_nodes_is_one_component(spark):
    names = [f"{i:05d}" for i in range(10_000)]
    random.Random(1).shuffle(names)  # so that names don't run along the chain
    got = found(spark, names, list(zip(names, names[1:], strict=False)), 1_000)
    assert set(got.values()) == {"00000"}


def test_components_by_rounds_alone(spark):
    rng = random.Random(2)
    names = [f"n{i}" for i in range(200)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(130)] + [("n0", f"n{i}") for i in range(1, 50)]
    edges += edges[:20] + [(b, a) for a, b in edges[20:40]] + [("n7", "n7")]
    assert found(spark, names, edges, 0) == plain_components(names, edges)
    assert found(spark, names, edges[:0], 0) == {x: x for x in names}


def test_components_keep_conversations_apart(spark):
    e = spark.createDataFrame([("x", "a", "b"), ("y", "b", "c")], "conv_id string, source string, target string")
    n = spark.createDataFrame([(c, a) for c in "xy" for a in "abc"], "conv_id string, account_id string")
    got = {(r.conv_id, r.account_id): r.component for r in graph.components_iterative(n, e, 0).collect()}
    assert got == {("x", "a"): "a", ("x", "b"): "a", ("x", "c"): "c", ("y", "a"): "a", ("y", "b"): "b", ("y", "c"): "b"}


def least_path(near, a, b):
    """The least of the shortest paths: back from the target by levels, then always the least next node."""
    far, todo = {b: 0}, deque([b])
    while todo:
        x = todo.popleft()
        for y in near[x]:
            if y not in far:
                far[y] = far[x] + 1
                todo.append(y)
    if a not in far:
        return None
    path = [a]
    while path[-1] != b:
        path.append(min(y for y in near[path[-1]] if far.get(y) == far[path[-1]] - 1))
    return path


@pytest.mark.parametrize(("nodes", "edges", "longest"), [(30, 40, 12), (12, 11, 5)])
def test_shortest_paths_of_all_pairs(spark, nodes, edges, longest):
    rng = random.Random(nodes)
    names = [f"a:{i:02d}" for i in range(nodes)]
    if edges == nodes - 1:
        links = list(zip(names, names[1:], strict=False))
    else:
        links = [tuple(rng.sample(names, 2)) for _ in range(edges)]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    rows = [("c", a, b, "K") for a, b in links] + [("c", b, a, "K") for a, b in links]
    wanted = [("c", a[2:], b[2:]) for a in names for b in names]
    got = graph.shortest_paths(
        spark.createDataFrame(wanted + wanted[:5], "conv_id string, source string, target string"), spark.createDataFrame(rows, "conv_id string, a string, b string, kind string"), longest
    ).collect()
    want = {}
    for a in names:
        for b in names:
            path = least_path(near, a, b) if a != b else None
            if path and len(path) - 1 <= longest:
                want[a[2:], b[2:]] = (len(path) - 1, path)
    assert {(r.source, r.target): (r.length, r.path) for r in got} == want and len(got) == len(want)
