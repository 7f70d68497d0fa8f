import random

import pytest

from memloom.operators import graph as G

EDGE = "source string, target string, relation string, weight double, expired boolean, seq long"


def make(spark, pairs, extra=()):
    rows = [(a, b, r, w, False, i) for i, (a, b, r, w) in enumerate(pairs)] + list(extra)
    ids = sorted({x for p in rows for x in p[:2]})
    return spark.createDataFrame(rows, EDGE), spark.createDataFrame([(i, f"node {i}") for i in ids], "id string, content string")


def dag(spark):
    return make(spark, [("n1", "n2", "causes", 0.9), ("n2", "n3", "causes", 0.5), ("n1", "n3", "similar_to", 1.0), ("n3", "n4", "is_part_of", 1.0)])


def ids(df):
    return {r.id for r in df.collect()}


def test_dag(spark):
    e, n = dag(spark)
    assert {(r.id, r.depth) for r in G.bfs(e, n, ["n1"], max_depth=1).collect()} == {("n2", 1), ("n3", 1)}
    assert ids(G.bfs(e, n, ["n2"], "backward", 2)) == {"n1"}
    assert ids(G.bfs(e, n, ["n2"], "forward", 2)) == {"n3", "n4"}
    assert ids(G.bfs(e, n, ["n1"], "forward", 2, relations=["causes"])) == {"n2", "n3"}
    assert {r.id for r in G.neighbors(e, n, "n2", "both").collect()} == {"n1", "n3"}
    assert ids(G.bfs(e, n, ["missing"])) == set()
    assert [r.path for r in G.shortest_path(e, n, "n1", "n4", 2).collect()] == [["n1", "n3", "n4"]]
    assert G.shortest_path(e, n, "n1", "n4", 1).collect() == []
    assert [r.path for r in G.shortest_path(e, n, "n1", "n1").collect()] == [["n1"]]
    assert {tuple(r.path) for r in G.all_paths(e, n, "n1", "n4", 4).collect()} == {("n1", "n3", "n4"), ("n1", "n2", "n3", "n4")}


def test_star_cap_is_soft(spark):
    e, n = make(spark, [("c", f"x{i}", "similar_to", 1.0) for i in range(10)])
    assert G.bfs(e, n, ["c"], "forward", 1, 5).count() == 10


def test_cycle_loop_and_expired(spark):
    e, n = make(spark, [("a", "b", "causes", 1.0), ("b", "c", "causes", 1.0), ("c", "a", "causes", 1.0), ("a", "a", "similar_to", 1.0)], [("a", "z", "causes", 1.0, True, 99)])
    assert ids(G.bfs(e, n, ["a"], max_depth=10)) == {"b", "c"}
    assert "z" in ids(G.bfs(e, n, ["a"], active_only=False))
    assert ids(G.bfs(e, n, ["a"], include_start=True)) == {"a", "b", "c"}
    assert {tuple(r.path) for r in G.all_paths(e, n, "a", "c", 5).collect()} == {("a", "b", "c")}


def model(pairs, start, depth, cap):
    adjacent = {}
    for i, (a, b, *_) in enumerate(pairs):
        adjacent.setdefault(a, []).append(b)
    out, seen, queue = [], {start}, [(start, 0)]
    while queue:
        node, d = queue.pop(0)
        if d >= depth or len(out) >= cap:
            break
        for t in adjacent.get(node, []):
            if t not in seen:
                seen.add(t)
                out.append((t, d + 1))
                queue.append((t, d + 1))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_order_and_cap_equal_a_queue(spark, seed):
    r = random.Random(seed)
    pairs = [(f"n{r.randrange(25)}", f"n{r.randrange(25)}", "causes", 1.0) for _ in range(60)] + [("n0", "n1", "causes", 1.0)]
    e, n = make(spark, pairs)
    for cap in (4, 100):
        got = [(x.id, x.depth) for x in G.bfs(e, n, ["n0"], "forward", 3, cap).orderBy("place").collect()]
        assert got == model(pairs, "n0", 3, cap)


def test_dfs_order(spark):
    e, n = make(spark, [("a", "b", "causes", 1.0), ("a", "c", "causes", 1.0), ("b", "d", "causes", 1.0), ("c", "e", "causes", 1.0)])
    assert [(r.id, r.depth) for r in G.dfs(e, n, "a").orderBy("place").collect()] == [("b", 1), ("c", 1), ("d", 2), ("e", 2)]


def test_explain(spark):
    e, _ = make(spark, [("a", "b", "causes", 0.9), ("b", "c", "causes", 0.5)])
    n = spark.createDataFrame([("a", "Supply shortage"), ("b", "Production delay"), ("c", "Stock drop in all of the markets")], "id string, content string")
    r = G.explain_relationship(e, n, "a", "c").collect()[0]
    assert (round(r.confidence, 6), r.weakest, r.path_type) == (0.45, 0.5, "causal")
    assert r.explanation == "Supply shortage causes Production delay, which Production delay causes Stock drop in all..."
    one = G.explain_relationship(e, n, "a", "a").collect()[0]
    assert (one.confidence, one.path_type, one.explanation) == (1.0, "associative", "Single node: Supply shortage")


def test_diamond_disconnected_subgraph(spark):
    e, n = make(spark, [("a", "b", "causes", 1.0), ("a", "c", "causes", 1.0), ("b", "d", "causes", 1.0), ("c", "d", "causes", 1.0), ("x", "y", "causes", 1.0)])
    assert [r.path for r in G.shortest_path(e, n, "a", "d").collect()] == [["a", "b", "d"]]
    assert G.shortest_path(e, n, "a", "y").collect() == []
    around, touching = G.subgraph(e, n, ["b"], 1)
    assert {r.id for r in around.collect()} == {"b", "d"} and {(r.source, r.target) for r in touching.collect()} == {("a", "b"), ("b", "d")}
    rows, near, totals = G.traverse(e, n, "a", "forward", 2)
    assert rows.count() == 3 and near.count() == 2 and totals.collect()[0].nodes == 3
