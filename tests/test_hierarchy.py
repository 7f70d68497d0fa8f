import random

import pytest

from memloom.operators import hierarchy as H


def brute(pairs):
    parent = {}
    for i, p in pairs:
        if not i:
            continue
        parent.setdefault(i, None)
        if p:
            parent[i] = min(p, parent[i]) if parent[i] else p
    out = {}
    for i in parent:
        seen, at = [i], i
        while parent.get(at) in parent:
            at = parent[at]
            if at in seen:
                loop = seen[seen.index(at) :]
                out[i] = (min(loop), -1, None)
                break
            seen.append(at)
        else:
            out[i] = (at, len(seen) - 1, "/".join(reversed(seen)))
    return out


def run(spark, pairs, small=H.SMALL):
    df = spark.createDataFrame(pairs, "span_id string, parent_id string")
    h = H.materialize(H.build_hierarchy(df, small=small), "test")
    paths = {r.node_id: "/".join(r.path) for r in H.expand_paths(h).collect()}
    rows = h.collect()
    return {r.node_id: (r.root_id, r.depth, paths.get(r.node_id)) for r in rows}, h


def test_small_trees_and_loops(spark):
    pairs = [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("x", "y"), ("y", "z"), ("z", "y"), ("s", "s"), ("o", "missing"), ("p", "o"), ("b", None), ("b", "a"), ("e", "")]
    got, _ = run(spark, pairs)
    assert got == brute(pairs)


@pytest.mark.parametrize("small", [0, 60, H.SMALL])
def test_random_forest_with_hub_and_chain(spark, small):
    """Rounds over the cluster, in one task, and both after one another give the same."""
    r = random.Random(5)
    pairs = [(f"n{i:03}", f"n{r.randrange(i):03}" if i % 9 else None) for i in range(1, 160)]
    pairs += [(f"h{i:03}", "n001") for i in range(60)]
    pairs += [(f"c{i:03}", f"c{i - 1:03}" if i else "n002") for i in range(70)]
    pairs += [("l0", "l3"), ("l1", "l0"), ("l2", "l1"), ("l3", "l2"), ("t0", "l2"), ("t1", "t0")]
    got, h = run(spark, pairs, small)
    want = brute(pairs)
    assert got == want
    numbers = {}
    for x in h.where("not in_loop").collect():
        numbers.setdefault(x.root_id, []).append(x.pre)
    assert all(sorted(v) == list(range(len(v))) for v in numbers.values())
    below = {}
    for i, (_, d, path) in want.items():
        if d >= 0:
            for a in path.split("/")[:-1]:
                below.setdefault(a, set()).add(i)
    found = {}
    for row in H.descendants(h, h.select("node_id")).collect():
        found.setdefault(row.node_id, set()).add(row.descendant_id)
    assert found == below
    assert {r.node_id: r.n_descendants for r in h.where("not in_loop").collect()} == {i: len(below.get(i, ())) for i, v in want.items() if v[1] >= 0}


def test_spelling_nulls_empty(spark):
    got, _ = run(spark, [(" A ", None), ("B", "a"), ("b", " A"), (None, "a"), ("", "a")])
    assert got == {"a": ("a", 0, "a"), "b": ("a", 1, "a/b")}
    assert run(spark, [])[0] == {}


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("a", None, 1, "x"), ("b", "a", 2, "y")], "span_id string, parent_id string, size int, head string")
    assert {r.node_id: r.depth for r in H.build_hierarchy(df).collect()} == {"a": 0, "b": 1}


def test_query_gives_descendants_of_inner_nodes_too(spark, tmp_path):
    from memloom.plans.core_queries import QUERIES

    pairs = [("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "d"), ("x", "y"), ("y", "x")]
    spark.createDataFrame(pairs, "span_id string, parent_id string").write.parquet(str(tmp_path / "spans.parquet"))
    got = sorted((r.node_id, r.descendant_id) for r in QUERIES["p4_all_descendants"](spark, str(tmp_path)).collect())
    assert got == [("a", "b"), ("a", "c"), ("a", "d"), ("a", "e"), ("b", "c"), ("b", "d"), ("b", "e"), ("d", "e")]


def test_descendants_of_some_nodes(spark):
    r = random.Random(8)
    pairs = [(f"n{i:03}", f"n{r.randrange(max(0, i - 4), i):03}" if i else None) for i in range(120)]
    want, h = run(spark, pairs)
    asked = [f"n{i:03}" for i in range(0, 120, 7)]
    rows = [(x.node_id, x.descendant_id) for x in H.descendants(h, spark.createDataFrame([(a,) for a in asked + ["n000", "none"]], "node_id string")).collect()]
    assert sorted(rows) == sorted((a, i) for i, (_, _, path) in want.items() for a in path.split("/")[:-1] if a in asked)
