import random

from pyspark.sql import functions as F

from memloom.llm import components as C
from memloom.llm.components import UnionFind, connected_components


def brute(pairs):
    names = sorted({x for p in pairs for x in p if None not in p})
    at = {n: i for i, n in enumerate(names)}
    sets = UnionFind(len(names))
    for a, b in pairs:
        if a is not None and b is not None:
            sets.union(at[a], at[b])
    return {n: names[sets.find(at[n])] for n in names}


def run(spark, pairs, parts=6, **kw):
    df = spark.createDataFrame(pairs, "a string, b string").repartition(parts)
    rows = connected_components(df, "a", "b", **kw).collect()
    got = {r.id: r.label for r in rows}
    assert len(got) == len(rows)
    return got


def graph(seed):
    r = random.Random(seed)
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]  # a long chain
    pairs += [("hub", f"x{i:03}") for i in range(150)]
    pairs += [(f"r{r.randrange(200):03}", f"r{r.randrange(200):03}") for _ in range(130)]
    pairs += [("s", "s"), ("u", "v"), ("v", "u"), ("u", "v"), (None, "u"), ("u", None)]
    r.shuffle(pairs)
    return pairs


def test_groups(spark):
    pairs = graph(1)
    assert run(spark, pairs) == brute(pairs)


def test_narrow_merging(spark):
    pairs = graph(2)
    assert run(spark, pairs, parts=9, fan_in=2) == brute(pairs)


def test_contraction_when_a_merge_would_be_too_large(spark):
    pairs = graph(3)
    assert run(spark, pairs, parts=8, fan_in=2, bound=60) == brute(pairs)


def test_empty_and_extra_columns(spark):
    assert run(spark, [(None, None)]) == {}
    assert run(spark, []) == {}
    df = spark.createDataFrame([("a", "b", 1, True)], "a string, b string, id int, self boolean")
    assert {r.id: r.label for r in connected_components(df).collect()} == {"a": "a", "b": "a"}


def test_a_hub_of_nearly_all_edges(spark):
    """Contraction with a hub: the groups are right and no task gets more than its bound."""
    pairs = [("hub", f"s{i:04}") for i in range(900)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("s0007", "c000"), ("x", "y")]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(8)
    got = {r.id: r.label for r in C.connected_components(df, bound=100).collect()}
    assert len(got) == 901 + 61 + 2 and set(got.values()) == {"c000", "x"} and got["y"] == "x"
    counts = [r["count"] for r in C._spread(df, -(-len(pairs) // 100)).groupBy(F.spark_partition_id()).count().collect()]
    assert max(counts) <= 100 + 8  # dealt out by each of 8 tasks in turn
    moves, rest = C._contract(df, 1, 12)
    assert "hub" not in {r.id for r in moves.collect()} and {"hub"} & {x for r in rest.collect() for x in r}
