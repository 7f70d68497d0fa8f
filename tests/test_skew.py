from collections import defaultdict

from pyspark.sql import functions as F

from memloom.operators import skew


def brute(rows):
    groups = defaultdict(list)
    for k, other, w in rows:
        groups[k].append((other, w))
    out = {}
    for k, xs in groups.items():
        others = sorted({o for o, _ in xs if o is not None})
        ws = [w for _, w in xs if w is not None]
        out[k] = (len(xs), round(sum(ws), 6) if ws else None, len(others))
    return out


def profile(spark, rows, partitions=5):
    df = spark.createDataFrame(rows, "k string, other string, w double")
    return {r.k: (r.n_rows, None if r.weight_sum is None else round(r.weight_sum, 6), r.n_others) for r in skew.key_profile(df, ["k"], "other", "w", partitions=partitions).collect()}


def test_profile_of_a_hot_key(spark):
    rows = [("hot", f"o{i % 37}", float(i % 5)) for i in range(900)] + [(f"k{i % 50}", f"o{i % 3}", None if i % 4 else 1.0) for i in range(400)]
    assert profile(spark, rows) == brute(rows)


def test_profile_of_one_key_over_all_partitions(spark):
    rows = [("k", f"o{i}", 1.0) for i in range(500)]
    assert profile(spark, rows, 7) == {"k": (500, 500.0, 500)}
    same = [("k", "o", 1.0)] * 500  # one composite value can't be cut, and must not be counted twice
    assert profile(spark, same, 7) == {"k": (500, 500.0, 1)}


def test_profile_nulls_repeats_empty(spark):
    rows = [(None, "a", 1.0), (None, None, None), ("k", None, 2.0), ("k", "a", None), ("k", "a", None)]
    assert profile(spark, rows) == brute(rows)
    assert profile(spark, []) == {}


def test_profile_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("k", "a", 1.0, 7, 8)], "k string, other string, w double, n_rows int, pid int")
    assert skew.key_profile(df, ["k"], "other", "w").collect()[0].n_rows == 1


def test_rank_equals_window(spark):
    rows = [("hot", i, i % 7) for i in range(600)] + [(f"k{i % 40}", i, i % 3) for i in range(300)] + [(None, 1, 5), (None, 2, None)]
    df = spark.createDataFrame(rows, "k string, v int, s int")
    got = {(r.k, r.v): (r["rank"], r.running) for r in skew.stitched_rank(df, ["k"], ["v"], "s", partitions=6).collect()}
    df.createOrReplaceTempView("t")
    want = {(r.k, r.v): (r.n, r.t) for r in spark.sql("SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) n, sum(coalesce(s, 0)) OVER (PARTITION BY k ORDER BY v) t FROM t").collect()}
    assert got == want


def test_rank_of_ties_and_empty(spark):
    df = spark.createDataFrame([("k", 1)] * 50, "k string, v int")
    assert sorted(r["rank"] for r in skew.stitched_rank(df, ["k"], ["v"], partitions=3).collect()) == list(range(1, 51))
    assert skew.stitched_rank(df.where("v = 2"), ["k"], ["v"]).collect() == []


def test_heavy_keys(spark):
    df = spark.createDataFrame([("s", "a", 60), ("s", "b", 1), ("t", "c", 1), ("t", "d", 99)], "side string, k string, n_rows long")
    assert {(r.side, r.k) for r in skew.heavy_keys(df, ["side"], 0.02).collect()} == {("s", "a"), ("t", "d")}


def test_top_per_key(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "k string, v int")
    got = {(r.k, r.v) for r in skew.top_per_key(df, ["k"], [F.desc("v")], 2).collect()}
    assert got == {("a", 8), ("a", 7), ("b", 1)}
