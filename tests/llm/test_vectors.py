import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import vectors as V


def clustered(n, seed, dim=16, spread=0.15):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 5, dim))
    x = centres[r.integers(0, len(centres), n)] + spread * r.standard_normal((n, dim))
    return (x * r.uniform(0.1, 50, (n, 1))).astype(np.float32)


def brute(ids, x, k, least):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    out = {}
    for i, a in enumerate(ids):
        rest = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i)[:k]
        out[a] = [(b, -c) for c, b in rest if -c >= least]
    return out


def test_graph_search_recall():
    x = clustered(1500, 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = V.Graph(x)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    got = np.take_along_axis(g.near, np.argsort(-g.near_sim, axis=1), 1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(want, got)]) > 0.95
    assert (g.deg <= g.width).all()


def test_pruning_keeps_diverse_edges():
    x = np.array([[1, 0], [0.99, 0.141], [0.985, 0.1725], [0, 1]], dtype=np.float32)
    kept = V.prune(x, np.array([0]), np.array([[1, 2, 3, -1, 0, 1]]), 3, 1.2)
    assert kept[0].tolist() == [1, 3, -1]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    out = {}
    for r in V.nearest_vectors(df, "id", "embedding", **kw).orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append((r.neighbour, r.cosine))
    return out


def test_recall_over_shards(spark):
    x = clustered(1200, 2)
    ids = [f"v{i:04}" for i in range(len(x))]
    got = run(spark, list(zip(ids, x.tolist())), k=5, min_cosine=0.85, dim=16, shard=250)
    want = brute(ids, x, 5, 0.85)
    n = sum(len(w) for w in want.values())
    hit = sum(len({b for b, _ in w} & {b for b, _ in got.get(a, [])}) for a, w in want.items())
    assert hit / n > 0.95
    for a, found in got.items():
        assert len(found) <= 5 and [c for _, c in found] == sorted((c for _, c in found), reverse=True) and all(c >= 0.85 for _, c in found)


def test_copies_take_the_smallest_ids(spark):
    same = [0.5] * 16
    other = [0.5] * 15 + [0.4]
    rows = [(f"c{i:02}", same) for i in range(9)] + [("d0", other)]
    got = run(spark, rows, k=3, dim=16)
    assert [b for b, _ in got["c00"]] == ["c01", "c02", "c03"]
    assert [b for b, _ in got["c05"]] == ["c00", "c01", "c02"]
    assert [b for b, _ in got["d0"]] == ["c00", "c01", "c02"]
    pair = run(spark, [("a", same), ("b", same), ("z", other)], k=3, dim=16)
    assert [b for b, _ in pair["a"]] == ["b", "z"]


def test_unusable_vectors(spark):
    good, nan, inf = [1.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15
    rows = [("a", good), ("b", [2.0] * 16), ("n", None), ("e", []), ("s", [1.0] * 15), ("z", [0.0] * 16), ("f", nan), ("i", inf), ("h", [None] + [1.0] * 15), ("big", [1e38] * 16), ("tiny", [1e-38] * 16)]
    got = run(spark, rows, k=5, dim=16)
    assert set(got) == {"a", "b", "big", "tiny"} and all({b for b, _ in v} == set(got) - {k} for k, v in got.items())
    assert run(spark, [("n", None)], dim=16) == {}


@pytest.mark.parametrize("shard", [400, 100, 40])
def test_recall_without_a_floor_at_several_shard_counts(spark, shard):
    x = np.random.default_rng(4).standard_normal((2400, 16)).astype(np.float32)  # nothing is near: the hard case
    x[:600] = x[0] + 0.02 * x[:600]  # a dense region of a quarter of all
    ids = [f"v{i:04}" for i in range(len(x))]
    got = run(spark, list(zip(ids, x.tolist())), k=5, dim=16, shard=shard)
    want = brute(ids, x, 5, -1)
    assert all(len(v) == 5 for v in got.values()) and len(got) == len(ids)
    hit = sum(len({b for b, _ in w} & {b for b, _ in got[a]}) for a, w in want.items())
    assert hit / (5 * len(ids)) >= 0.9


def test_dense_regions_get_centres_of_their_own():
    r = np.random.default_rng(3)
    x = r.standard_normal((4000, 16)).astype(np.float32)
    x[:2000] = x[0] + 0.01 * x[:2000]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k, at_once in ((16, 256), (60, 20)):
        c = V.fit_centres(x, k, at_once=at_once)
        assert np.bincount(np.argmax(x @ c.T, axis=1)).max() <= 4 * len(x) / k and len(c) <= 3 * k


def test_shards_are_placed_by_weight(spark):
    weights = {i: float(100 - i) for i in range(40)}
    keys = V._placed(weights, 7, spark)
    rows = spark.createDataFrame([(i, keys[i]) for i in weights], "shard int, task int").repartition(7, "task").withColumn("pid", F.spark_partition_id()).collect()
    loads = {}
    for r in rows:
        loads[r.pid] = loads.get(r.pid, 0) + weights[r.shard]
    assert len(loads) == 7 and max(loads.values()) <= 1.15 * min(loads.values())


def test_a_large_class_is_dealt_over_salts(spark, monkeypatch):
    monkeypatch.setattr(V, "SALT", 7)
    rows = [(f"c{i:02}", [0.5] * 16) for i in range(50)] + [("d0", [0.5] * 15 + [0.4]), ("d1", [0.5] * 15 + [0.4])]
    got = run(spark, rows, k=3, dim=16)
    assert len(got) == 52 and [b for b, _ in got["c40"]] == ["c00", "c01", "c02"] and [b for b, _ in got["d1"]] == ["d0", "c00", "c01"]
