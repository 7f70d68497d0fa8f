"""Groups of records linked directly or indirectly: hierarchical union-find over edge partitions.

Every partition of edges runs union-find and keeps only the edges that joined two sets, its spanning
forest. Forests are merged a few partitions at a time until one partition is left. A merge task never
gets more than ``bound`` edges: while the forests together are larger than that, a round of
contraction comes first, in which every vertex with a tails coin joins its smallest neighbour with a
heads coin, so that the number of vertices falls by a constant share a round and nothing grows into
one task. The contractions are undone by joins at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.runtime import drop, materialize, shuffle_partitions

FOREST = "a string, b string"
LABELS = "id string, label string"


class UnionFind:
    """Union-find over dense integers with path halving; the root is the smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


def _read(batches) -> tuple[list, np.ndarray, np.ndarray] | None:
    """All pairs of a partition as ranks in the sorted list of their ids."""
    held = [x for x in batches if x.num_rows]
    if not held:
        return None
    table = pa.Table.from_batches(held)
    a, b = table.column("a").combine_chunks(), table.column("b").combine_chunks()
    codes = pa.concat_arrays([a, b]).dictionary_encode()
    ids = codes.dictionary.to_pylist()
    order = sorted(range(len(ids)), key=ids.__getitem__)
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    at = rank[codes.indices.to_numpy()]
    return [ids[i] for i in order], at[: len(a)], at[len(a) :]


def _forest(batches):
    read = _read(batches)
    if read is None:
        return
    ids, a, b = read
    sets = UnionFind(len(ids))
    kept = [(x, y) for x, y in zip(a.tolist(), b.tolist()) if sets.union(x, y)]
    yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in kept], pa.string()), pa.array([ids[y] for _, y in kept], pa.string())], names=["a", "b"])


def _labels(batches):
    read = _read(batches)
    if read is None:
        return
    ids, a, b = read
    sets = UnionFind(len(ids))
    for x, y in zip(a.tolist(), b.tolist()):
        sets.union(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([ids[sets.find(i)] for i in range(len(ids))], pa.string())], names=["id", "label"])


def _contract(forest: DataFrame, turn: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(moves (id, label), remaining edges between labels).

    Vertices of more than ``limit`` edges always show heads, so they stay and no join has them as a key that
    moves: at most 2 * edges / limit of them, a few a task, are looked up in every task.
    """
    ends = forest.select(F.explode(F.array("a", "b")).alias("id"))
    hubs = materialize(ends.groupBy("id").count().where(F.col("count") > limit).select("id"), "hubs")
    coin = lambda c: (F.xxhash64(F.col(c), F.lit(turn)) % 2) == 0
    flagged = forest
    for c in ("a", "b"):
        flagged = flagged.join(F.broadcast(hubs.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_hub"))), c, "left").withColumn(f"{c}_heads", F.coalesce(f"{c}_hub", coin(c))).drop(f"{c}_hub")
    both = flagged.select(F.col("a").alias("id"), F.col("b").alias("to"), "a_heads", "b_heads").unionByName(flagged.select(F.col("b").alias("id"), F.col("a").alias("to"), F.col("b_heads").alias("a_heads"), F.col("a_heads").alias("b_heads")))
    moves = materialize(both.where(~F.col("a_heads") & F.col("b_heads")).groupBy("id").agg(F.min("to").alias("label")), "moves")
    for c in ("a", "b"):
        to = moves.select(F.col("id").alias(c), F.col("label").alias("to"))
        tails = flagged.where(~F.col(f"{c}_heads")).join(to, c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        flagged = flagged.where(f"{c}_heads").unionByName(tails)
    return moves, flagged.select("a", "b").where("a <> b")


def _spread(edges: DataFrame, tasks: int) -> DataFrame:
    """Dealt out in turn: a forest needs no edge beside another, so no key decides where one goes."""
    return edges.repartition(tasks)


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b", fan_in: int = 8, bound: int = 2_000_000) -> DataFrame:
    """(id, label) for every id in a pair; label is the smallest id of all ids it is linked with.

    Pairs with a null end are no links. A pair of an id with itself gives the id a group of its own
    unless other pairs link it. Repeated and reversed pairs change nothing; an empty table gives no
    rows; other columns aren't read. ``bound`` is the number of edges a merge task may be given.
    """
    spark = pairs.sparkSession
    clean = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a is not null and b is not null")
    loops = materialize(clean.select("a", "b", (F.col("a") == F.col("b")).alias("self")).mapInArrow(_split_forest, "a string, b string, self boolean"), "forest")
    forest = loops.where("not self").select("a", "b")
    alone = loops.where("self").select("a").distinct()
    parts = max(1, forest.rdd.getNumPartitions())
    size = forest.count()
    moved: list[DataFrame] = []
    turn = 0
    while parts > 1 and size:
        following = max(1, -(-parts // fan_in))
        if size > bound * following:
            # Too much for so few tasks: contract, and let as many tasks as before reduce what is left.
            turn += 1
            moves, rest = _contract(forest, turn, max(1, bound // 8))
            moved.append(moves)
            following = max(-(-size // bound), shuffle_partitions(spark))
            merged = _spread(rest, following)
        else:
            merged = forest.repartition(following) if parts > following else forest
        merged = materialize(merged.mapInArrow(_forest, FOREST), "forest")
        drop(forest)
        forest, parts, size = merged, following, merged.count()
    labels = forest.repartition(1).mapInArrow(_labels, LABELS) if size else spark.createDataFrame([], LABELS)
    if moved:
        labels = materialize(labels, "labels")
    # Vertices that were contracted away take the label of what they were joined with, the last round first.
    for moves in reversed(moved):
        via = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        mine = moves.join(via, "label", "left").select("id", F.coalesce("far", "label").alias("label"))
        met = moves.select(F.col("label").alias("id")).distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("label"))
        further = materialize(labels.unionByName(mine).unionByName(met), "labels")
        drop(labels, moves)
        labels = further
    if moved:
        # The kept names were drawn by coin; the smallest id of the group takes their place.
        lowest = labels.groupBy("label").agg(F.min("id").alias("low"))
        labels = labels.join(lowest, "label").select("id", F.col("low").alias("label"))
    single = alone.join(labels.select(F.col("id").alias("a")), "a", "left_anti").select(F.col("a").alias("id"), F.col("a").alias("label"))
    return labels.unionByName(single)


def _split_forest(batches):
    """Spanning forest of a partition; pairs of an id with itself are passed on, once a batch."""
    held, own = [], []
    for x in batches:
        if not x.num_rows:
            continue
        flag = x.column(2)
        own.append(x.filter(flag).column(0).unique())
        held.append(x.filter(pa.compute.invert(flag)).select(["a", "b"]))
    for ids in own:
        if len(ids):
            yield pa.RecordBatch.from_arrays([ids, ids, pa.array([True] * len(ids))], names=["a", "b", "self"])
    for out in _forest(iter(held)):
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array([False] * out.num_rows, pa.bool_())], names=["a", "b", "self"])


