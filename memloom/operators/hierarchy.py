"""Parent-child rows of unknown depth to full hierarchies, by heavy-path decomposition.

1. Ids become numbers. Subtree sizes by pointer doubling: after round k a node knows how many descendants it has
   within 2**k steps. Only nodes whose pointer hasn't run out stay in the loop; what they add to others is
   summed once at the end. Nodes whose pointer never runs out are on a loop or below one.
2. The child with the largest subtree is heavy; heavy links make chains. Doubling over heavy links gives each
   node its chain, named by the number of its head, and its place in it.
3. Chains are placed level by level under the chain their head hangs from. A walk to the root crosses at most
   log2(n) chains, so this takes few rounds, however deep the tree is. A chain has its root, the depth and
   preorder number of its head, and the segments of chains above it.

Every round leaves fewer nodes. Once no more than ``small`` are left, which are a few numbers each, one task does
the remaining rounds; the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.skew import stitched_rank
from memloom.runtime import drop, materialize

SEGMENTS = "array<struct<chain:bigint,upto:bigint>>"
SMALL = 400_000  # rows one task may be given


def normal_id(column) -> F.Column:
    """Ids are compared trimmed and lower-cased; an empty id is none."""
    c = F.lower(F.trim(column))
    return F.when(c != "", c)


def parent_links(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """One row an id with its non-empty parent, null if it has none. Rows without an id are left out;
    should rows of an id disagree, the smallest parent counts."""
    return (
        df.select(normal_id(F.col(id_col)).alias("id"), normal_id(F.col(parent_col)).alias("parent"))
        .where("id is not null")
        .groupBy("id")
        .agg(F.min("parent").alias("parent"))
    )


def _columns(batches) -> list[pa.ChunkedArray] | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).columns if held else None


def _places(of: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where the values stand in the sorted array ``among``, -1 if they don't."""
    at = np.minimum(np.searchsorted(among, of), len(among) - 1)
    return np.where(among[at] == of, at, -1)


def _finish_sizes(batches):
    """(nid, gain, looped) from all open rows (nid, ptr, size): the doubling to its end."""
    columns = _columns(batches)
    if columns is None:
        return
    nid, ptr, size = (c.to_numpy() for c in columns)
    ids = np.unique(np.concatenate([nid, ptr]))
    to = np.full(len(ids), -1)
    own, gained = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    at = np.searchsorted(ids, nid)
    to[at], own[at] = np.searchsorted(ids, ptr), size
    before = -1
    while (left := np.flatnonzero(to >= 0)).size and left.size != before:
        before = left.size
        gain = np.zeros(len(ids), np.int64)
        np.add.at(gain, to[left], own[left])
        gained += gain
        own += gain
        following = np.full(len(ids), -1)
        following[left] = to[to[left]]
        to = following
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(gained), pa.array(to >= 0)], names=["nid", "gain", "looped"])


def _sizes(base: DataFrame, small: int) -> tuple[DataFrame, bool]:
    """((nid, parent, size, looped), are there loops) of base (nid, ptr: number of the parent or null)."""
    state = base.where("ptr is not null").select("nid", "ptr", F.lit(1).cast("long").alias("size"))
    n = state.count()
    gains: list[DataFrame] = []
    stuck = False
    while n > small and not stuck:
        # Partial sums before the shuffle, so a node with very many children is one row a task.
        gain = materialize(state.groupBy(F.col("ptr").alias("nid")).agg(F.sum("size").alias("gain")), "gain")
        gains.append(gain)
        up = state.select(F.col("nid").alias("ptr"), F.col("ptr").alias("next"))
        onward = state.join(up, "ptr").select("nid", F.col("next").alias("ptr"), "size")
        following = materialize(onward.join(gain, "nid", "left").select("nid", "ptr", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")), "open")
        now = following.count()
        stuck = now == n  # only loops and what hangs from them never get shorter
        drop(state)
        state, n = following, now
    own = base.select("nid", F.col("ptr").alias("parent"), F.lit(1).cast("long").alias("size"), F.lit(False).alias("looped"))
    none = F.lit(None).cast("long").alias("parent")
    parts = [own, *(g.select("nid", none, F.col("gain").alias("size"), F.lit(False).alias("looped")) for g in gains)]
    if stuck:
        parts.append(state.select("nid", none, F.lit(0).cast("long").alias("size"), F.lit(True).alias("looped")))
    elif n:
        parts.append(state.repartition(1).mapInArrow(_finish_sizes, "nid long, gain long, looped boolean").select("nid", none, F.col("gain").alias("size"), "looped"))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    sized = materialize(every.groupBy("nid").agg(F.max("parent").alias("parent"), F.sum("size").alias("size"), F.max("looped").alias("looped")), "sizes")
    drop(state, *gains)
    return sized, bool(n and sized.where("looped").limit(1).count())


def _finish_loops(batches):
    """(id, loop) from all rows (id, parent) of nodes on loops and below."""
    columns = _columns(batches)
    if columns is None:
        return
    parent = dict(zip(*(c.to_pylist() for c in columns)))
    loop: dict[str, str] = {}
    for start in parent:
        walk, here = [], start
        seen: set[str] = set()
        while here not in loop and here not in seen:
            seen.add(here)
            walk.append(here)
            here = parent[here]
        name = loop[here] if here in loop else min(walk[walk.index(here) :])
        loop.update(dict.fromkeys(walk, name))
    yield pa.RecordBatch.from_arrays([pa.array(list(loop), pa.string()), pa.array(list(loop.values()), pa.string())], names=["id", "loop"])


def _loops(rest: DataFrame, small: int) -> DataFrame:
    """(id, loop): the smallest id on the loop that the chain of parents runs into, for rows (id, parent)."""
    rest = materialize(rest, "looped")
    if rest.count() <= small:
        return materialize(rest.repartition(1).mapInArrow(_finish_loops, "id string, loop string"), "loop")
    walk = rest.select("id", F.col("parent").alias("ptr"))
    image = -1
    while True:  # until the images of a further doubling are as many: then they are the members of the loops
        now = walk.select("ptr").distinct().count()
        if now == image:
            break
        image = now
        step = walk.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"))
        following = materialize(walk.join(step, "ptr").select("id", F.col("next").alias("ptr")), "loop")
        drop(walk)
        walk = following
    on_loop = walk.select(F.col("ptr").alias("id")).distinct()
    ring = materialize(on_loop.join(rest.select("id", F.col("parent").alias("ptr")), "id").select("id", "ptr", F.least("id", "ptr").alias("low")), "ring")
    while True:
        step = ring.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("low").alias("far"))
        following = materialize(ring.join(step, "ptr").select("id", F.col("next").alias("ptr"), F.least("low", "far").alias("low"), (F.col("far") < F.col("low")).alias("moved")), "ring")
        drop(ring)
        ring = following
        if not ring.where("moved").limit(1).count():
            break
    return materialize(walk.join(ring.select(F.col("id").alias("ptr"), F.col("low").alias("loop")), "ptr").select("id", "loop"), "loop")


def _finish_chains(batches):
    """(nid, end, acc) from all open rows (nid, ptr, pos): the first node up the chain that isn't open, and the places to it."""
    columns = _columns(batches)
    if columns is None:
        return
    nid, ptr, acc = (c.to_numpy() for c in columns)
    order = np.argsort(nid)
    nid, end, acc = nid[order], ptr[order], acc[order].copy()
    to = _places(end, nid)
    while (left := np.flatnonzero(to >= 0)).size:
        via = to[left]
        acc[left], end[left], to[left] = acc[left] + acc[via], end[via], to[via]
    yield pa.RecordBatch.from_arrays([pa.array(nid), pa.array(end), pa.array(acc)], names=["nid", "end", "acc"])


def _chains(tree: DataFrame, small: int) -> DataFrame:
    """(nid, parent, size, head, pos): the chain a node is in, named by its head, and its place in it."""
    heavy = tree.where("parent is not null").groupBy("parent").agg(F.min(F.struct((-F.col("size")).alias("s"), "nid")).alias("h")).select(F.col("h.nid").alias("nid"), F.lit(True).alias("heavy"))
    link = tree.join(heavy, "nid", "left")
    state = materialize(
        link.select("nid", "parent", "size", F.when(F.col("heavy"), F.col("parent")).alias("ptr"), F.when(F.col("heavy"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("pos"), F.when(F.col("heavy"), F.col("parent")).otherwise(F.col("nid")).alias("head")),
        "chains",
    )
    rounds = 0
    while (n := state.where("ptr is not null").count()) > small:
        step = state.select(F.col("nid").alias("ptr"), F.col("ptr").alias("next"), F.col("pos").alias("more"), F.col("head").alias("up"))
        moved = state.where("ptr is not null").join(step, "ptr").select("nid", "parent", "size", F.col("next").alias("ptr"), (F.col("pos") + F.col("more")).alias("pos"), F.col("up").alias("head"))
        following = materialize(state.where("ptr is null").unionByName(moved), "chains")
        drop(state)
        state, rounds = following, rounds + 1
    if not n:
        return state.drop("ptr")
    ends = state.where("ptr is not null").select("nid", "ptr", "pos").repartition(1).mapInArrow(_finish_chains, "nid long, end long, acc long")
    if rounds:
        closed = state.where("ptr is null").select(F.col("nid").alias("end"), F.col("head").alias("at"), F.col("pos").alias("before"))
        ends = ends.join(closed, "end").select("nid", F.col("at").alias("end"), (F.col("acc") + F.col("before")).alias("acc"))
    # Before any round a node that isn't open is the head of its chain.
    nodes = materialize(state.join(ends, "nid", "left").select("nid", "parent", "size", F.coalesce("end", "head").alias("head"), F.coalesce("acc", "pos").alias("pos")), "nodes")
    drop(state)
    return nodes


PLACED = f"head long, root string, base long, pre long, segments {SEGMENTS}"


def _finish_levels(batches):
    """All chains placed, from rows (head, up, up_pos, offset, root); root is the id of the heads of trees, else null."""
    columns = _columns(batches)
    if columns is None:
        return
    head, up, up_pos, offset = (c.fill_null(-1).to_numpy() for c in columns[:4])
    roots = columns[4].combine_chunks()
    order = np.argsort(head)
    hangs = order[_places(up, head[order])]
    hangs[up < 0] = -1
    base, pre, root = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64), np.arange(len(head))
    level, row = np.full(len(head), -1), np.zeros(len(head), np.int64)
    now, depth = np.flatnonzero(up < 0), 0
    chains = uptos = np.zeros((len(now), 0), np.int64)
    while len(now):
        level[now], row[now] = depth, np.arange(len(now))
        kind = pa.struct([("chain", pa.int64()), ("upto", pa.int64())])
        flat = pa.StructArray.from_arrays([pa.array(chains.ravel()), pa.array(uptos.ravel())], fields=list(kind))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(now) + 1, dtype=np.int32) * depth), flat)
        yield pa.RecordBatch.from_arrays([pa.array(head[now]), roots.take(pa.array(root[now])), pa.array(base[now]), pa.array(pre[now]), lists], names=["head", "root", "base", "pre", "segments"])
        following = np.flatnonzero((hangs >= 0) & (level < 0) & (level[hangs] == depth))
        via = hangs[following]
        base[following], pre[following], root[following] = base[via] + up_pos[following] + 1, pre[via] + up_pos[following] + offset[following], root[via]
        chains, uptos = np.column_stack([chains[row[via]], head[via]]), np.column_stack([uptos[row[via]], up_pos[following]])
        now, depth = following, depth + 1


def _levels(heads: DataFrame, roots: DataFrame, small: int) -> DataFrame:
    """(head, root, base, pre, segments) of every chain: heads (head, up, up_pos, offset), roots (head, root)."""
    none = [F.lit(None).cast("long").alias(c) for c in ("up", "up_pos", "offset")]
    every = heads.withColumn("root", F.lit(None).cast("string")).unionByName(roots.select("head", *none, "root"))
    if every.count() <= small:
        return materialize(every.repartition(1).mapInArrow(_finish_levels, PLACED), "placed")
    zero = F.lit(0).cast("long")
    levels = [materialize(roots.select("head", "root", zero.alias("base"), zero.alias("pre"), F.array().cast(SEGMENTS).alias("segments")), "level")]
    while True:
        up = levels[-1].select(F.col("head").alias("up"), "root", F.col("base").alias("b"), F.col("pre").alias("p"), F.col("segments").alias("s"))
        level = materialize(
            heads.join(up, "up").select(
                "head", "root", (F.col("b") + F.col("up_pos") + 1).alias("base"), (F.col("p") + F.col("up_pos") + F.col("offset")).alias("pre"),
                F.concat("s", F.array(F.struct(F.col("up").alias("chain"), F.col("up_pos").alias("upto")))).alias("segments"),
            ),
            "level",
        )
        if not level.limit(1).count():
            break
        levels.append(level)
    placed = levels[0]
    for level in levels[1:]:
        placed = placed.unionByName(level)
    return placed


def build_hierarchy(df: DataFrame, id_col: str = "span_id", parent_col: str = "parent_id", small: int = SMALL) -> DataFrame:
    """One row a node: ``node_id, parent_id, root_id, depth, in_loop, chain, pos, n_descendants, pre, segments``.

    A node whose parent is no node is a root (depth 0, parent kept). If the chain of parents runs into
    a loop, root_id is the smallest id on it, depth is -1 and the labels of trees are null.
    ``segments`` lists the chains (numbers) from the root to the node with the last place used in each;
    ``expand_paths`` writes them out. The descendants of a node are the nodes of its root whose
    ``pre`` is in (pre, pre + n_descendants]. An empty table gives no rows; null and empty ids are
    left out; repeated rows count once; other columns aren't read.
    """
    links = materialize(parent_links(df, id_col, parent_col).withColumn("nid", F.monotonically_increasing_id()), "links")
    base = materialize(links.join(links.select(F.col("id").alias("parent"), F.col("nid").alias("ptr")), "parent", "left").select("nid", "ptr"), "base")
    sized, loops = _sizes(base, small)
    nodes = _chains(sized.where("not looped").drop("looped"), small)

    # Light children of a node follow its heavy subtree in preorder; their offsets are running sums.
    light = nodes.where("head = nid and parent is not null").select("nid", "parent", "size")
    ranked = stitched_rank(light, ["parent"], ["nid"], size="size", running="through")
    above = nodes.select(F.col("nid").alias("parent"), F.col("head").alias("up"), F.col("pos").alias("up_pos"), F.col("size").alias("up_size"))
    light_sum = light.groupBy("parent").agg(F.sum("size").alias("light_size"))
    heads = materialize(
        # preorder distance from the parent: 1 + heavy subtree + earlier light siblings
        ranked.join(light_sum, "parent").join(above, "parent").select(F.col("nid").alias("head"), "up", "up_pos", (F.col("up_size") - F.col("light_size") + F.col("through") - F.col("size")).alias("offset")),
        "heads",
    )
    roots = nodes.where("head = nid and parent is null").select("nid").join(links.select("nid", "id"), "nid").select(F.col("nid").alias("head"), F.col("id").alias("root"))
    placed = _levels(heads, materialize(roots, "roots"), small)
    trees = nodes.drop("parent").join(placed, "head").select(
        "nid",
        F.col("root").alias("root_id"),
        (F.col("base") + F.col("pos")).cast("int").alias("depth"),
        F.lit(False).alias("in_loop"),
        F.col("head").alias("chain"),
        "pos",
        (F.col("size") - 1).alias("n_descendants"),
        (F.col("pre") + F.col("pos")).alias("pre"),
        F.concat("segments", F.array(F.struct(F.col("head").alias("chain"), F.col("pos").alias("upto")))).alias("segments"),
    )
    names = ["root_id", "depth", "in_loop", "chain", "pos", "n_descendants", "pre", "segments"]
    out = links.join(trees, "nid").select(F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), *names)
    if loops:
        none = {"chain": "bigint", "pos": "bigint", "n_descendants": "bigint", "pre": "bigint", "segments": SEGMENTS}
        rest = sized.where("looped").select("nid").join(links, "nid").select("id", "parent")
        looped = _loops(rest, small).join(links.select("id", "parent"), "id").select(F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), F.col("loop").alias("root_id"), F.lit(-1).alias("depth"), F.lit(True).alias("in_loop"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
        out = out.unionByName(looped)
    return out


def expand_paths(hierarchy: DataFrame) -> DataFrame:
    """(node_id, path): all ids from the root to the node, by concatenating slices of chains.

    The output is as long as the sum of all depths; ``segments`` is the short form of it. A chain is gathered in
    one row, which is no longer than the path of its lowest node, a row of the result.
    """
    members = hierarchy.where("chain is not null").groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id"))).alias("m")).select("chain", F.transform("m", lambda x: x.node_id).alias("members"))
    parts = hierarchy.where("chain is not null").select("node_id", F.posexplode("segments").alias("at", "seg")).select("node_id", "at", F.col("seg.chain").alias("chain"), (F.col("seg.upto") + 1).cast("int").alias("n"))
    sliced = parts.join(members, "chain").select("node_id", F.struct("at", F.slice("members", F.lit(1), F.col("n")).alias("ids")).alias("part"))
    return sliced.groupBy("node_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda x: x.ids)).alias("path"))


def descendants(hierarchy: DataFrame, of: DataFrame) -> DataFrame:
    """(node_id, descendant_id) for the ids in ``of`` (one column node_id), from the segments of every node.

    A chain lists its asked nodes by place, and for each place how many of them are at or above it; a
    segment takes that many. So the work goes with the rows that come out, not with the size of a tree.
    """
    nodes = hierarchy.where("chain is not null").select("node_id", "chain", "pos", "segments")
    above = Window.partitionBy("chain").orderBy("pos")
    placed = nodes.join(of.select("node_id").distinct().withColumn("asked", F.lit(1)), "node_id", "left").select("chain", "pos", F.when(F.col("asked") == 1, F.col("node_id")).alias("asked"))
    listed = placed.withColumn("n", F.count("asked").over(above).cast("int")).groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "asked"))).alias("m"))
    chains = listed.select("chain", F.array_compact(F.transform("m", lambda x: x.asked)).alias("asked"), F.transform("m", lambda x: x.n).alias("upto_n")).where(F.size("asked") > 0)
    parts = nodes.select(F.col("node_id").alias("descendant_id"), F.explode("segments").alias("seg")).select("descendant_id", F.col("seg.chain").alias("chain"), F.col("seg.upto").alias("upto"))
    taken = parts.join(chains, "chain").select("descendant_id", F.slice("asked", F.lit(1), F.get("upto_n", F.col("upto").cast("int"))).alias("ids"))
    return taken.select(F.explode("ids").alias("node_id"), "descendant_id").where("node_id <> descendant_id")
