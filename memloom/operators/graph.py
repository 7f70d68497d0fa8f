"""Graph operators over edge tables: adjacency, breadth-first levels, paths, explanations.

Edges are rows (source, target, relation, weight, expired, seq, ...); expired ones aren't followed
unless asked for. Searches run level by level on the driver's loop, every level a distributed join of
the frontier with the edges and an anti join with what was visited before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.skew import stitched_rank
from memloom.runtime import drop, materialize

EDGE_VERBS = {  # fixed values: how a relation is read in an explanation
    "is_part_of": "is part of", "belongs_to": "belongs to", "causes": "causes", "happened_after": "happened after",
    "located_at": "is located at", "is_a": "is a", "similar_to": "is similar to", "contradicts": "contradicts",
}


def usable_edges(edges: DataFrame, relations: list[str] | None = None, active_only: bool = True, min_weight: float | None = None) -> DataFrame:
    e = edges
    if active_only:
        e = e.where(~F.coalesce("expired", F.lit(False)))
    if relations:
        e = e.where(F.col("relation").isin(*relations))
    if min_weight is not None:
        e = e.where(F.col("weight") >= min_weight)
    return e


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (from, to, ...) in the direction of travel; both ways gives every edge twice."""
    ahead = edges.withColumns({"from": F.col("source"), "to": F.col("target")})
    back = edges.withColumns({"from": F.col("target"), "to": F.col("source")})
    if direction == "forward":
        return ahead
    if direction == "backward":
        return back
    if direction == "both":
        return ahead.unionByName(back)
    raise ValueError(f"direction {direction!r}")


def edges_of(edges: DataFrame, node_id: str, direction: str = "both") -> DataFrame:
    """Edges of a node; a loop on itself comes twice under ``both``."""
    return oriented(edges, direction).where(F.col("from") == node_id).drop("from", "to")


def neighbors(edges: DataFrame, nodes: DataFrame, node_id: str, direction: str = "forward") -> DataFrame:
    """(id, relation, weight) of adjacent nodes that are there; parallel edges come as often as they are."""
    near = oriented(edges, direction).where(F.col("from") == node_id).select(F.col("to").alias("id"), "relation", "weight")
    return near.join(nodes.select("id"), "id", "left_semi")


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node, or no row."""
    return nodes.where(F.col("id") == node_id).limit(1)


def exist(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, found) for every id asked for."""
    there = nodes.select("id", F.lit(True).alias("_there")).distinct()
    return ids.select("id").join(there, "id", "left").select("id", F.coalesce("_there", F.lit(False)).alias("found"))


def edge_by_key(edges: DataFrame, source: str, target: str, relation: str) -> DataFrame:
    """The edge of a triple, or no row."""
    return edges.where((F.col("source") == source) & (F.col("target") == target) & (F.col("relation") == relation)).limit(1)


def edge_between(edges: DataFrame) -> DataFrame:
    """The first edge (least seq) of every (source, target)."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    return edges.groupBy("source", "target").agg(F.min_by(F.struct(*rest), "seq").alias("e")).select("source", "target", *(F.col("e")[c].alias(c) for c in rest))


def bfs(edges: DataFrame, nodes: DataFrame, starts: list[str] | DataFrame, direction: str = "forward", max_depth: int = 3, max_nodes: int | None = 100, relations: list[str] | None = None, active_only: bool = True, include_start: bool = False) -> DataFrame:
    """(id, depth, place): nodes by the level they are first reached on, in discovery order.

    ``max_nodes`` is soft: a parent is no longer expanded once so many rows have been given out, but the
    children of a parent come whole. Only nodes in ``nodes`` are reached. Starts that aren't there give
    nothing. Levels are read and written as tables; the order within a level is that of the parent,
    then of the edge's seq. Without a cap the order isn't needed: place is null and no level is sorted.
    """
    spark = edges.sparkSession
    start = starts.select("id") if isinstance(starts, DataFrame) else spark.createDataFrame([(s,) for s in starts], "id string")
    start = start.distinct().join(nodes.select("id"), "id", "left_semi")
    walk = oriented(usable_edges(edges, relations, active_only), direction).select("from", "to", "seq").where(F.col("from") != F.col("to"))
    walk = walk.join(nodes.select(F.col("id").alias("to")), "to", "left_semi")
    if max_nodes is None:
        walk = walk.select("from", "to").distinct()
    walk = materialize(walk, "walk")  # read again at every level: two or three narrow columns of the edges that count
    zero = F.lit(0).cast("long")
    level = start.select("id", F.lit(0).alias("depth"), zero.alias("place"))
    level = materialize(level if max_nodes is None else _placed(level.drop("place"), ["id"], 0), "bfs")
    levels, given = [level], 0
    for depth in range(1, max_depth + 1):
        seen = levels[0].select("id")
        for x in levels[1:]:
            seen = seen.unionByName(x.select("id"))
        steps = levels[-1].select(F.col("id").alias("from"), F.col("place").alias("parent")).join(walk, "from").join(seen.withColumnRenamed("id", "to"), "to", "left_anti")
        if max_nodes is None:
            level = materialize(steps.select(F.col("to").alias("id")).distinct().select("id", F.lit(depth).alias("depth"), zero.alias("place")), "bfs")
            if not level.limit(1).count():
                break
            levels.append(level)
            continue
        # The first parent in order, and its first edge, is what a node is reached by.
        first = steps.groupBy(F.col("to").alias("id")).agg(F.min(F.struct("parent", "seq")).alias("by")).select("id", "by.*")
        first = materialize(first, "bfs-new")
        counts = first.groupBy("parent").agg(F.count("*").alias("n"))  # bounded: parents are expanded only below the cap
        before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("parent").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + given)
        kept = first.join(before.where(F.col("before") < max_nodes).select("parent"), "parent", "left_semi").select("id", F.lit(depth).alias("depth"), "parent", "seq")
        level = materialize(_placed(kept, ["parent", "seq", "id"], given), "bfs")
        n = level.count()
        if not n:
            break
        levels.append(level)
        given += n
        if given >= max_nodes:
            break
    drop(walk)
    out = levels[0] if include_start else levels[0].where(F.lit(False))
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("id", "depth", F.when(F.lit(max_nodes is not None), F.col("place")).alias("place"))


def _placed(rows: DataFrame, order: list[str], given: int, small: int = 50_000) -> DataFrame:
    """(id, depth, place) with consecutive places: in one task while there are few rows, else by stitched ranges."""
    if rows.limit(small + 1).count() <= small:
        numbered = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        numbered = stitched_rank(rows.withColumn("all", F.lit(0)), ["all"], order, rank="place")
    return numbered.select("id", "depth", (F.col("place") + given).alias("place"))


def dfs(edges: DataFrame, nodes: DataFrame, start: str, direction: str = "forward", max_depth: int = 3, max_nodes: int = 100, relations: list[str] | None = None) -> DataFrame:
    """(id, depth, place) in depth-first order: a node counts when it is pushed, children in order of seq, then id.

    At most ``max_nodes`` rows. The search needs no more than the first 2 * max_nodes + 1 children of a node (fewer
    were seen before), so the driver asks for those of all nodes on its stack at once, whenever it comes to one
    it doesn't know: what it holds goes with the cap, not with the graph. A missing start gives no rows.
    """
    spark = edges.sparkSession
    ids = nodes.select("id")
    walk = oriented(usable_edges(edges, relations), direction).select("from", "to", "seq").where(F.col("from") != F.col("to"))
    walk = materialize(walk.join(ids.withColumnRenamed("id", "to"), "to", "left_semi").groupBy("from", "to").agg(F.min("seq").alias("seq")), "walk")
    by_seq = Window.partitionBy("from").orderBy("seq", "to")
    known: dict[str, list[str]] = {}

    def ask(wanted: list[str]) -> None:
        near = walk.join(spark.createDataFrame([(w,) for w in wanted], "`from` string"), "from", "left_semi").withColumn("r", F.row_number().over(by_seq)).where(F.col("r") <= 2 * max_nodes + 1)
        known.update({w: [] for w in wanted})
        for row in sorted(near.collect(), key=lambda x: x.r):
            known[row["from"]].append(row.to)

    seen, out = {start}, []
    stack = [(start, 0)] if ids.where(F.col("id") == start).limit(1).count() else []
    while stack and len(out) < max_nodes:
        node, depth = stack.pop()
        if depth >= max_depth:
            continue
        if node not in known:
            ask([node] + [n for n, d in stack if d < max_depth and n not in known])
        fresh = []
        for t in known[node]:
            if t not in seen and len(out) < max_nodes:
                seen.add(t)
                fresh.append((t, depth + 1))
                out.append((t, depth + 1, len(out) + 1))
        stack.extend(reversed(fresh))
    drop(walk)
    return spark.createDataFrame(out, "id string, depth int, place long")


def shortest_path(edges: DataFrame, nodes: DataFrame, start: str, end: str, max_hops: int = 5, direction: str = "forward") -> DataFrame:
    """(path, hops): one row, or none if there is no path within max_hops; ties go to the smallest path.

    A node keeps one path a level, so levels are no larger than the nodes."""
    spark = edges.sparkSession
    ids = nodes.select("id")
    here = spark.createDataFrame([(start, [start])], "id string, path array<string>").join(ids, "id", "left_semi")
    walk = oriented(usable_edges(edges), direction).select("from", "to").where(F.col("from") != F.col("to")).distinct()
    walk = materialize(walk.join(ids.withColumnRenamed("id", "to"), "to", "left_semi"), "walk")
    level = materialize(here, "path")
    if start == end:
        return level.select("path", F.lit(0).alias("hops"))
    seen = level.select("id")
    for hops in range(1, max_hops + 1):
        steps = level.withColumnRenamed("id", "from").join(walk, "from").join(seen.withColumnRenamed("id", "to"), "to", "left_anti")
        level = materialize(steps.groupBy(F.col("to").alias("id")).agg(F.min(F.array_append("path", F.col("to"))).alias("path")), "path")
        hit = level.where(F.col("id") == end)
        if hit.limit(1).count():
            return hit.select("path", F.lit(hops).alias("hops"))
        if not level.limit(1).count():
            break
        seen = seen.unionByName(level.select("id"))
    return spark.createDataFrame([], "path array<string>, hops int")


def all_paths(edges: DataFrame, nodes: DataFrame, start: str, end: str, max_nodes: int = 4, direction: str = "forward") -> DataFrame:
    """(path): every simple path of at most max_nodes nodes; parallel edges give a path once each.

    Walks are pruned to nodes that can still reach the end in the hops left. There are as many rows as paths,
    which through a hub grow with its edges for every hop: max_nodes is what bounds them."""
    spark = edges.sparkSession
    walk = oriented(usable_edges(edges), direction).select("from", "to").where(F.col("from") != F.col("to"))
    walk = materialize(walk.join(nodes.select(F.col("id").alias("to")), "to", "left_semi"), "walk")
    back = {"forward": "backward", "backward": "forward", "both": "both"}[direction]
    left = materialize(bfs(edges, nodes, [end], back, max_nodes - 1, None, include_start=True).select("id", F.col("depth").alias("left")), "left")
    level = materialize(spark.createDataFrame([([start],)], "path array<string>").join(nodes.where(F.col("id") == start).select("id").limit(1), F.lit(True), "left_semi"), "paths")
    found = [level.where(F.lit(start == end))]
    for used in range(1, max_nodes):
        step = level.where(F.element_at("path", -1) != end).withColumn("from", F.element_at("path", -1)).join(walk, "from").join(left.where(F.col("left") <= max_nodes - used - 1).withColumnRenamed("id", "to"), "to")
        level = materialize(step.where(~F.array_contains("path", F.col("to"))).select(F.array_append("path", F.col("to")).alias("path")), "paths")
        found.append(level.where(F.element_at("path", -1) == end))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """``path`` rows with ``steps``: the first edge of each consecutive pair, in order."""
    pairs = paths.select("path", F.posexplode(F.when(F.size("path") > 1, F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("source"), F.element_at("path", i + 1).alias("target"))))).alias("at", "pair"))
    flat = pairs.select("path", "at", "pair.source", "pair.target").join(edge_between(edges), ["source", "target"])
    steps = flat.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", "source", "target", "relation", "weight"))).alias("steps"))
    return paths.join(steps, "path", "left").withColumn("steps", F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)))


def confidence(steps: Column) -> Column:
    """Product of the weights; 1 for no edges."""
    return F.aggregate(steps, F.lit(1.0), lambda a, s: a * s["weight"].cast("double"))


def weakest(steps: Column) -> Column:
    return F.coalesce(F.array_min(F.transform(steps, lambda s: s["weight"].cast("double"))), F.lit(1.0))


def path_type(steps: Column) -> Column:
    every = lambda *names: F.forall(steps, lambda s: s["relation"].isin(*names))
    return F.when(F.size(steps) == 0, F.lit("associative")).when(every("causes"), F.lit("causal")).when(every("is_part_of", "is_a"), F.lit("hierarchical")).when(every("happened_after"), F.lit("temporal")).otherwise(F.lit("hybrid"))


_KINDS = {"causal": ["causes"], "hierarchical": ["is_part_of", "is_a"], "temporal": ["happened_after"]}  # every edge is one of these


def two_step_summary(edges: DataFrame) -> DataFrame:
    """``path_type, n, avg_confidence, avg_weakest`` over all pairs of edges (source, target, relation, weight) that meet.

    A middle node has in-edges x out-edges paths; none is listed. Their number and the sum of products are products
    of sums. The sum of the smaller weights comes from one walk over the edges of a node, heaviest first: each
    is the smaller one with every edge of the other side before it. That walk is stitched over range
    partitions, so a hub is cut. What no other type has is hybrid.
    """
    kind = F.coalesce(*(F.when(F.col("relation").isin(*names), F.lit(k)) for k, names in _KINDS.items()))
    ends = edges.select(F.explode(F.array(F.struct(F.col("target").alias("mid"), F.lit(1).alias("into")), F.struct(F.col("source").alias("mid"), F.lit(0).alias("into")))).alias("x"), "weight", F.explode(F.array_compact(F.array(F.lit("all"), kind))).alias("kind"))
    rows = ends.select("x.mid", "kind", "x.into", F.col("weight").cast("double").alias("weight")).withColumns({"_down": -F.col("weight"), "_side": 1 - F.col("into")})
    walked = stitched_rank(rows, ["mid", "kind"], ["_down", "_side"], size="into", rank="place", running="ins")
    weakest_sum = F.when(F.col("into") == 1, F.col("weight") * (F.col("place") - F.col("ins"))).otherwise(F.col("weight") * F.col("ins"))
    into, out = F.col("into") == 1, F.col("into") == 0
    by_node = walked.groupBy("mid", "kind").agg(F.count_if(into).alias("a"), F.count_if(out).alias("b"), F.sum(F.when(into, F.col("weight")).otherwise(0.0)).alias("wa"), F.sum(F.when(out, F.col("weight")).otherwise(0.0)).alias("wb"), F.sum(weakest_sum).alias("w"))
    sums = by_node.groupBy("kind").agg(F.sum(F.col("a") * F.col("b")).alias("n"), F.sum(F.col("wa") * F.col("wb")).alias("c"), F.sum("w").alias("w"))
    rest = sums.agg(*(F.sum(F.when(F.col("kind") == "all", F.col(x)).otherwise(-F.col(x))).alias(x) for x in ("n", "c", "w"))).select(F.lit("hybrid").alias("kind"), "n", "c", "w")
    every = sums.where("kind <> 'all'").unionByName(rest).where("n > 0")
    return every.select(F.col("kind").alias("path_type"), "n", (F.col("c") / F.col("n")).alias("avg_confidence"), (F.col("w") / F.col("n")).alias("avg_weakest"))


def verb(relation: Column) -> Column:
    out = F.regexp_replace(relation, "_", " ")
    for k, v in EDGE_VERBS.items():
        out = F.when(relation == k, F.lit(v)).otherwise(out)
    return out


def explain_paths(paths: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``path, confidence, weakest, path_type, explanation``; labels are contents cut to 20 characters."""
    label = F.when(F.length("content") > 20, F.concat(F.substring("content", 1, 17), F.lit("..."))).otherwise(F.col("content"))
    named = paths.select("path", F.posexplode("path").alias("at", "id")).join(nodes.select("id", label.alias("label")), "id")
    names = named.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("labels"))
    full = path_edges(paths, edges).join(names, "path")
    parts = F.transform("steps", lambda s: F.concat_ws(" ", F.element_at("labels", (s["at"] + 1).cast("int")), verb(s["relation"]), F.element_at("labels", (s["at"] + 2).cast("int"))))
    text = F.when(F.size("steps") == 0, F.concat(F.lit("Single node: "), F.element_at("labels", 1))).otherwise(F.array_join(parts, ", which "))
    return full.select("path", confidence(F.col("steps")).alias("confidence"), weakest(F.col("steps")).alias("weakest"), path_type(F.col("steps")).alias("path_type"), text.alias("explanation"))


def explain_relationship(edges: DataFrame, nodes: DataFrame, start: str, end: str, max_hops: int = 5) -> DataFrame:
    return explain_paths(shortest_path(edges, nodes, start, end, max_hops).select("path"), edges, nodes)


def traverse(edges: DataFrame, nodes: DataFrame, start: str, direction: str = "forward", max_depth: int = 3, max_nodes: int = 100, relations: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with depth, edges whose source is a result node, one row of totals)."""
    found = materialize(bfs(edges, nodes, [start], direction, max_depth, max_nodes, relations), "traverse")
    rows = nodes.join(found, "id")
    near = usable_edges(edges, relations).join(found.select(F.col("id").alias("source")), "source", "left_semi")
    totals = found.agg(F.count("*").alias("nodes"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth")).withColumn("truncated", F.col("nodes") >= max_nodes)
    return rows, near, totals


def subgraph(edges: DataFrame, nodes: DataFrame, seeds: list[str], radius: int = 1, cap: int = 100) -> tuple[DataFrame, DataFrame]:
    """(node ids around the seeds, edges of the seeds in both directions). ``seeds`` is a list the caller holds."""
    spark = edges.sparkSession
    seed = spark.createDataFrame([(s,) for s in seeds], "id string").distinct()
    around = bfs(edges, nodes, seed, "forward", radius, cap, include_start=True).select("id").distinct()
    touching = edges.join(seed.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(edges.join(seed.withColumnRenamed("id", "target"), "target", "left_semi")).distinct()
    return around, touching
