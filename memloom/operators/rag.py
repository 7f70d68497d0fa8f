"""Retrieval over vectors and graph: scores, expansion, selection, compression, context formats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import contains_ci, preview, token_estimate, two_places
from memloom.functions.vector import with_cosine
from memloom.operators.graph import bfs, oriented, usable_edges
from memloom.operators.skew import stitched_rank
from memloom.runtime import drop, materialize


@dataclass(frozen=True)
class Weights:
    """Documented defaults of the scorer."""

    vector: float = 0.6
    graph: float = 0.4
    decay: float = 0.5


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 10
    max_vector_results: int = 10
    max_graph_results: int = 20
    max_hops: int = 2
    min_relevance: float = 0.5
    direct_threshold: float = 0.5
    max_seeds: int = 5
    deduplicate: bool = True
    max_context_tokens: int = 4096
    mode: str = "hybrid"
    weights: Weights = Weights()


def combine(vector: Column, graph: Column, hops: Column, w: Weights = Weights()) -> Column:
    """Weighted similarity, halved with every hop; a direct match has graph proximity 1 and no hops."""
    return (w.vector * vector + w.graph * graph) * F.pow(F.lit(2.0), -hops.cast("double"))


def score_traversal(vector: Column, hops: Column, w: Weights = Weights()) -> Column:
    s = w.vector * vector + w.graph * F.pow(F.lit(w.decay), hops.cast("double"))
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


def score_graph_only(hops: Column, w: Weights = Weights()) -> Column:
    return F.least(F.greatest(w.graph * F.pow(F.lit(w.decay), hops.cast("double")), F.lit(0.0)), F.lit(1.0))


def expansion_score(seed: Column, weight: Column, hop: Column) -> Column:
    return (0.7 * seed + 0.3 * weight) * F.pow(F.lit(0.9), hop.cast("double"))


def expansion_priority(seed: Column, weight: Column, hop: Column) -> Column:
    return seed * weight / (1 + hop)


def dedup_by_score(rows: DataFrame, key: str = "id", score: str = "score") -> DataFrame:
    """The best row of every key."""
    w = Window.partitionBy(key).orderBy(F.desc(score), "id")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def vector_retrieve(nodes: DataFrame, query: list[float], config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """``id, vector_similarity, hop_distance, is_direct_match, score`` of the most similar nodes."""
    scored = with_cosine(nodes.where(F.size("embedding") == len(query)).select("id", "embedding"), "embedding", query)
    hits = scored.where(F.col("cosine") >= config.min_relevance).select("id", F.col("cosine").alias("vector_similarity"), F.lit(0).alias("hop_distance"), F.lit(True).alias("is_direct_match"))
    return hits.withColumn("score", combine(F.col("vector_similarity"), F.lit(1.0), F.lit(0), config.weights)).orderBy(F.desc("score"), "id").limit(config.max_vector_results)


def retrieve_from_seeds(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | list[str], config: RetrievalConfig = RetrievalConfig(mode="graph")) -> DataFrame:
    """Nodes around the seeds, scored by their distance; unknown seeds give nothing."""
    near = bfs(edges, nodes.select("id"), seeds, "both", config.max_hops, None)
    scored = near.select("id", F.lit(0.0).alias("vector_similarity"), F.col("depth").alias("hop_distance"), F.lit(False).alias("is_direct_match"), score_graph_only(F.col("depth"), config.weights).alias("score"))
    return scored.where(F.col("score") >= config.min_relevance).orderBy(F.desc("score"), "id").limit(config.max_graph_results)


def hybrid_retrieve(nodes: DataFrame, edges: DataFrame, query: list[float], config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Direct matches, and what is around the best of them, in one ranking.

    Nodes that are similar enough for a direct match but not among the top_k aren't added again by the
    graph step."""
    scored = with_cosine(nodes.where(F.size("embedding") == len(query)).select("id", "embedding"), "embedding", query)
    similar = materialize(scored.where(F.col("cosine") > config.direct_threshold).select("id", F.col("cosine").alias("vector_similarity")), "similar")
    top = materialize(similar.orderBy(F.desc("vector_similarity"), "id").limit(config.top_k), "top")
    direct = top.select("id", "vector_similarity", F.lit(0).alias("hop_distance"), F.lit(True).alias("is_direct_match")).withColumn("score", combine(F.col("vector_similarity"), F.lit(1.0), F.lit(0), config.weights))
    seeds = top.orderBy(F.desc("vector_similarity"), "id").limit(min(config.top_k, config.max_seeds)).select("id")
    near = bfs(edges, nodes.select("id"), seeds, "both", config.max_hops, None).join(similar.select("id"), "id", "left_anti")
    around = near.select("id", F.lit(0.0).alias("vector_similarity"), F.col("depth").alias("hop_distance"), F.lit(False).alias("is_direct_match"), score_graph_only(F.col("depth"), config.weights).alias("score"))
    around = around.where(F.col("score") >= config.min_relevance).orderBy(F.desc("score"), "id").limit(config.max_graph_results)
    return direct.where(F.col("score") >= config.min_relevance).unionByName(around).orderBy(F.desc("score"), "id")


def retrieve_context(nodes: DataFrame, edges: DataFrame, query: list[float] | None = None, seeds: DataFrame | list[str] | None = None, config: RetrievalConfig = RetrievalConfig(), style: str = "default") -> tuple[DataFrame, DataFrame]:
    """(one row ``context``, ``sources`` id, preview, score): what is retrieved, each id once if ``deduplicate``
    is set, its contents within ``max_context_tokens``, put into the style asked for. ``nodes`` has id, content,
    node_type and embedding. Rows of one id differ in score only where the retrieval gives an id twice."""
    found = retrieve(nodes, edges, query, seeds, config)
    found = dedup_by_score(found) if config.deduplicate else found
    rows = found.join(nodes.select("id", "content", "node_type"), "id")
    fit = materialize(fit_context(rows.where("content is not null"), config.max_context_tokens), "context")
    return format_context(fit, style), sources(fit)


def search_text(nodes: DataFrame, text: str, k: int = 10, embed=None) -> DataFrame:
    """``id, score, rank`` and the columns of the nodes, best first: by similarity to the embedded text, or by
    access score among the nodes whose content has the text where there is no embedding (``embed`` is None, or
    gives None). The words are the same in both; only the second depends on their spelling."""
    from memloom.operators.vector_search import knn

    vector = embed(text) if embed is not None else None
    if vector is None:
        hits = nodes.where(F.coalesce(contains_ci(F.col("content"), text), F.lit(False))).select("id", F.col("access_score").alias("score"), F.col("access_score").alias("by"))
    else:
        hits = knn(nodes, vector, k).select("id", "score", F.col("cosine").alias("by"))
    best = hits.orderBy(F.desc_nulls_last("by"), "id").limit(k)
    placed = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("by"), "id"))).drop("by")  # k rows
    return placed.join(nodes.select("id", *(c for c in nodes.columns if c not in ("id", "score", "rank"))), "id")


def rerank(rows: DataFrame, w: Weights = Weights()) -> DataFrame:
    """Rows (id, vector_similarity, hop_distance) with ``final_score`` by the scorer for traversals, best first."""
    return rows.withColumn("final_score", score_traversal(F.col("vector_similarity"), F.col("hop_distance"), w)).orderBy(F.desc("final_score"), "id")


def retrieve(nodes: DataFrame, edges: DataFrame, query: list[float] | None = None, seeds: DataFrame | list[str] | None = None, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    if config.mode == "vector":
        return vector_retrieve(nodes, query, config)
    if config.mode == "graph":
        return retrieve_from_seeds(nodes, edges, seeds, config)
    if config.mode == "hybrid":
        return hybrid_retrieve(nodes, edges, query, config)
    raise ValueError(f"mode {config.mode!r}")


SMALL = 50_000  # rows that are ranked in one task; more are ranked over range partitions


def _running(rows: DataFrame, rank: str, size: Column | None = None, running: str = "running") -> DataFrame:
    """Adds the rank by score (ties by id) and, with ``size``, its running sum, over all rows."""
    work = rows.withColumn("_size", (size if size is not None else F.lit(0)).cast("long"))
    if work.limit(SMALL + 1).count() <= SMALL:
        w = Window.orderBy(F.desc("score"), "id")
        out = work.withColumn(rank, F.row_number().over(w).cast("long")).withColumn(running, F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        keyed = work.withColumn("_all", F.lit(0)).withColumn("_down", -F.col("score"))
        out = stitched_rank(keyed, ["_all"], ["_down", "id"], size="_size", rank=rank, running=running).drop("_all", "_down")
    return out.drop("_size") if size is not None else out.drop("_size", running)


def ranked(rows: DataFrame) -> DataFrame:
    """1-based rank by score, ties by id."""
    return _running(rows, "rank")


def fit_context(rows: DataFrame, max_tokens: int) -> DataFrame:
    """The rows up to the first that would pass the budget of estimated tokens."""
    return _running(rows, "_rank", token_estimate(F.col("content")), "context_tokens").drop("_rank").where(F.col("context_tokens") <= max_tokens)


def result_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if("is_direct_match").alias("direct"), F.count_if(~F.col("is_direct_match")).alias("graph"), F.coalesce(F.sum(token_estimate(F.col("content"))), F.lit(0)).alias("context_size"))


# Expansion

def expand(seeds: DataFrame, edges: DataFrame, max_hops: int = 2, min_weight: float = 0.3, max_expanded: int | None = 100, max_total: int | None = 200, strategy: str = "bfs", nodes: DataFrame | None = None, node_types: list[str] | None = None, relations: list[str] | None = None) -> DataFrame:
    """``id, hop, weight, score``: seeds (id, score) and their neighbours over edges of enough weight.

    A node keeps the best way it was reached on its first hop. No more than ``max_expanded`` nodes of a hop are
    expanded: ``weighted`` takes those of the highest priority, ``bfs`` goes by id; what isn't expanded stays in the
    result. No more than ``max_total`` rows come back, nearest hops first. With ``nodes`` and ``node_types`` only
    neighbours of these types count. None for a cap is no cap.
    """
    if strategy not in ("bfs", "weighted"):
        raise ValueError(f"strategy {strategy!r}")
    walk = oriented(usable_edges(edges, relations, True, min_weight), "both").select("from", "to", F.col("weight").cast("double").alias("weight"))
    if node_types is not None:
        walk = walk.join(nodes.where(F.col("node_type").isin(*node_types)).select(F.col("id").alias("to")), "to", "left_semi")
    walk = materialize(walk, "walk")
    level = materialize(seeds.select("id", F.lit(0).alias("hop"), F.lit(1.0).alias("weight"), F.col("score").cast("double").alias("score")).dropDuplicates(["id"]), "expand")
    out, seen = level, level.select("id")
    for hop in range(1, max_hops + 1):
        level = _next_hop(level, seen, walk, hop, max_expanded, strategy)
        if not level.limit(1).count():
            break
        out, seen = out.unionByName(level), seen.unionByName(level.select("id"))
    drop(walk)
    out = out.orderBy("hop", F.desc("score"), "id")
    return out if max_total is None else out.limit(max_total)


def _next_hop(level: DataFrame, seen: DataFrame, walk: DataFrame, hop: int, max_expanded: int | None, strategy: str) -> DataFrame:
    front = level
    if max_expanded is not None:
        order = [F.desc(expansion_priority(F.col("score"), F.col("weight"), F.col("hop"))), "id"] if strategy == "weighted" else ["id"]
        front = level.orderBy(*order).limit(max_expanded)
    steps = front.select(F.col("id").alias("from"), F.col("score").alias("seed_score")).join(walk, "from").join(seen.withColumnRenamed("id", "to"), "to", "left_anti")
    best = steps.groupBy(F.col("to").alias("id")).agg(F.max(F.struct("weight", "seed_score")).alias("b"))
    return materialize(best.select("id", F.lit(hop).alias("hop"), F.col("b.weight").alias("weight"), expansion_score(F.col("b.seed_score"), F.col("b.weight"), F.lit(hop)).alias("score")), "expand")


def expand_by_relation(seeds: DataFrame, edges: DataFrame, relations: list[str], min_weight: float = 0.0) -> DataFrame:
    """One hop over the relations named."""
    return expand(seeds, edges, 1, min_weight, None, None, "bfs", relations=relations)


def type_counts(expanded: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_type, n) of the nodes found."""
    return expanded.select("id").join(nodes.select("id", "node_type"), "id").groupBy("node_type").agg(F.count("*").alias("n"))


def expand_adaptive(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, threshold: float = 0.3, max_hops: int = 3, min_weight: float = 0.3, max_expanded: int | None = 100, max_total: int | None = 200) -> DataFrame:
    """Another hop, from the last one on, as long as the nodes found have fewer than 10 x threshold different types."""
    walk = materialize(oriented(usable_edges(edges, None, True, min_weight), "both").select("from", "to", F.col("weight").cast("double").alias("weight")), "walk")
    level = materialize(seeds.select("id", F.lit(0).alias("hop"), F.lit(1.0).alias("weight"), F.col("score").cast("double").alias("score")).dropDuplicates(["id"]), "expand")
    out, kinds = level, set()
    for hop in range(1, max_hops + 1):
        level = _next_hop(level, out.select("id"), walk, hop, max_expanded, "bfs")
        out = out.unionByName(level)
        # As many rows as there are types.
        kinds |= {r.node_type for r in type_counts(level if kinds else out, nodes).collect() if r.node_type is not None}
        if len(kinds) >= 10 * threshold:
            break
    drop(walk)
    out = out.orderBy("hop", F.desc("score"), "id")
    return out if max_total is None else out.limit(max_total)


def expansion_stats(expanded: DataFrame) -> DataFrame:
    return expanded.agg(F.count_if(F.col("hop") == 0).alias("seeds"), F.count("*").alias("nodes"), F.coalesce(F.max("hop"), F.lit(0)).alias("max_hop"), F.count_if(F.col("hop") > 0).alias("edges_used"))


def rerank_expanded(expanded: DataFrame, weights: DataFrame, default: float = 0.5) -> DataFrame:
    """Scores again with the weights given (id, weight), where missing the default."""
    w = weights.select("id", F.col("weight").alias("w"))
    return expanded.drop("weight").join(w, "id", "left").withColumn("weight", F.coalesce("w", F.lit(default))).drop("w").withColumn("rescored", expansion_score(F.col("score"), F.col("weight"), F.col("hop"))).orderBy(F.desc("rescored"), "id")


# Levels of summary and compression

LEVELS = {"document": ("entity", "concept"), "paragraph": ("entity", "concept", "fact"), "sentence": ("entity", "concept", "fact", "raw_chunk")}
_ORDER = ["document", "paragraph", "sentence"]


def select_level(total_tokens: int, max_tokens: int, complexity: float, default: str = "paragraph") -> str:
    """Too much: one level coarser; less than a quarter: one finer; else by the query's complexity."""
    at = _ORDER.index(default)
    if total_tokens > max_tokens:
        return _ORDER[max(0, at - 1)]
    if total_tokens < max_tokens / 4:
        return _ORDER[min(2, at + 1)]
    if complexity > 0.7 and default == "document":
        return "paragraph"
    if complexity < 0.3 and default == "sentence":
        return "paragraph"
    return default


def level_filter(nodes: DataFrame, level: str) -> DataFrame:
    return nodes.where(F.lower("node_type").isin(*LEVELS[level]))


def compress(rows: DataFrame, max_tokens: int, strategy: str = "top_only") -> DataFrame:
    """Rows (id, content, score), fewer of them if their estimated tokens are over the budget:
    deduplicate (first 50 characters), top_only and cluster_summary (better half), none, key_sentences (as they are)."""
    if strategy not in ("none", "key_sentences", "deduplicate", "top_only", "cluster_summary"):
        raise ValueError(f"compression {strategy!r}")
    sums = rows.agg(F.sum(token_estimate(F.col("content"))).alias("tokens"), F.count("*").alias("n")).first()
    if (sums.tokens or 0) <= max_tokens or strategy in ("none", "key_sentences"):
        return rows
    if strategy == "deduplicate":
        first = rows.groupBy(F.substring("content", 1, 50).alias("_start")).agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
        return rows.join(first.select(F.col("b.id").alias("id")), "id", "left_semi")
    return ranked(rows).where(F.col("rank") <= sums.n // 2).drop("rank")


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id) of the rows that a compression took out."""
    return before.select("id").join(after.select("id"), "id", "left_anti")


def select_context(nodes: DataFrame, max_tokens: int, complexity: float, default: str = "paragraph") -> tuple[str, DataFrame]:
    """(level, the nodes of that level), by the size of all contents."""
    total = nodes.agg(F.sum(token_estimate(F.col("content"))).alias("n")).first().n or 0
    level = select_level(total, max_tokens, complexity, default)
    return level, level_filter(nodes, level)


def children_of(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    return chunks.join(rows.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")


def parents_of(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    return chunks.join(rows.select("parent_id").distinct().withColumnRenamed("parent_id", "chunk_id"), "chunk_id", "left_semi")


# Context formats: rows (id, content, node_type, score, hop_distance) of a bounded result

def _joined(rows: DataFrame, line: Column, separator: str) -> DataFrame:
    lines = ranked(rows).select("rank", line.alias("line"))
    return lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), separator).alias("context"))


def format_context(rows: DataFrame, style: str = "default", header: str = "Context", relevance: bool = True, types: bool = True, distance: bool = True) -> DataFrame:
    """One row ``context``. Styles: default, flat, structured, markdown, json, compact."""
    number, score = F.col("rank").cast("string"), two_places(F.col("score"))
    some = rows.where(F.col("content").isNotNull() & (F.col("content") != ""))
    if style == "default":
        return _joined(rows, F.concat(F.lit("["), number, F.lit("] "), F.col("content"), F.lit(" (relevance: "), score, F.lit(")")), "\n\n")
    if style == "flat":
        return _joined(some, F.col("content"), "\n\n---\n\n")
    if style == "compact":
        return _joined(some, F.col("content"), " ")
    if style == "json":
        item = F.struct(F.col("id"), F.col("content"), F.col("node_type"), F.round("score", 6).alias("score"), F.col("hop_distance"))
        return ranked(rows).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"])).alias("context"))
    parts = {
        "structured": [(True, F.concat(F.lit("["), number, F.lit("]"))), (relevance, F.concat(F.lit("Relevance: "), score)), (types, F.concat(F.lit("Type: "), F.col("node_type"))), (distance, F.concat(F.lit("Distance: "), F.col("hop_distance").cast("string"))), (True, F.concat(F.lit("Content: "), F.col("content")))],
        "markdown": [(True, F.concat(F.lit("### "), number, F.lit(". "), preview(F.col("content"), 60))), (relevance, F.concat(F.lit("**Relevance:** "), score)), (types, F.concat(F.lit("**Type:** "), F.col("node_type"))), (True, F.col("content"))],
    }
    if style not in parts:
        raise ValueError(f"style {style!r}")
    line = F.concat_ws("\n" if style == "structured" else "\n\n", *(c for on, c in parts[style] if on))
    head = f"=== {header} ===" if style == "structured" else f"## {header}"
    body = _joined(rows, line, "\n\n")
    return body.select(F.when(F.col("context") == "", F.lit("No relevant context found.")).otherwise(F.concat(F.lit(head + "\n\n"), "context")).alias("context"))


def sources(rows: DataFrame) -> DataFrame:
    return rows.select("id", preview(F.col("content")).alias("preview"), "score")
