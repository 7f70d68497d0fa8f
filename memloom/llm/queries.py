"""Queries of the training-data problems with their SQL, where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import chunks, components, mixing, moderation, neardup, packing, tokens, vectors
from memloom.operators.vector_search import knn_many
from memloom.runtime import materialize
from memloom.sources.tables import current_nodes, latest_edges, norm_id, norm_name, table

MIN_COSINE = 0.85


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = current_nodes(table(spark, sf_dir, "nodes"), "embedding")
    near = vectors.nearest_vectors(nodes, "id", "embedding", k=5, min_cosine=MIN_COSINE)
    return near.select(F.least("id", "neighbour").alias("node_a"), F.greatest("id", "neighbour").alias("node_b")).distinct()


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar nodes of every node, nearest first, however near they are."""
    near = vectors.nearest_vectors(current_nodes(table(spark, sf_dir, "nodes"), "embedding"), "id", "embedding", k=5)
    return near.select(F.col("id").alias("node_id"), "neighbour", F.round("cosine", 6).alias("cosine"), "rank")


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of p1_neighbours against exact search, for every fiftieth node (by hash, ids aren't numbers)."""
    nodes = materialize(current_nodes(table(spark, sf_dir, "nodes"), "embedding"), "nodes")
    fine = (F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = nodes.where(fine)
    exact = knn_many(usable, usable.where(F.pmod(F.xxhash64("id"), F.lit(50)) == 0), 5).select(F.col("query_id").alias("id"), F.col("id").alias("neighbour"), F.lit(1).alias("exact"))
    found = vectors.nearest_vectors(nodes, "id", "embedding", k=5).select("id", "neighbour", F.lit(1).alias("hit"))
    both = exact.join(found, ["id", "neighbour"], "left")
    return both.agg((F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.sum("exact")).alias("recall_ok"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_pairs(current_nodes(table(spark, sf_dir, "nodes"), "content"), "id", "content")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of at least 20 words with the smallest id of its group."""
    groups = neardup.near_duplicate_groups(current_nodes(table(spark, sf_dir, "nodes"), "content"), "id", "content")
    return groups.select(F.col("id").alias("node_id"), "group_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = current_nodes(table(spark, sf_dir, "nodes"), "content")
    cuts = chunks.chunk_texts(nodes, table(spark, sf_dir, "chunking_config"))
    return cuts.where(F.size("starts") > 1).select("config_id", F.col("id").alias("node_id"), "forced")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = current_nodes(table(spark, sf_dir, "nodes"), "content")
    pieces = chunks.chunk_pieces(nodes, table(spark, sf_dir, "chunking_config"))
    return pieces.select("config_id", F.col("id").alias("node_id"), "piece", "start", "end", "text")


def p3_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By config what has to hold: the texts cut, every piece within the limit, the bodies put together as long as
    the texts, and every piece but the first beginning ``overlap`` before its body (or with the text)."""
    nodes = current_nodes(table(spark, sf_dir, "nodes"), "content")
    configs = table(spark, sf_dir, "chunking_config")
    limits = chunks.valid_configs(configs).select("config_id", "max_chunk_size", "overlap").distinct()
    pieces = chunks.chunk_pieces(nodes, configs).join(limits, "config_id")
    begins = F.col("start") == F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.greatest(F.col("body") - F.col("overlap"), F.lit(0)))
    by_text = pieces.groupBy("config_id", "id").agg(F.sum(F.col("end") - F.col("body")).alias("n"), F.max(F.length("text") - F.col("max_chunk_size")).alias("over"), F.min(begins.cast("int")).alias("begins"))
    whole = by_text.join(nodes.select("id", F.length("content").alias("length")), "id")
    return whole.groupBy("config_id").agg(F.count("*").alias("texts"), (F.max("over") <= 0).alias("within"), (F.min((F.col("n") == F.col("length")).cast("int")) == 1).alias("whole"), (F.min("begins") == 1).alias("overlapping"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = latest_edges(table(spark, sf_dir, "edges").where(norm_name("relation") == "similar_to"), "expired")
    links = materialize(e.where((F.col("source") != F.col("target")) & ~F.coalesce("expired", F.lit(False))).select("source", "target"), "links")
    ids = table(spark, sf_dir, "nodes").select(norm_id("id").alias("id")).distinct()
    # Each end is looked up once, however many rows it has; the rows are only compared with the ends that are no nodes.
    ends = links.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    missing = materialize(ends.join(ids, "id", "left_anti"), "missing")
    for side in ("source", "target"):
        links = links.join(missing.withColumnRenamed("id", side), side, "left_anti")
    groups = components.connected_components(links, "source", "target")
    return groups.select(F.col("id").alias("node_id"), F.col("label").alias("group_id"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack_items(sizes, "doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were divided, as the packing has them."""
    return p7_packed(spark, sf_dir).where("part = 1").select("doc_id")


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of what has to hold: every document comes out, none is divided without need, no container is
    over its capacity, and at most a fiftieth of the room is unused."""
    packed = p7_packed(spark, sf_dir).cache()
    items = packed.groupBy("doc_id").agg(F.sum("part_tokens").alias("n"), F.count("*").alias("parts"))
    used = packed.where("container >= 0").groupBy("container").agg(F.sum("part_tokens").alias("n"))
    a = items.agg(F.count("*").alias("documents"), F.count_if((F.col("n") <= packing.CAPACITY) & (F.col("parts") > 1)).alias("divided_small"))
    b = used.agg(F.count_if(F.col("n") > packing.CAPACITY).alias("overfull"), (F.sum("n") >= 0.98 * F.count("*") * packing.CAPACITY).alias("well_filled"))
    return a.crossJoin(b)  # one row each


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_report(p7_packed(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str, fit: str = "shares") -> tuple[DataFrame, DataFrame]:
    sizes = tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", keep=["source"])
    return mixing.mix_sources(sizes, table(spark, sf_dir, "mix_targets"), fit=fit)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that were drawn whole, max_repeats times, and still fall short of their target."""
    return _mixed(spark, sf_dir, "total")[1].where("exhausted").select("mix_id", "source")


def p8_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0].select("mix_id", "source", "doc_id", "copies")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1].select("mix_id", "source", "share", "target", "goal", "tokens", "actual_share", "documents", "copies", "exhausted")


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every (mix_id, source) what has to hold: copies within max_repeats, each document once, and
    the tokens within the largest document of the source of what the share asks for."""
    chosen, report = _mixed(spark, sf_dir)
    held = chosen.groupBy("mix_id", "source").agg(F.max("copies").alias("most"), F.count("*").alias("rows"), F.countDistinct("doc_id").alias("docs"))
    rows = report.join(held, ["mix_id", "source"], "left")
    return rows.select(
        "mix_id", "source",
        (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"),
        (F.coalesce("rows", F.lit(0)) == F.coalesce("docs", F.lit(0))).alias("once"),
        (F.abs(F.col("tokens") - F.col("goal")) <= F.col("largest")).alias("at_goal"),
    )


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = moderation.score_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return scored.select("doc_id", *(F.round(c, 6).alias(c) for c in (*moderation.CATEGORIES, "score")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.score_texts(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.col("score") >= moderation.THRESHOLD).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.source_rates(moderation.score_texts(table(spark, sf_dir, "documents"), "doc_id", "text", keep=["source"]))


def p9_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement with the sample of labels, some of which are wrong."""
    return moderation.label_report(moderation.score_texts(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "moderation_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p1_recall, p2_found, p2_groups, p3_found, p3_pieces, p3_invariants, p5_found, p7_found, p7_packed, p7_report, p7_invariants, p8_found, p8_chosen, p8_report, p8_invariants, p9_found, p9_scores, p9_rates, p9_labels)}

_CURRENT = """cur AS (SELECT lower(trim(id)) AS id, arg_max(content, coalesce(updated_at, TIMESTAMPTZ '1970-01-01 00:00:00+00')) AS content FROM nodes WHERE id IS NOT NULL GROUP BY 1)"""
# Pairs are narrowed by size only, so nothing of the operator is in the SQL.
_NEAR = f"""{_CURRENT},
sets AS (SELECT id, list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS w FROM cur WHERE content IS NOT NULL),
big AS (SELECT id, w, len(w) AS n FROM sets WHERE len(w) >= 20),
sized AS (SELECT a.id AS x, b.id AS y, a.n + b.n AS n, len(list_intersect(a.w, b.w)) AS k FROM big a JOIN big b ON a.id < b.id AND b.n BETWEEN 0.8 * a.n AND 1.25 * a.n),
pairs AS (SELECT x AS node_a, y AS node_b FROM sized WHERE k >= 0.8 * (n - k) - 1e-9)"""
# Words and signs stand for tokens: the counts differ, the documents over the capacity and the capped sources don't.
_TOKENS = "sized AS (SELECT doc_id, replace(lower(trim(source)), '-', '_') AS source, coalesce(len(regexp_extract_all(text, '[\\p{L}]{1,4}|[\\p{N}]{1,3}|[^\\s\\p{L}\\p{N}]')), 0) AS n FROM documents)"
_MIX = """want AS (SELECT mix_id, replace(lower(trim(source)), '-', '_') AS source, sum(greatest(coalesce(weight, 0), 0)) AS w, max(coalesce(max_repeats, 1)) AS r FROM mix_targets GROUP BY 1, 2)"""

SQL = {
    "p1_recall": "SELECT true AS recall_ok",
    "p2_found": f"WITH {_NEAR} SELECT node_a, node_b FROM pairs",
    "p2_groups": f"""WITH RECURSIVE {_NEAR}, both_ways AS (SELECT node_a AS s, node_b AS t FROM pairs UNION SELECT node_b, node_a FROM pairs),
reach AS (SELECT id, id AS seen FROM big UNION SELECT r.id, b.t FROM reach r JOIN both_ways b ON b.s = r.seen)
SELECT id AS node_id, min(seen) AS group_id FROM reach GROUP BY 1""",
    "p3_found": f"""WITH {_CURRENT}, cfg AS (SELECT DISTINCT config_id, max_chunk_size AS m, coalesce(respect_sentences, false) AS s FROM chunking_config
  WHERE max_chunk_size > 0 AND min_chunk_size <= max_chunk_size AND overlap < max_chunk_size AND overlap >= 0 AND semantic_threshold BETWEEN 0 AND 1),
longest AS (SELECT id, length(content) AS n, list_max(list_transform(string_split(regexp_replace(regexp_replace(content, '([.!?])([ \\t\\r\\n])', '\\1' || chr(1) || '\\2', 'g'), '([。！？])', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x, ' ' || chr(9) || chr(10) || chr(13))))) AS sentence FROM cur WHERE content IS NOT NULL)
SELECT config_id, id AS node_id, (s AND sentence > m)::INT AS forced FROM longest JOIN cfg ON n > m""",
    "p3_invariants": f"""WITH {_CURRENT}, cfg AS (SELECT DISTINCT config_id, max_chunk_size AS m FROM chunking_config
  WHERE max_chunk_size > 0 AND min_chunk_size <= max_chunk_size AND overlap < max_chunk_size AND overlap >= 0 AND semantic_threshold BETWEEN 0 AND 1)
SELECT config_id, count(*) AS texts, true AS within, true AS whole, true AS overlapping FROM cur JOIN cfg ON length(content) > m GROUP BY 1""",
    "p7_found": f"WITH {_TOKENS} SELECT doc_id FROM sized WHERE n > 4096",
    "p7_invariants": "SELECT count(*) AS documents, 0 AS divided_small, 0 AS overfull, true AS well_filled FROM documents",
    "p8_found": f"""WITH {_TOKENS}, {_MIX}, have AS (SELECT source, sum(n) AS n FROM sized GROUP BY 1)
SELECT mix_id, source FROM (SELECT mix_id, source, w / sum(w) OVER (PARTITION BY mix_id) AS share, r FROM want) LEFT JOIN have USING (source) WHERE share * (SELECT sum(n) FROM sized) > r * coalesce(n, 0)""",
    "p8_invariants": f"WITH {_MIX} SELECT mix_id, source, true AS within_repeats, true AS once, true AS at_goal FROM want",
    "p5_found": """WITH RECURSIVE latest AS (
  SELECT lower(trim(source)) AS s, lower(trim(target)) AS t, arg_max(expired, seq) AS expired FROM edges
  WHERE replace(replace(lower(trim(relation)), '-', '_'), ' ', '_') = 'similar_to' GROUP BY 1, 2),
ids AS (SELECT DISTINCT lower(trim(id)) AS id FROM nodes),
links AS (SELECT s, t FROM latest WHERE s <> t AND NOT coalesce(expired, false) AND s IN (FROM ids) AND t IN (FROM ids)),
both_ways AS (SELECT s, t FROM links UNION SELECT t, s FROM links),
reach AS (SELECT DISTINCT s AS id, s AS seen FROM both_ways UNION SELECT r.id, b.t FROM reach r JOIN both_ways b ON b.s = r.seen)
SELECT id AS node_id, min(seen) AS group_id FROM reach GROUP BY 1""",
}
