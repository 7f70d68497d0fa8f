"""Further queries of the engine's operators: point reads, changes, retrieval, statistics, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import decay, enums, text, vector
from memloom.operators import chunking, filters, graph, memory, mutations, paql, rag, traces, vector_search
from memloom.plans.reference_queries import AS_OF, BUSY, HOURS, _Q, E, N, S, as_of, busiest, edges, graph_tables, node_ids, nodes, query_vector, spans
from memloom.plans.registry import registry
from memloom.runtime import materialize, scratch
from memloom.sources.tables import norm_id, norm_name, table

QUERIES, SQL, query = registry()

# Point reads and lists


@query(f"WITH {N} SELECT id, node_type, round(confidence, 6) AS confidence FROM n ORDER BY id LIMIT 1")
def sc_node_get(spark, d):
    first = node_ids(spark, d).agg(F.min("id").alias("id")).first().id
    return graph.node_by_id(nodes(spark, d), first or "").select("id", "node_type", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {N}, {E}, t AS (SELECT DISTINCT target AS id FROM e) SELECT id IN (SELECT id FROM n) AS found, count(*) AS n FROM t GROUP BY 1")
def sc_exist(spark, d):
    asked = edges(spark, d, "seq").select(F.col("target").alias("id")).distinct()
    return graph.exist(node_ids(spark, d), asked).groupBy("found").agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT source, target, relation, round(weight, 6) AS weight FROM e ORDER BY source, target, relation LIMIT 1")
def sc_edge_get(spark, d):
    e = edges(spark, d, "weight", "seq")
    first = e.agg(F.min(F.struct("source", "target", "relation")).alias("k")).first().k
    return graph.edge_by_key(e, first.source, first.target, first.relation).select("source", "target", "relation", F.round("weight", 6).alias("weight"))


@query(f"WITH {N}, {E}, {BUSY} SELECT source, target, relation FROM e WHERE source IN (FROM busy)")
def sc_outgoing(spark, d):
    e, ids = graph_tables(spark, d)
    return graph.edges_of(e, busiest(spark, d, e, ids), "forward").select("source", "target", "relation")


_POPULAR = "popular AS (SELECT target AS id FROM e GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)"


def _popular(e) -> str:
    row = e.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").first()
    return row.target if row else ""


@query(f"WITH {E}, {_POPULAR} SELECT source, target, relation FROM e WHERE target IN (FROM popular)")
def sc_incoming(spark, d):
    e = materialize(edges(spark, d, "seq"), "edges")
    return graph.edges_of(e, _popular(e), "backward").select("source", "target", "relation")


@query(f"WITH {E}, {_POPULAR} SELECT source, target, relation FROM e WHERE target IN (FROM popular) UNION ALL SELECT source, target, relation FROM e WHERE source IN (FROM popular)")
def sc_edges_of(spark, d):
    e = materialize(edges(spark, d, "seq"), "edges")
    return graph.edges_of(e, _popular(e), "both").select("source", "target", "relation")


@query(f"WITH {N} SELECT id, node_type, (SELECT count(*) FROM n) AS total FROM n ORDER BY id LIMIT 40 OFFSET 60")
def sc_page_total(spark, d):
    return mutations.page_with_total(nodes(spark, d, "node_type"), 40, 60)


@query(f"WITH {N} SELECT count(*)::VARCHAR AS value FROM n")
def sc_metadata(spark, d):
    meta = spark.createDataFrame([("schema", "1"), ("nodes", "0")], "key string, value string")
    meta = mutations.put_metadata(mutations.put_metadata(meta, "nodes", str(node_ids(spark, d).count())), "schema", "2")
    return mutations.get_metadata(meta, "nodes")


_LANG = "CASE WHEN json_valid(attributes) THEN json_extract_string(attributes, '$.lang') END"


@query(f"WITH {N} SELECT id, content, node_type, round(confidence, 6) AS confidence, document_id, chunk_index, {_LANG} AS lang FROM n")
def js_nodes(spark, d):
    back = mutations.read_node_json(mutations.node_json(nodes(spark, d)))
    return back.select("id", "content", "node_type", F.round("confidence", 6).alias("confidence"), "document_id", "chunk_index", F.get_json_object("attributes", "$.lang").alias("lang"))


@query(f"WITH {E} SELECT source, target, relation, round(weight, 6) AS weight, coalesce(expired, false) AS expired FROM e")
def js_edges(spark, d):
    e = edges(spark, d)
    return mutations.read_edge_json(mutations.edge_json(e)).select("source", "target", "relation", F.round("weight", 6).alias("weight"), F.coalesce("expired", F.lit(False)).alias("expired"))


# Changes


@query(f"WITH {N} SELECT id, CASE WHEN node_type = 'fact' THEN 'concept' ELSE node_type END AS node_type FROM n")
def mu_upsert(spark, d):
    n = nodes(spark, d, "node_type")
    return mutations.upsert(n, n.where("node_type = 'fact'").withColumn("node_type", F.lit("concept")), ["id"])


@query(f"WITH {E} SELECT source, target, relation, seq FROM a")
def mu_fold_onto_base(spark, d):
    """The first half of the log makes the base, the second half is folded onto it."""
    log = table(spark, d, "edges").select(norm_id("source").alias("source"), norm_id("target").alias("target"), norm_name("relation").alias("relation"), F.col("seq").alias("version"), F.when(F.coalesce("expired", F.lit(False)), F.lit("delete")).otherwise(F.lit("put")).alias("op"), "seq")
    middle = log.agg(F.expr("percentile_approx(seq, 0.5)").alias("m")).first().m
    keys = ["source", "target", "relation"]
    empty = log.select(*keys, "version").limit(0)
    base = mutations.fold_changes(empty, log.where(F.col("seq") <= middle), keys)
    return mutations.fold_changes(base, log.where(F.col("seq") > middle), keys).select(*keys, F.col("version").alias("seq"))


@query(f"WITH {N}, k AS (SELECT content, CASE WHEN node_type IN {enums.NODE_TYPES} THEN node_type ELSE 'concept' END AS node_type FROM n), h AS (SELECT node_type, md5(node_type || '|' || coalesce(content, '')) AS m FROM k) SELECT substring(m, 1, 8) || '-' || substring(m, 9, 4) || '-' || substring(m, 13, 4) || '-' || substring(m, 17, 4) || '-' || substring(m, 21, 12) AS id, node_type, 1.0::DOUBLE AS access_score, 'user_input' AS source FROM h")
def mu_ingest_nodes(spark, d):
    return mutations.ingest_nodes(nodes(spark, d, "content", "node_type").drop("id"), AS_OF).select("id", "node_type", "access_score", "source")


@query(f"WITH {E} SELECT source, target, relation, round(least(greatest(coalesce(weight, 1), 0), 1), 6) AS weight FROM e")
def mu_clamp_edges(spark, d):
    return mutations.clamp_edges(edges(spark, d, "weight", "seq")).select("source", "target", "relation", F.round("weight", 6).alias("weight"))


@query(f"""WITH {N}, {E} SELECT 'edge' AS kind, CASE WHEN source NOT IN (SELECT id FROM n) THEN 'source not found' WHEN target NOT IN (SELECT id FROM n) THEN 'target not found' WHEN source = target THEN 'self loop'
WHEN NOT coalesce(weight BETWEEN 0 AND 1, false) THEN 'weight out of range' ELSE 'ok' END AS outcome, count(*) AS n FROM e GROUP BY 2
UNION ALL SELECT 'node', CASE WHEN content IS NULL OR regexp_replace(content, '\\s', '', 'g') = '' THEN 'empty content' WHEN strlen(content) > 10485760 THEN 'content too long' WHEN node_type NOT IN {enums.NODE_TYPES} THEN 'unknown node type'
WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence out of range' WHEN NOT coalesce(access_score >= 0, false) THEN 'access score out of range' ELSE 'ok' END, count(*) FROM n GROUP BY 2""")
def mu_bulk_summary(spark, d):
    n = mutations.validate_nodes(nodes(spark, d, "content", "node_type", "confidence", "access_score"))
    return mutations.bulk_summary(n, mutations.validate_edges(edges(spark, d, "weight", "seq"), node_ids(spark, d)))


@query(f"WITH {N} SELECT count(*) FILTER (WHERE node_type = 'entity') AS deleted, count(*) FILTER (WHERE node_type <> 'entity' OR node_type IS NULL) AS kept FROM n")
def mu_delete_nodes(spark, d):
    n = materialize(nodes(spark, d, "node_type"), "nodes")
    rest, _, gone = mutations.delete_nodes(n, edges(spark, d, "seq"), n.where("node_type = 'entity'"))
    return gone.crossJoin(rest.agg(F.count("*").alias("kept")))  # one row each


# Filters and the query language


@query(f"WITH {N} SELECT id FROM n WHERE confidence < 0.3 AND chunk_index < 4")
def f_less(spark, d):
    return filters.apply_filter(nodes(spark, d), filters.less("confidence", 0.3) & filters.less("chunk_index", 4)).select("id")


@query(f"WITH {S} SELECT span_id, name FROM t WHERE kind = 'function' ORDER BY start_time, span_id LIMIT 25 OFFSET 10")
def f_span_page(spark, d):
    return filters.SpanFilter(kind="function", limit=25, offset=10).apply(spans(spark, d)).select("span_id", "name")


@query(f"WITH {S} SELECT span_id FROM t WHERE kind = 'function' ORDER BY start_time, span_id OFFSET 10")
def f_span_offset(spark, d):
    return filters.SpanFilter(kind="function", offset=10).apply(spans(spark, d)).select("span_id")


@query(f"""WITH RECURSIVE {N}, {E}, {BUSY}, w AS (SELECT source AS f, target AS t FROM a WHERE source <> target UNION SELECT target, source FROM a WHERE source <> target),
r AS (SELECT id, 0 AS depth FROM busy UNION SELECT w.t, r.depth + 1 FROM r JOIN w ON w.f = r.id JOIN n ON n.id = w.t WHERE r.depth < 1)
SELECT id FROM n WHERE id IN (SELECT id FROM r WHERE depth > 0) OR coalesce(contains(lower(content), 'ledger'), false)""")
def paql_union(spark, d):
    """Both sides of an or, each id once."""
    e, ids = graph_tables(spark, d)
    return paql.run(f"ledger or (from {busiest(spark, d, e, ids)} within 1)", nodes(spark, d), e).select("id")


@query(f"WITH {_Q} SELECT c.id FROM (SELECT id FROM c WHERE c >= 0.1 ORDER BY c DESC, id LIMIT 40) c")
def paql_semantic(spark, d):
    q = paql.Query(paql.SemanticSearch("any words", k=40, min_score=0.1))
    v = query_vector(spark, d)
    return paql.run(q, nodes(spark, d), embed=lambda words: v).select("id")


@query(f"WITH {N} SELECT id FROM n WHERE contains(lower(content), 'memory') AND NOT coalesce(contains(lower(content), 'ledger'), false) ORDER BY access_score DESC NULLS LAST, id LIMIT 12")
def paql_builder(spark, d):
    q = paql.Query(paql.And(paql.TextSearch("memory"), paql.Not(paql.TextSearch("ledger")))).with_limit(12).with_sort("access_score")
    return paql.run(q, table(spark, d, "nodes"), versions=True).select("id")


@query(f"WITH {_Q} SELECT id, row_number() OVER (ORDER BY c DESC, id) AS rank, round(least(greatest(c, 0), 1), 6) AS score FROM c ORDER BY c DESC, id LIMIT 15")
def rag_search_text(spark, d):
    """Hits with score and rank, joined to their nodes."""
    v = query_vector(spark, d)
    return rag.search_text(nodes(spark, d), "any words", 15, embed=lambda words: v).select("id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {N} SELECT id, row_number() OVER (ORDER BY access_score DESC NULLS LAST, id) AS rank, round(access_score, 6) AS score FROM n WHERE contains(lower(content), 'ledger') ORDER BY access_score DESC NULLS LAST, id LIMIT 15")
def rag_search_words(spark, d):
    """The same without an embedding: by the words."""
    return rag.search_text(nodes(spark, d), "Ledger", 15).select("id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


# Graph and retrieval


@query(f"""WITH RECURSIVE {N}, {E}, {BUSY}, w AS (SELECT DISTINCT source AS f, target AS t FROM a WHERE source <> target),
r AS (SELECT id, 0 AS depth FROM busy UNION SELECT w.t, r.depth + 1 FROM r JOIN w ON w.f = r.id JOIN n ON n.id = w.t WHERE r.depth < 2) SELECT DISTINCT id FROM r""")
def g_subgraph_nodes(spark, d):
    e, ids = graph_tables(spark, d)
    return graph.subgraph(e, ids, [busiest(spark, d, e, ids)], 2, None)[0]


@query(f"""WITH RECURSIVE {N}, {E}, {BUSY}, w AS (SELECT source AS f, target AS t FROM a WHERE source <> target UNION SELECT target, source FROM a WHERE source <> target),
r AS (SELECT id, 0 AS depth FROM busy UNION SELECT w.t, r.depth + 1 FROM r JOIN w ON w.f = r.id JOIN n ON n.id = w.t WHERE r.depth < 2), found AS (SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0)
SELECT count(*) AS nodes, max(depth) AS depth, (SELECT count(*) FROM a WHERE source IN (SELECT id FROM found)) AS edges FROM found""")
def g_traverse_totals(spark, d):
    e, ids = graph_tables(spark, d)
    _, near, totals = graph.traverse(e, ids, busiest(spark, d, e, ids), "both", 2, None)
    return totals.select("nodes", "depth").crossJoin(near.agg(F.count("*").alias("edges")))  # one row each


@query(f"""WITH {_Q}, {E}, {BUSY}, w AS (SELECT source AS f, target AS t, weight FROM a WHERE weight >= 0.3 UNION ALL SELECT target, source, weight FROM a WHERE weight >= 0.3),
h1 AS (SELECT t AS id, max(weight) AS weight FROM w JOIN n ON n.id = w.t WHERE f IN (FROM busy) AND t NOT IN (FROM busy) AND node_type IN ('fact', 'entity') GROUP BY 1)
SELECT id, 0 AS hop, 0.9 AS score FROM busy UNION ALL SELECT id, 1, round((0.7 * 0.9 + 0.3 * weight) * 0.9, 6) FROM h1""")
def rag_expand_types(spark, d):
    e, ids = graph_tables(spark, d)
    seeds = spark.createDataFrame([(busiest(spark, d, e, ids), 0.9)], "id string, score double")
    out = rag.expand(seeds, e, 1, 0.3, None, None, nodes=nodes(spark, d, "node_type"), node_types=["fact", "entity"])
    return out.select("id", "hop", F.round("score", 6).alias("score"))


_HOPS = f"""{N}, {E}, {BUSY}, w AS (SELECT source AS f, target AS t, weight FROM a WHERE weight >= 0.3 UNION ALL SELECT target, source, weight FROM a WHERE weight >= 0.3),
h0 AS (SELECT id, 1.0::DOUBLE AS weight, 0.9::DOUBLE AS score FROM busy), h1 AS (SELECT t AS id, max(weight) AS weight, (0.7 * 0.9 + 0.3 * max(weight)) * 0.9 AS score FROM w WHERE f IN (FROM busy) AND t NOT IN (FROM busy) GROUP BY 1)"""


@query(f"""WITH {_HOPS}, front AS (SELECT * FROM h1 ORDER BY score * weight / 2 DESC, id LIMIT 5),
h2 AS (SELECT t AS id, max({{'w': w.weight, 's': front.score}}) AS b FROM w JOIN front ON front.id = w.f WHERE t NOT IN (SELECT id FROM h0) AND t NOT IN (SELECT id FROM h1) GROUP BY 1),
every AS (SELECT id, 0 AS hop, score FROM h0 UNION ALL SELECT id, 1, score FROM h1 UNION ALL SELECT id, 2, (0.7 * b.s + 0.3 * b.w) * 0.81 FROM h2)
SELECT id, hop, round(score, 6) AS score FROM every ORDER BY hop, every.score DESC, id LIMIT 120""")
def rag_expand_capped(spark, d):
    """The five of the highest priority are expanded; at most 120 rows come back."""
    e, ids = graph_tables(spark, d)
    seeds = spark.createDataFrame([(busiest(spark, d, e, ids), 0.9)], "id string, score double")
    return rag.expand(seeds, e, 2, 0.3, 5, 120, "weighted").select("id", "hop", F.round("score", 6).alias("score"))


@query(f"WITH {_HOPS} SELECT 1 AS seeds, count(*) + 1 AS nodes, 1 AS max_hop, count(*) AS edges_used FROM h1")
def rag_expansion_stats(spark, d):
    e, ids = graph_tables(spark, d)
    seeds = spark.createDataFrame([(busiest(spark, d, e, ids), 0.9)], "id string, score double")
    return rag.expansion_stats(rag.expand(seeds, e, 1, 0.3, None, None))


@query(f"WITH {_HOPS} SELECT node_type, count(*) AS n FROM n WHERE id IN (SELECT id FROM h0 UNION ALL SELECT id FROM h1) GROUP BY 1")
def rag_type_counts(spark, d):
    e, ids = graph_tables(spark, d)
    seeds = spark.createDataFrame([(busiest(spark, d, e, ids), 0.9)], "id string, score double")
    return rag.type_counts(rag.expand(seeds, e, 1, 0.3, None, None), nodes(spark, d, "node_type"))


@query(f"WITH {N}, {E}, {BUSY}, w AS (SELECT source AS f, target AS t, weight FROM a WHERE weight >= 0 AND relation = 'causes' UNION ALL SELECT target, source, weight FROM a WHERE weight >= 0 AND relation = 'causes') SELECT t AS id, 1 AS hop, round(max(weight), 6) AS weight FROM w WHERE f IN (FROM busy) AND t NOT IN (FROM busy) GROUP BY 1 UNION ALL SELECT id, 0, 1.0 FROM busy")
def rag_expand_relation(spark, d):
    e, ids = graph_tables(spark, d)
    seeds = spark.createDataFrame([(busiest(spark, d, e, ids), 0.9)], "id string, score double")
    return rag.expand_by_relation(seeds, e, ["causes"]).select("id", "hop", F.round("weight", 6).alias("weight"))


@query(f"WITH {_HOPS}, x AS (SELECT id, 0 AS hop, score FROM h0 UNION ALL SELECT id, 1, score FROM h1), g AS (SELECT x.id, hop, x.score, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence ELSE 0.5 END AS weight FROM x LEFT JOIN n USING (id)) SELECT id, hop, round((0.7 * score + 0.3 * weight) * 0.9 ** hop, 6) AS rescored FROM g")
def rag_rerank_expanded(spark, d):
    """Weights from the nodes' confidence, 0.5 where it is out of range or the node is missing."""
    e, ids = graph_tables(spark, d)
    seeds = spark.createDataFrame([(busiest(spark, d, e, ids), 0.9)], "id string, score double")
    weights = nodes(spark, d, "confidence").where("confidence between 0 and 1").select("id", F.col("confidence").alias("weight"))
    return rag.rerank_expanded(rag.expand(seeds, e, 1, 0.3, None, None), weights).select("id", "hop", F.round("rescored", 6).alias("rescored"))


@query(f"WITH {_Q} SELECT id, round(least(greatest(0.6 * c + 0.4 * 0.5 ** (1 + length(id) % 2), 0), 1), 6) AS final_score FROM c")
def rag_rerank(spark, d):
    v = query_vector(spark, d)
    rows = vector.with_cosine(nodes(spark, d, "embedding").where("size(embedding) = 64"), "embedding", v)
    return rag.rerank(rows.select("id", F.col("cosine").alias("vector_similarity"), (1 + F.length("id") % 2).alias("hop_distance"))).select("id", F.round("final_score", 6).alias("final_score"))


@query(f"WITH {_Q} SELECT id, round(0.6 * c + 0.4, 6) AS score FROM c WHERE c >= 0.2 ORDER BY 0.6 * c + 0.4 DESC, id LIMIT 15")
def rag_mode_switch(spark, d):
    cfg = rag.RetrievalConfig(mode="vector", min_relevance=0.2, max_vector_results=15)
    return rag.retrieve(nodes(spark, d, "embedding"), edges(spark, d, "expired", "seq"), query_vector(spark, d), config=cfg).select("id", F.round("score", 6).alias("score"))


_HITS15 = f"{_Q}, top AS (SELECT id, 0.6 * c + 0.4 AS score FROM c WHERE c >= 0 ORDER BY c DESC, id LIMIT 25), x AS (SELECT n.id, content, score, sum(strlen(content) // 4) OVER (ORDER BY score DESC, n.id) AS t, row_number() OVER (ORDER BY score DESC, n.id) AS r FROM top JOIN n USING (id) WHERE content IS NOT NULL), fit AS (SELECT * FROM x WHERE t <= 900)"


@query(f"WITH {_HITS15} SELECT string_agg('[' || r || '] ' || content || ' (relevance: ' || printf('%.2f', score) || ')', chr(10) || chr(10) ORDER BY r) AS context FROM fit")
def rag_context(spark, d):
    """Retrieval, budget and format in one."""
    cfg = rag.RetrievalConfig(mode="vector", min_relevance=0.0, max_vector_results=25, max_context_tokens=900)
    return rag.retrieve_context(nodes(spark, d), edges(spark, d, "expired", "seq"), query_vector(spark, d), config=cfg)[0]


@query(f"WITH {_HITS15} SELECT id, CASE WHEN length(content) > 100 THEN substring(content, 1, 97) || '...' ELSE content END AS preview, round(score, 6) AS score FROM fit")
def rag_sources(spark, d):
    cfg = rag.RetrievalConfig(mode="vector", min_relevance=0.0, max_vector_results=25, max_context_tokens=900)
    return rag.retrieve_context(nodes(spark, d), edges(spark, d, "expired", "seq"), query_vector(spark, d), config=cfg)[1].select("id", "preview", F.round("score", 6).alias("score"))


@query(f"WITH {_Q}, top AS (SELECT id FROM c WHERE c >= 0.2 ORDER BY c DESC, id LIMIT 15) SELECT count(*) AS total, count(*) AS direct, 0 AS graph, sum(strlen(content) // 4)::BIGINT AS context_size FROM top JOIN n USING (id)")
def rag_result_stats(spark, d):
    cfg = rag.RetrievalConfig(mode="vector", min_relevance=0.2, max_vector_results=15)
    hits = rag.vector_retrieve(nodes(spark, d, "embedding"), query_vector(spark, d), cfg)
    return rag.result_stats(hits.join(nodes(spark, d, "content"), "id"))


@query("SELECT lower(trim(id)) AS id, round(max(confidence), 6) AS score FROM nodes WHERE id IS NOT NULL AND confidence IS NOT NULL GROUP BY 1")
def rag_dedup(spark, d):
    """The best of the versions of an id."""
    rows = table(spark, d, "nodes").where("id is not null and confidence is not null").select(norm_id("id").alias("id"), F.col("confidence").alias("score"))
    return rag.dedup_by_score(rows).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {N}, s AS (SELECT sum(strlen(content) // 4) AS t FROM n) SELECT CASE WHEN t > 50000 THEN 'document' ELSE 'paragraph' END AS level, (SELECT count(*) FROM n WHERE node_type IN ('entity', 'concept') OR (t <= 50000 AND node_type = 'fact')) AS n FROM s")
def rag_select_context(spark, d):
    level, rows = rag.select_context(nodes(spark, d, "content", "node_type"), 50_000, 0.5)
    return rows.agg(F.lit(level).alias("level"), F.count("*").alias("n"))


@query(f"WITH {N} SELECT id AS chunk_id, lower(trim(document_id)) AS parent_id FROM n WHERE lower(trim(document_id)) IN (SELECT lower(trim(document_id)) FROM documents)")
def rag_children(spark, d):
    docs = table(spark, d, "documents").select(norm_id("document_id").alias("id"))
    pieces = nodes(spark, d, "document_id").where("document_id is not null").select(F.col("id").alias("chunk_id"), norm_id("document_id").alias("parent_id"))
    return rag.children_of(docs, pieces).select("chunk_id", "parent_id")


@query(f"WITH {N} SELECT DISTINCT lower(trim(document_id)) AS chunk_id FROM documents WHERE lower(trim(document_id)) IN (SELECT lower(trim(document_id)) FROM n WHERE document_id IS NOT NULL)")
def rag_parents(spark, d):
    docs = table(spark, d, "documents").select(norm_id("document_id").alias("chunk_id"))
    return rag.parents_of(nodes(spark, d, "document_id").where("document_id is not null").select(norm_id("document_id").alias("parent_id")), docs).distinct()


@query(f"WITH {E} SELECT source, target, relation, round(0.8 * weight / 2, 6) AS priority FROM e WHERE weight IS NOT NULL")
def rag_priority(spark, d):
    return edges(spark, d, "weight", "seq").where("weight is not null").select("source", "target", "relation", F.round(rag.expansion_priority(F.lit(0.8), F.col("weight"), F.lit(1)), 6).alias("priority"))


# Vectors


@query(f"WITH {_Q} SELECT count(*) AS n FROM u WHERE id NOT IN (SELECT id FROM n WHERE node_type = 'fact') OR id IN (SELECT id FROM n WHERE node_type = 'fact' AND confidence > 0.5)")
def v_index_changes(spark, d):
    """Built, rows removed, some of them put back, saved, opened and counted."""
    n = materialize(nodes(spark, d, "embedding", "node_type", "confidence").where("size(embedding) = 64"), "vectors")
    index = vector_search.IVF(n, vector_search.IndexParams("ivf")).remove(n.where("node_type = 'fact'").select("id"))
    index = index.upsert(n.where("node_type = 'fact' and confidence > 0.5"))
    path = scratch(spark, "index")
    index.save(path)
    return vector_search.IVF.open(spark, path).rows.agg(F.count("*").alias("n"))


@query(f"WITH {_Q}, m AS (SELECT id, v, coalesce(chunk_index, 0) % 2 AS k FROM u JOIN n USING (id) WHERE len(list_filter(v, lambda x: isnan(x) OR isinf(x))) = 0) SELECT id, round((v[1] + k * v[64]) / (1 + k), 5) AS first, round((v[2] + k * v[63]) / (1 + k), 5) AS second FROM m")
def em_mean_pool(spark, d):
    """Two token states a node, the vector and its reverse; the second one is masked out for even chunks."""
    fine = (F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    n = nodes(spark, d, "embedding", "chunk_index").where(fine)
    pooled = vector.mean_pool(F.array("embedding", F.reverse("embedding")), F.array(F.lit(1), F.coalesce("chunk_index", F.lit(0)) % 2))
    return n.select("id", pooled.alias("p")).select("id", F.round(F.get("p", F.lit(0)), 5).alias("first"), F.round(F.get("p", F.lit(1)), 5).alias("second"))


@query(r"""SELECT count(*) AS texts, sum(len(list_filter(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'), lambda x: x <> '')))::BIGINT AS tokens, round(1 - count(DISTINCT regexp_replace(text, '^\s+|\s+$', '', 'g')) / count(*), 6) AS hit_rate FROM documents WHERE text IS NOT NULL""")
def em_stats(spark, d):
    """What an embedding service would have counted: texts, their words, and how many were there before."""
    t = table(spark, d, "documents").where("text is not null").select(text.strip(F.col("text")).alias("text"))
    return t.agg(F.count("*").alias("texts"), F.sum(text.word_count(F.col("text")).cast("long")).alias("tokens"), F.round(1 - F.countDistinct("text") / F.count("*"), 6).alias("hit_rate"))


@query()
def em_embed(spark, d):
    """The deterministic embedding of every title; no SQL has its hash."""
    return table(spark, d, "documents").select("doc_id", vector.hash_embedding(F.col("title"), 16).alias("e")).select("doc_id", F.size("e").alias("dim"))


# Memory


@query(f"WITH {N} SELECT id, round(least(greatest(access_score + 0.75, 0), 10), 6) AS accessed, round(least(access_score + 2, 10), 6) AS reinforced, round(least(greatest(access_score + 3, 0.1), 10), 6) AS boosted FROM n WHERE access_score IS NOT NULL")
def md_access(spark, d):
    s = F.col("access_score")
    return nodes(spark, d, "access_score").where("access_score is not null").select("id", F.round(decay.accessed(s, F.lit(0.75)), 6).alias("accessed"), F.round(decay.reinforced(s, F.lit(2.0)), 6).alias("reinforced"), F.round(decay.boosted(s, F.lit(3)), 6).alias("boosted"))


@query(f"WITH {N} SELECT id FROM n WHERE access_score IS NOT NULL AND CASE WHEN accessed_at IS NULL THEN access_score ELSE access_score * exp(-0.0015 * floor({HOURS})) END < 0.5")
def md_archive(spark, d):
    return nodes(spark, d, "access_score", "accessed_at").where(decay.should_archive(F.col("access_score"), F.col("accessed_at"), as_of(), 0.5)).select("id")


@query(f"WITH {N} SELECT id, round(CASE WHEN accessed_at IS NULL THEN access_score ELSE least(greatest(access_score * exp(-0.0015 * {HOURS}), 0.1), 10) END, 6) AS access_score FROM n")
def md_decay_update(spark, d):
    return memory.decay_update(nodes(spark, d, "access_score", "accessed_at"), as_of()).select("id", F.round("access_score", 6).alias("access_score"))


@query(f"WITH {N}, l AS (SELECT lower(trim(node_id)) AS id, max(ts) AS ts FROM access_log WHERE node_id IS NOT NULL AND ts <= TIMESTAMPTZ '{AS_OF}+00' GROUP BY 1) SELECT n.id, epoch_us(coalesce(l.ts, n.accessed_at)) AS at FROM n LEFT JOIN l USING (id)")
def md_record_access(spark, d):
    return memory.record_access(nodes(spark, d, "access_score", "accessed_at"), table(spark, d, "access_log"), as_of()).select("id", F.unix_micros("accessed_at").alias("at"))


@query(f"WITH {N}, p AS (SELECT CASE WHEN accessed_at IS NULL THEN access_score ELSE access_score * exp(-0.0015 * {HOURS}) END AS s FROM n) SELECT count(*) AS pruned, round(sum(s), 4) AS score_reclaimed FROM p WHERE s < 0.1")
def md_prune_summary(spark, d):
    return memory.prune_summary(memory.prunable(nodes(spark, d, "access_score", "accessed_at"), as_of())).select("pruned", F.round("score_reclaimed", 4).alias("score_reclaimed"))


@query(f"WITH {N}, {E} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM n) AS total, (SELECT count(*) FROM n WHERE CASE WHEN accessed_at IS NULL THEN access_score ELSE least(greatest(access_score * exp(-0.0015 * {HOURS}), 0.1), 10) END >= 0.5) AS active")
def a_stats_with_memory(spark, d):
    n = nodes(spark, d, "embedding", "node_type", "access_score", "accessed_at")
    stats = mutations.database_stats(n, edges(spark, d, "seq"), memory.memory_stats(n, as_of(), active_from=0.5))
    return stats.select("nodes", "edges", "total", "active")


# Texts, names, ranges


@query(f"WITH {E} SELECT source || '::' || target || '::' || relation AS edge_id, printf('%.2f', weight) AS weight FROM e WHERE weight IS NOT NULL AND round(weight * 1000) % 10 <> 5")
def t_edge_ids(spark, d):
    e = edges(spark, d, "weight", "seq").where("weight is not null and round(weight * 1000) % 10 <> 5")
    return e.select(enums.edge_id(F.col("source"), F.col("target"), F.col("relation")).alias("edge_id"), text.two_places(F.col("weight")).alias("weight"))


@query(r"WITH r AS (SELECT doc_id, text, unnest([0, 1, 2]) AS idx, [0, 40, 100] AS a, [40, 100, 5000] AS b FROM documents WHERE text IS NOT NULL) SELECT doc_id, idx, regexp_replace(substring(text, a[idx + 1] + 1, b[idx + 1] - a[idx + 1]), '^\s+|\s+$', '', 'g') AS content FROM r")
def ch_ranges(spark, d):
    part = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    t = table(spark, d, "documents").select("doc_id", "text", F.array(part(0, 40), part(40, 100), part(100, 5000)).alias("ranges"))
    return chunking.chunks_from_ranges(t, "doc_id", "text", "ranges").select("doc_id", "idx", "content")


# Traces


@query(f"WITH {S} SELECT count(*) AS roots FROM t WHERE parent_id IS NULL")
def tr_roots(spark, d):
    return traces.roots(spans(spark, d)).agg(F.count("*").alias("roots"))


_EVENTS = f"{S}, ev AS (SELECT span_id, 'enter' AS event_type, start_time AS ts FROM t UNION ALL SELECT span_id, CASE WHEN status = 'failed' THEN 'error' WHEN status = 'cancelled' THEN 'cancel' ELSE 'exit' END, end_time FROM t WHERE end_time IS NOT NULL)"


@query(f"WITH {_EVENTS} SELECT span_id, event_type, epoch_us(ts) AS at FROM ev WHERE event_type IN ('error', 'enter') AND ts BETWEEN TIMESTAMPTZ '2024-02-01 00:00:00+00' AND TIMESTAMPTZ '2024-04-01 00:00:00+00'")
def tr_event_filter(spark, d):
    e = traces.filter_events(traces.trace_events(spans(spark, d)), ["error", "enter"], "2024-02-01 00:00:00", "2024-04-01 00:00:00")
    return e.select("span_id", "event_type", F.unix_micros("ts").alias("at"))


@query(f"WITH {_EVENTS} SELECT (SELECT count(*) FROM t) AS span_count, (SELECT count(*) FROM ev) AS event_count")
def tr_storage(spark, d):
    s = spans(spark, d)
    return traces.storage_stats(s, traces.trace_events(s))


@query(f"""WITH {S}, b AS (SELECT time_bucket(INTERVAL 1 DAY, start_time) AS window_start, count(*) AS spans, list_sort(list(duration_ms) FILTER (WHERE duration_ms IS NOT NULL)) AS l FROM t WHERE start_time IS NOT NULL GROUP BY 1)
SELECT window_start, spans, """ + ", ".join(f"l[least(floor(len(l) * {p}), len(l) - 1)::BIGINT + 1] AS p{round(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM b")
def tr_window_percentiles(spark, d):
    return traces.window_percentiles(spans(spark, d)).select("window_start", "spans", "p50", "p95", "p99")


_BIGGEST = f"""{_EVENTS}, x AS (SELECT c.span_id, c.span_id AS root_id FROM t c LEFT JOIN t p ON p.span_id = c.parent_id WHERE p.span_id IS NULL UNION ALL SELECT t.span_id, x.root_id FROM x JOIN t ON t.parent_id = x.span_id),
big AS (SELECT root_id FROM x GROUP BY 1 ORDER BY count(*) DESC, root_id LIMIT 1)"""


def _biggest(tree) -> str:
    row = traces.lifecycle_stats(tree).orderBy(F.desc("span_count"), "root_id").first()
    return row.root_id if row else ""


@query(f"WITH RECURSIVE {_BIGGEST} SELECT span_id, event_type, epoch_us(ts) AS at FROM ev WHERE span_id IN (SELECT span_id FROM x WHERE root_id IN (FROM big))")
def tr_timeline(spark, d):
    s = materialize(spans(spark, d), "spans")
    tree = materialize(traces.lifecycle(s), "tree")
    return traces.timeline(traces.trace_events(s), tree, _biggest(tree)).select("span_id", "event_type", F.unix_micros("ts").alias("at"))


@query(f"WITH RECURSIVE {_BIGGEST} SELECT root_id, (epoch_us(end_time) - epoch_us(start_time)) / 1000.0 AS total_ms FROM x JOIN t USING (span_id) WHERE span_id = root_id")
def tr_timeline_total(spark, d):
    return traces.timeline_total(traces.lifecycle(spans(spark, d)))


@query(f"WITH {S} SELECT name, count(*) AS n FROM t WHERE start_time >= TIMESTAMPTZ '2024-02-01 00:00:00+00' GROUP BY 1")
def tr_span_store(spark, d):
    """Appended in two parts, read back from a day on, merged and counted."""
    raw = table(spark, d, "spans").drop("attributes")
    path = scratch(spark, "span-store")
    half = F.pmod(F.xxhash64("span_id"), F.lit(2)) == 0
    for part in (raw.where(half), raw.where(~half | F.col("span_id").isNull())):
        traces.append_spans(part, path)
    return traces.merge_spans(traces.stored(spark, path)).where(F.col("start_time") >= F.lit("2024-02-01 00:00:00").cast("timestamp")).groupBy("name").agg(F.count("*").alias("n"))
