"""Queries of the engine's own operators over whole tables, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import decay, enums, text
from memloom.functions.vector import cosine
from memloom.operators import chunking, filters, graph, memory, mutations, paql, rag, traces, vector_search
from memloom.operators.hierarchy import normal_id
from memloom.plans.registry import registry
from memloom.runtime import materialize
from memloom.sources.tables import current_nodes, current_rows, latest_edges, norm_id, norm_name, table

AS_OF = "2024-08-01 00:00:00"
SLOW = decay.DecayConfig(rate=0.002, min_score=0.1, max_score=10.0, boost=0.5)


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp")


def nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    df = current_nodes(table(spark, d, "nodes"), *columns) if columns else current_rows(table(spark, d, "nodes"))
    return df.withColumn("node_type", norm_name("node_type")) if "node_type" in df.columns else df


def edges(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest_edges(table(spark, d, "edges"), *(columns or ("weight", "created_at", "expired", "replaced_by", "attributes", "seq")))


def spans(spark: SparkSession, d: str) -> DataFrame:
    return traces.merge_spans(table(spark, d, "spans"))


def graph_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(latest edges, ids of the nodes), written once for the searches of a query."""
    return materialize(edges(spark, d, "weight", "expired", "seq"), "edges"), materialize(node_ids(spark, d), "ids")


def node_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").select(norm_id("id").alias("id")).where("id is not null").distinct()


def busiest(spark: SparkSession, d: str, e: DataFrame | None = None, ids: DataFrame | None = None) -> str:
    """The node with the most active outgoing edges, the smallest id of those: start of the traversals."""
    e = (edges(spark, d, "expired", "seq") if e is None else e).where(~F.coalesce("expired", F.lit(False)))
    e = e.join((node_ids(spark, d) if ids is None else ids).select(F.col("id").alias("source")), "source", "left_semi")
    row = e.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").first()
    return row.source if row else ""


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The embedding of the smallest id that has a usable one."""
    row = nodes(spark, d, "embedding").where((F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)).orderBy("id").first()
    return list(row.embedding) if row else [1.0] + [0.0] * 63


N = """n AS (SELECT lower(trim(id)) AS id, content, replace(replace(lower(trim(node_type)), '-', '_'), ' ', '_') AS node_type, embedding, created_at, updated_at, accessed_at,
  access_score, confidence, source, document_id, chunk_index, attributes FROM nodes WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY updated_at DESC NULLS LAST) = 1)"""
E = """e AS (SELECT lower(trim(source)) AS source, lower(trim(target)) AS target, replace(replace(lower(trim(relation)), '-', '_'), ' ', '_') AS relation, weight, created_at, expired, seq FROM edges
  QUALIFY row_number() OVER (PARTITION BY lower(trim(source)), lower(trim(target)), replace(replace(lower(trim(relation)), '-', '_'), ' ', '_') ORDER BY seq DESC) = 1),
a AS (SELECT * FROM e WHERE NOT coalesce(expired, false))"""
BUSY = "busy AS (SELECT source AS id FROM a WHERE source IN (SELECT id FROM n) GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)"
S = """s AS (SELECT lower(trim(span_id)) AS span_id, min(nullif(lower(trim(parent_id)), '')) AS parent_id,
  arg_max({'name': name, 'kind': replace(replace(lower(trim(kind)), '-', '_'), ' ', '_'), 'start_time': start_time, 'end_time': end_time, 'duration_ms': duration_ms, 'status': replace(lower(trim(status)), '-', '_'), 'error': error},
    {'a': end_time IS NOT NULL, 'b': coalesce(end_time, TIMESTAMPTZ '1900-01-01 00:00:00+00'), 'c': coalesce(duration_ms, -1), 'd': coalesce(status, ''), 'e': coalesce(name, ''), 'f': coalesce(kind, ''), 'g': coalesce(error, '')}) AS r
  FROM spans WHERE nullif(lower(trim(span_id)), '') IS NOT NULL GROUP BY 1),
t AS (SELECT span_id, parent_id, r.name AS name, r.kind AS kind, r.start_time AS start_time, r.end_time AS end_time, r.duration_ms AS duration_ms, r.status AS status, r.error AS error FROM s)"""
HOURS = f"greatest((epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(accessed_at)) / 3.6e9, 0)"

QUERIES, SQL, query = registry()


# Scans, projections, filters


@query(f"WITH {N} SELECT id, node_type, round(confidence, 6) AS confidence, round(access_score, 6) AS access_score, source, document_id, chunk_index FROM n")
def sc_nodes(spark, d):
    return nodes(spark, d).select("id", "node_type", F.round("confidence", 6).alias("confidence"), F.round("access_score", 6).alias("access_score"), "source", "document_id", "chunk_index")


@query(f"WITH {N} SELECT id, node_type FROM n ORDER BY id LIMIT 50 OFFSET 100")
def sc_page(spark, d):
    return mutations.page(nodes(spark, d, "node_type"), 50, 100)


@query(f"WITH {N} SELECT id, len(embedding) AS dim FROM n WHERE len(embedding) > 0")
def sc_embedded(spark, d):
    return vector_search.embedded(nodes(spark, d, "embedding")).select("id", F.size("embedding").cast("long").alias("dim"))


@query(f"WITH {E} SELECT source, target, arg_min(relation, seq) AS relation, min(seq) AS seq FROM e GROUP BY 1, 2")
def sc_edge_between(spark, d):
    return graph.edge_between(edges(spark, d, "seq").select("source", "target", "relation", "seq"))


@query(f"WITH {N} SELECT id FROM n WHERE node_type IN ('concept', 'fact') AND confidence >= 0.4 AND confidence <= 0.9 AND access_score >= 0.5 AND created_at >= TIMESTAMPTZ '2024-02-01 00:00:00+00'")
def f_node_filter(spark, d):
    raw = table(spark, d, "nodes")
    return current_rows(raw, filters.NodeFilter(("concept", "fact"), 0.4, 0.9, 0.5, "2024-02-01 00:00:00").condition(raw.columns)).select("id")


@query(f"""WITH {N} SELECT id FROM n WHERE (coalesce(contains(lower(content), 'ledger'), false) OR coalesce(source IN ('web_crawl', 'api_import'), false))
AND NOT (coalesce(confidence BETWEEN 0.2 AND 0.6, false)) AND coalesce(access_score > 0.3, false) AND NOT coalesce(node_type = 'entity', false)""")
def f_filter_tree(spark, d):
    f = (filters.contains("content", "Ledger") | filters.one_of("source", ["web_crawl", "api_import"])) & ~filters.between("confidence", 0.2, 0.6) & filters.greater("access_score", 0.3) & ~filters.equals("node_type", "entity")
    raw = table(spark, d, "nodes")
    return current_rows(raw, filters.compile_filter(f, raw.columns)).select("id")


@query(f"WITH {N} SELECT id, json_extract_string(attributes, '$.lang') AS lang FROM n WHERE json_valid(attributes) AND json_extract_string(attributes, '$.lang') = 'de'")
def f_attribute(spark, d):
    return filters.apply_filter(nodes(spark, d), filters.equals("lang", "de")).select("id", F.get_json_object("attributes", "$.lang").alias("lang"))


@query(f"WITH {S} SELECT span_id, name FROM t WHERE contains(name, 'embed') AND kind = 'database_query' AND start_time >= TIMESTAMPTZ '2024-02-01 00:00:00+00' AND duration_ms BETWEEN 5 AND 50")
def f_span_filter(spark, d):
    return filters.SpanFilter(name_contains="embed", kind="database_query", start_after="2024-02-01 00:00:00", min_duration=5, max_duration=50).apply(spans(spark, d)).select("span_id", "name")


@query(f"WITH {E} SELECT relation, count(*) AS n, count(*) FILTER (WHERE weight >= 0.5) AS heavy FROM a WHERE relation IN ('causes', 'is_a', 'similar_to') GROUP BY 1")
def f_edges(spark, d):
    e = graph.usable_edges(edges(spark, d), ["causes", "is_a", "similar_to"])
    return e.groupBy("relation").agg(F.count("*").alias("n"), F.count_if(F.col("weight") >= 0.5).alias("heavy"))


@query(f"""WITH {N} SELECT id, CASE WHEN length(content) > 100 THEN substring(content, 1, 97) || '...' ELSE content END AS preview, epoch_us(created_at) // 1000000 AS created, strlen(content) // 4 AS tokens FROM n WHERE content IS NOT NULL""")
def f_projection(spark, d):
    return nodes(spark, d, "content", "created_at").where("content is not null").select("id", text.preview(F.col("content")).alias("preview"), F.unix_seconds("created_at").alias("created"), text.token_estimate(F.col("content")).alias("tokens"))


# Enum algebra

_REVERSE = "CASE relation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in enums.REVERSE.items()) + " ELSE 'reverse_' || relation END"


@query(f"""WITH {E} SELECT relation, {_REVERSE} AS reversed, relation IN ('is_part_of', 'is_a', 'causes', 'located_at') AS transitive, relation IN ('similar_to', 'contradicts') AS symmetric,
relation NOT IN {enums.RELATIONS} AS custom, count(*) AS n FROM e GROUP BY relation""")
def enum_relations(spark, d):
    r = F.col("relation")
    e = edges(spark, d, "seq").groupBy("relation").agg(F.count("*").alias("n"))
    return e.select("relation", enums.reverse_relation(r).alias("reversed"), enums.is_transitive(r).alias("transitive"), enums.is_symmetric(r).alias("symmetric"), enums.is_custom_relation(r).alias("custom"), "n")


@query(f"WITH {E} SELECT target AS source, source AS target, {_REVERSE} AS relation, round(weight, 6) AS weight FROM e")
def enum_reverse_edges(spark, d):
    return enums.reverse_edges(edges(spark, d)).select("source", "target", "relation", F.round("weight", 6).alias("weight"))


@query(f"WITH {N} SELECT CASE WHEN source IN {enums.SOURCES} THEN source ELSE 'custom' END AS kind, coalesce(source IN {enums.AUTOMATED_SOURCES}, false) AS automated, node_type <> 'raw_chunk' AS structured, count(*) AS n FROM n GROUP BY ALL")
def enum_sources(spark, d):
    s = F.col("source")
    return nodes(spark, d, "source", "node_type").groupBy(enums.source_kind(s).alias("kind"), F.coalesce(enums.is_automated(s), F.lit(False)).alias("automated"), (~enums.is_raw(F.col("node_type"))).alias("structured")).agg(F.count("*").alias("n"))


# Query language and text search


@query(f"WITH {N} SELECT id, round(access_score, 6) AS access_score FROM n WHERE contains(lower(content), 'ledger') AND coalesce(confidence > 0.5, false)")
def paql_filter(spark, d):
    return paql.run("find ledger where confidence > 0.5", table(spark, d, "nodes"), versions=True).select("id", F.round("access_score", 6).alias("access_score"))


@query(f"WITH {N} SELECT id FROM n WHERE (coalesce(contains(lower(content), 'prompt'), false) OR coalesce(contains(lower(content), 'ledger'), false)) AND NOT coalesce(contains(lower(content), 'the'), false)")
def paql_boolean(spark, d):
    return paql.run("(prompt or ledger) and not the", table(spark, d, "nodes"), versions=True).select("id")


@query(f"WITH {N} SELECT id FROM n WHERE contains(lower(content), 'memory') AND (coalesce(node_type IN ('fact', 'concept'), false) AND coalesce(access_score >= 0.5, false)) ORDER BY confidence ASC NULLS LAST, id LIMIT 25")
def paql_sorted(spark, d):
    return paql.run("search for memory where node_type in (fact, concept) and access_score >= 0.5 sort by confidence asc limit 25", table(spark, d, "nodes"), versions=True).select("id")


@query(f"WITH {N}, m AS (SELECT count(*) AS n FROM n WHERE contains(lower(content), 'memory')) SELECT n AS total_count, least(n, 10) AS returned, n > 10 AS truncated FROM m")
def paql_summary(spark, d):
    return paql.result_summary("memory limit 10", nodes(spark, d))


@query(f"""WITH RECURSIVE {N}, {E}, {BUSY}, w AS (SELECT source AS f, target AS t FROM a WHERE source <> target UNION SELECT target, source FROM a WHERE source <> target),
r AS (SELECT id, 0 AS depth FROM busy UNION SELECT w.t, r.depth + 1 FROM r JOIN w ON w.f = r.id JOIN n ON n.id = w.t WHERE r.depth < 2)
SELECT id FROM n WHERE id IN (SELECT id FROM r WHERE id NOT IN (SELECT id FROM busy)) AND NOT coalesce(contains(lower(content), 'the'), false)""")
def paql_traversal(spark, d):
    start = busiest(spark, d)
    return paql.run(f"from {start} within 2 and not the", nodes(spark, d), edges(spark, d)).select("id")


# Graph


@query(f"WITH {N}, {E}, {BUSY}, x AS (SELECT target AS id, relation, weight FROM a WHERE source IN (FROM busy) UNION ALL SELECT source, relation, weight FROM a WHERE target IN (FROM busy)) SELECT id, relation, round(weight, 6) AS weight FROM x WHERE id IN (SELECT id FROM n)")
def g_neighbors(spark, d):
    e = graph.usable_edges(edges(spark, d))
    return graph.neighbors(e, nodes(spark, d, "updated_at"), busiest(spark, d), "both").select("id", "relation", F.round("weight", 6).alias("weight"))


def _bfs_sql(walk: str, depth: int, relation: str = "true") -> str:
    return f"""WITH RECURSIVE {N}, {E}, {BUSY}, w AS ({walk}), r AS (SELECT id, 0 AS depth FROM busy
UNION SELECT w.t, r.depth + 1 FROM r JOIN w ON w.f = r.id JOIN n ON n.id = w.t WHERE r.depth < {depth})
SELECT id, min(depth) AS depth FROM r WHERE id NOT IN (SELECT id FROM busy) GROUP BY id"""


@query(_bfs_sql("SELECT DISTINCT source AS f, target AS t FROM a WHERE source <> target", 3))
def g_bfs_forward(spark, d):
    e, ids = graph_tables(spark, d)
    return graph.bfs(e, ids, [busiest(spark, d, e, ids)], "forward", 3, None).select("id", "depth")


@query(_bfs_sql("SELECT source AS f, target AS t FROM a WHERE source <> target UNION SELECT target, source FROM a WHERE source <> target", 2))
def g_bfs_both(spark, d):
    e, ids = graph_tables(spark, d)
    return graph.bfs(e, ids, [busiest(spark, d, e, ids)], "both", 2, None).select("id", "depth")


@query(_bfs_sql("SELECT DISTINCT source AS f, target AS t FROM a WHERE source <> target AND relation IN ('causes', 'is_a')", 4))
def g_bfs_relations(spark, d):
    e, ids = graph_tables(spark, d)
    return graph.bfs(e, ids, [busiest(spark, d, e, ids)], "forward", 4, None, ["causes", "is_a"]).select("id", "depth")


@query(f"""WITH {N}, {E}, {BUSY}, hop AS (SELECT target AS id, min(seq) AS seq FROM a WHERE source IN (FROM busy) AND target <> source AND target IN (SELECT id FROM n) GROUP BY 1)
SELECT id, 1 AS depth, row_number() OVER (ORDER BY seq, id) AS place FROM hop""")
def g_bfs_capped(spark, d):
    """The soft cap lets the children of the first parent through whole."""
    e, ids = graph_tables(spark, d)
    return graph.bfs(e, ids, [busiest(spark, d, e, ids)], "forward", 3, 1).select("id", "depth", "place")


_QUIET = "quiet AS (SELECT source AS id FROM a WHERE source <> target AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) GROUP BY source HAVING count(DISTINCT target) BETWEEN 3 AND 9 ORDER BY source LIMIT 1)"


@query(f"""WITH RECURSIVE {N}, {E}, {_QUIET}, r AS (SELECT id, 0 AS depth FROM quiet UNION SELECT a.target, r.depth + 1 FROM r JOIN a ON a.source = r.id JOIN n ON n.id = a.target WHERE r.depth < 2 AND a.source <> a.target)
SELECT id, min(depth) AS depth FROM r WHERE id NOT IN (FROM quiet) GROUP BY id""")
def g_dfs(spark, d):
    """Within two steps a depth-first search finds what a breadth-first one does; the order is tested on small graphs."""
    e, ids = graph_tables(spark, d)
    live = e.where(~F.coalesce("expired", F.lit(False)) & (F.col("source") != F.col("target")))
    for side in ("source", "target"):
        live = live.join(ids.withColumnRenamed("id", side), side, "left_semi")
    row = live.groupBy("source").agg(F.countDistinct("target").alias("n")).where("n between 3 and 9").orderBy("source").first()
    return graph.dfs(e, ids, row.source if row else "", "forward", 2, 10_000).select("id", "depth")


def _far(spark, d, e, ids) -> tuple[str, str]:
    """The start, and the smallest node that is as far away as any within three steps."""
    start = busiest(spark, d, e, ids)
    row = graph.bfs(e, ids, [start], "forward", 3, None).orderBy(F.desc("depth"), "id").first()
    return start, row.id if row else start


_FAR = f"""{N}, {E}, {BUSY}, w AS (SELECT DISTINCT source AS f, target AS t FROM a WHERE source <> target AND target IN (SELECT id FROM n)),
r AS (SELECT id, 0 AS depth FROM busy UNION SELECT w.t, r.depth + 1 FROM r JOIN w ON w.f = r.id WHERE r.depth < 3),
goal AS (SELECT id FROM (SELECT id, min(depth) AS depth FROM r GROUP BY id) WHERE depth > 0 ORDER BY depth DESC, id LIMIT 1),
p AS (SELECT id AS here, [id] AS path FROM busy UNION ALL SELECT w.t, list_append(p.path, w.t) FROM p JOIN w ON w.f = p.here WHERE len(p.path) < 4 AND NOT list_contains(p.path, w.t))"""


@query(f"WITH RECURSIVE {_FAR} SELECT array_to_string(path, '/') AS path, len(path) - 1 AS hops FROM p WHERE here IN (FROM goal) ORDER BY len(path), path LIMIT 1")
def g_shortest_path(spark, d):
    e, ids = graph_tables(spark, d)
    return graph.shortest_path(e, ids, *_far(spark, d, e, ids), 5).select(F.array_join("path", "/").alias("path"), F.col("hops").cast("long").alias("hops"))


@query(f"WITH RECURSIVE {_FAR} SELECT array_to_string(path, '/') AS path FROM p WHERE here IN (FROM goal)")
def g_all_paths(spark, d):
    e, ids = graph_tables(spark, d)
    return graph.all_paths(e, ids, *_far(spark, d, e, ids), 4).select(F.array_join("path", "/").alias("path")).distinct()


@query(f"""WITH RECURSIVE {_FAR}, way AS (SELECT path FROM p WHERE here IN (FROM goal) ORDER BY len(path), path LIMIT 1),
one AS (SELECT source, target, o.relation AS relation, o.weight AS weight FROM (SELECT source, target, arg_min({{'relation': relation, 'weight': weight}}, seq) AS o FROM e GROUP BY 1, 2)),
steps AS (SELECT path, i, one.relation, one.weight FROM way, unnest(range(1, len(path))) AS u(i) JOIN one ON one.source = path[i] AND one.target = path[i + 1]),
lab AS (SELECT i, CASE WHEN length(n.content) > 20 THEN substring(n.content, 1, 17) || '...' ELSE n.content END AS label FROM way, unnest(range(1, len(path) + 1)) AS u(i) JOIN n ON n.id = path[i]),
said AS (SELECT steps.*, a1.label || ' ' || CASE relation {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in graph.EDGE_VERBS.items())} ELSE replace(relation, '_', ' ') END || ' ' || a2.label AS words
  FROM steps JOIN lab a1 ON a1.i = steps.i JOIN lab a2 ON a2.i = steps.i + 1)
SELECT array_to_string(any_value(path), '/') AS path, round(product(weight), 6) AS confidence, least(min(weight), 1e9) AS weakest, CASE WHEN bool_and(relation = 'causes') THEN 'causal' WHEN bool_and(relation IN ('is_part_of', 'is_a')) THEN 'hierarchical'
WHEN bool_and(relation = 'happened_after') THEN 'temporal' ELSE 'hybrid' END AS path_type, string_agg(words, ', which ' ORDER BY i) AS explanation FROM said""")
def g_explain(spark, d):
    e, ids = graph_tables(spark, d)
    start, end = _far(spark, d, e, ids)
    return graph.explain_relationship(e, nodes(spark, d, "content"), start, end).select(F.array_join("path", "/").alias("path"), F.round("confidence", 6).alias("confidence"), "weakest", "path_type", "explanation")


@query(f"""WITH {N}, {E}, one AS (SELECT source, target, o.relation AS relation, o.weight AS weight FROM (SELECT source, target, arg_min({{'relation': relation, 'weight': weight}}, seq) AS o FROM a GROUP BY 1, 2)),
p AS (SELECT x.source AS n1, x.target AS n2, y.target AS n3, x.weight * y.weight AS c, least(x.weight, y.weight) AS low,
  CASE WHEN x.relation = 'causes' AND y.relation = 'causes' THEN 'causal' WHEN x.relation IN ('is_part_of', 'is_a') AND y.relation IN ('is_part_of', 'is_a') THEN 'hierarchical'
  WHEN x.relation = 'happened_after' AND y.relation = 'happened_after' THEN 'temporal' ELSE 'hybrid' END AS kind
  FROM one x JOIN one y ON x.target = y.source WHERE x.weight BETWEEN 0 AND 1 AND y.weight BETWEEN 0 AND 1)
SELECT kind AS path_type, count(*) AS n, round(avg(c), 6) AS avg_confidence, round(avg(low), 6) AS avg_weakest FROM p GROUP BY 1""")
def g_two_step_paths(spark, d):
    """All two-step paths: number, mean confidence and mean weakest edge by type."""
    one = graph.edge_between(graph.usable_edges(edges(spark, d, "weight", "expired", "seq"))).where("weight between 0 and 1")
    return graph.two_step_summary(one).select("path_type", "n", F.round("avg_confidence", 6).alias("avg_confidence"), F.round("avg_weakest", 6).alias("avg_weakest"))


@query(f"""WITH {N}, {E}, {BUSY}, b AS (SELECT id FROM busy) SELECT source, target, relation FROM e WHERE source IN (FROM b) OR target IN (FROM b)""")
def g_subgraph_edges(spark, d):
    return graph.subgraph(edges(spark, d), nodes(spark, d, "updated_at"), [busiest(spark, d)], 1)[1].select("source", "target", "relation")


@query(f"""WITH {N}, {E}, {BUSY}, hop AS (SELECT DISTINCT target AS id FROM a WHERE source IN (FROM busy) AND target <> source AND target IN (SELECT id FROM n))
SELECT source, target, relation FROM a WHERE source IN (FROM hop)""")
def g_traverse_edges(spark, d):
    return graph.traverse(edges(spark, d), nodes(spark, d, "content", "updated_at"), busiest(spark, d), "forward", 1, 1)[1].select("source", "target", "relation")


# Vectors and retrieval

_Q = f"""{N}, u AS (SELECT id, embedding::DOUBLE[] AS v FROM n WHERE len(embedding) = 64),
q AS (SELECT v FROM u WHERE len(list_filter(v, lambda x: isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0 ORDER BY id LIMIT 1),
c0 AS (SELECT u.id, list_cosine_similarity(u.v, q.v) AS c FROM u, q), c AS (SELECT id, CASE WHEN c IS NULL OR isnan(c) OR isinf(c) THEN 0 ELSE c END AS c FROM c0)"""


@query(f"WITH {_Q} SELECT id, round(least(greatest(c, 0), 1), 6) AS score FROM c ORDER BY c DESC, id LIMIT 20")
def v_knn(spark, d):
    return vector_search.knn(nodes(spark, d, "embedding"), query_vector(spark, d), 20).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_Q} SELECT c.id, round(least(greatest(c, 0), 1), 6) AS score FROM c JOIN n USING (id) WHERE coalesce(n.node_type = 'fact', false) ORDER BY c DESC, id LIMIT 20")
def v_knn_filtered(spark, d):
    return vector_search.knn_filtered(nodes(spark, d, "embedding", "node_type"), query_vector(spark, d), filters.equals("node_type", "fact"), 20).select("id", F.round("score", 6).alias("score"))


def _fiftieth(spark, d) -> tuple[DataFrame, DataFrame]:
    """(usable vectors of all nodes, those of them whose row number by hash is divisible by 50): ids aren't numbers here."""
    fine = (F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    rows = materialize(nodes(spark, d, "embedding").where(fine), "vectors")
    return rows, rows.where(F.pmod(F.xxhash64("id"), F.lit(50)) == 0)


@query("SELECT true AS recall_ok")
def v_ivf(spark, d):
    """Recall at 10 of the index with its production parameters, for every fiftieth node against all, is at least 0.9."""
    rows, asked = _fiftieth(spark, d)
    found = vector_search.IVF(rows, vector_search.IndexParams("ivf")).search_many(asked, 10).select("query_id", "id")
    exact = vector_search.knn_many(rows, asked, 10).select("query_id", "id", F.lit(1).alias("exact"))
    return exact.join(found.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").agg((F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.sum("exact")).alias("recall_ok"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64), p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS c FROM v q, v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, id, round(c, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM p) WHERE rank <= 10""")
def v_knn_many(spark, d):
    """Every row whose id is divisible by 50 against all rows."""
    e = table(spark, d, "embeddings")
    return vector_search.knn_many(e, e.where("vec_id % 50 = 0"), 10, id_col="vec_id").select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


@query(f"WITH {_Q} SELECT x.id, round(list_cosine_similarity(x.v, y.v), 5) AS cosine FROM (SELECT n.id, n.chunk_index, n.document_id, v FROM n JOIN u USING (id)) x JOIN (SELECT n.chunk_index, n.document_id, v FROM n JOIN u USING (id)) y ON x.document_id = y.document_id AND y.chunk_index = x.chunk_index + 1 WHERE len(list_filter(x.v, lambda z: isnan(z))) = 0 AND len(list_filter(y.v, lambda z: isnan(z))) = 0 AND len(list_filter(x.v, lambda z: z <> 0)) > 0 AND len(list_filter(y.v, lambda z: z <> 0)) > 0")
def v_next_chunk(spark, d):
    """Cosine of each chunk with the next one of its document."""
    fine = lambda c: (F.size(c) == 64) & F.forall(c, lambda x: ~F.isnan(x)) & F.exists(c, lambda x: x != 0)
    n = nodes(spark, d, "embedding", "document_id", "chunk_index").where(fine(F.col("embedding")))
    nxt = n.select("document_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("embedding").alias("other"))
    return n.join(nxt, ["document_id", "chunk_index"]).select("id", F.round(cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query(f"WITH {_Q} SELECT id, round(0.6 * c + 0.4, 6) AS score FROM c WHERE c >= 0.2 ORDER BY 0.6 * c + 0.4 DESC, id LIMIT 15")
def rag_vector(spark, d):
    cfg = rag.RetrievalConfig(mode="vector", min_relevance=0.2, max_vector_results=15)
    return rag.vector_retrieve(nodes(spark, d, "embedding"), query_vector(spark, d), cfg).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {_Q}, {E}, sim AS (SELECT id, c FROM c WHERE c > 0.25), top AS (SELECT id, c FROM sim ORDER BY c DESC, id LIMIT 10), seeds AS (SELECT id FROM top ORDER BY c DESC, id LIMIT 5),
w AS (SELECT source AS f, target AS t FROM a WHERE source <> target UNION SELECT target, source FROM a WHERE source <> target),
r AS (SELECT id, 0 AS depth FROM seeds UNION SELECT w.t, r.depth + 1 FROM r JOIN w ON w.f = r.id JOIN n ON n.id = w.t WHERE r.depth < 2),
near AS (SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0),
g AS (SELECT id, depth, 0.4 * 0.5 ** depth AS score FROM near WHERE id NOT IN (SELECT id FROM sim) ORDER BY score DESC, id LIMIT 20)
SELECT id, 0 AS hop_distance, true AS is_direct_match, round(0.6 * c + 0.4, 6) AS score FROM top UNION ALL SELECT id, depth, false, round(score, 6) FROM g""")
def rag_hybrid(spark, d):
    cfg = rag.RetrievalConfig(min_relevance=0.0, direct_threshold=0.25)
    return rag.hybrid_retrieve(nodes(spark, d, "embedding"), edges(spark, d, "expired", "seq"), query_vector(spark, d), cfg).select("id", "hop_distance", "is_direct_match", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {N}, {E}, {BUSY}, w AS (SELECT source AS f, target AS t FROM a WHERE source <> target UNION SELECT target, source FROM a WHERE source <> target),
r AS (SELECT id, 0 AS depth FROM busy UNION SELECT w.t, r.depth + 1 FROM r JOIN w ON w.f = r.id JOIN n ON n.id = w.t WHERE r.depth < 2),
near AS (SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0) SELECT id, depth AS hop_distance, round(0.4 * 0.5 ** depth, 6) AS score FROM near ORDER BY score DESC, id LIMIT 20""")
def rag_seeds(spark, d):
    cfg = rag.RetrievalConfig(mode="graph", min_relevance=0.05)
    return rag.retrieve_from_seeds(nodes(spark, d, "updated_at"), edges(spark, d, "expired", "seq"), [busiest(spark, d)], cfg).select("id", "hop_distance", F.round("score", 6).alias("score"))


@query(f"""WITH {N}, {E}, {BUSY}, w AS (SELECT source AS f, target AS t, weight FROM a WHERE weight >= 0.3 UNION ALL SELECT target, source, weight FROM a WHERE weight >= 0.3),
h1 AS (SELECT t AS id, max(weight) AS weight FROM w WHERE f IN (FROM busy) AND t NOT IN (FROM busy) GROUP BY 1)
SELECT id, 0 AS hop, 1.0 AS weight, 0.9 AS score FROM busy UNION ALL SELECT id, 1, round(weight, 6), round((0.7 * 0.9 + 0.3 * weight) * 0.9, 6) FROM h1""")
def rag_expand(spark, d):
    seeds = spark.createDataFrame([(busiest(spark, d), 0.9)], "id string, score double")
    out = rag.expand(seeds, edges(spark, d, "weight", "expired", "seq"), 1, 0.3, None, None)
    return out.select("id", "hop", F.round("weight", 6).alias("weight"), F.round("score", 6).alias("score"))


def _scored(spark, d) -> DataFrame:
    """All nodes with content and a score."""
    return nodes(spark, d, "content", "node_type", "access_score").where("content is not null and access_score is not null and not isnan(access_score)").select("id", "content", "node_type", F.col("access_score").alias("score"), F.lit(0).alias("hop_distance"))


def _retrieved(spark, d) -> DataFrame:
    """A retrieval result to put into a format; its top_k is the feature."""
    hits = rag.vector_retrieve(nodes(spark, d, "embedding"), query_vector(spark, d), rag.RetrievalConfig(mode="vector", min_relevance=0.0, max_vector_results=30))
    return hits.join(nodes(spark, d, "content", "node_type").where("content is not null"), "id").select("id", "content", "node_type", "score", "hop_distance")


_ALL = f"{N}, x AS (SELECT id, content, access_score AS score, row_number() OVER (ORDER BY access_score DESC, id) AS r FROM n WHERE content IS NOT NULL AND access_score IS NOT NULL)"
_HITS = f"{_Q}, top AS (SELECT id, 0.6 * c + 0.4 AS score FROM c WHERE c >= 0 ORDER BY c DESC, id LIMIT 30), x AS (SELECT n.id, content, node_type, score, row_number() OVER (ORDER BY score DESC, n.id) AS r FROM top JOIN n USING (id) WHERE content IS NOT NULL)"


def _shown(line: str, between: str, head: str = "''") -> str:
    return f"WITH {_HITS} SELECT {head} || string_agg({line}, {between} ORDER BY r) AS context FROM x"


_NL = "chr(10)"


@query(f"WITH {_ALL}, y AS (SELECT id, r, sum(strlen(content) // 4) OVER (ORDER BY r) AS t FROM x) SELECT id, t::BIGINT AS context_tokens FROM y WHERE t <= 100000")
def rag_fit_context(spark, d):
    return rag.fit_context(_scored(spark, d), 100_000).select("id", "context_tokens")


@query(_shown("'[' || r || '] ' || content || ' (relevance: ' || printf('%.2f', score) || ')'", f"{_NL} || {_NL}"))
def fm_default(spark, d):
    return rag.format_context(_retrieved(spark, d), "default")


@query(f"WITH {_HITS} SELECT string_agg(content, ' ' ORDER BY r) AS context FROM x WHERE content <> ''")
def fm_compact(spark, d):
    return rag.format_context(_retrieved(spark, d), "compact")


@query(f"WITH {_HITS} SELECT string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS context FROM x WHERE content <> ''")
def fm_flat(spark, d):
    return rag.format_context(_retrieved(spark, d), "flat")


@query(_shown(f"'[' || r || ']' || {_NL} || 'Relevance: ' || printf('%.2f', score) || {_NL} || 'Type: ' || node_type || {_NL} || 'Distance: 0' || {_NL} || 'Content: ' || content", f"{_NL} || {_NL}", f"'=== Context ===' || {_NL} || {_NL}"))
def fm_structured(spark, d):
    return rag.format_context(_retrieved(spark, d), "structured")


@query(_shown(f"'### ' || r || '. ' || CASE WHEN length(content) > 60 THEN substring(content, 1, 57) || '...' ELSE content END || {_NL} || {_NL} || '**Relevance:** ' || printf('%.2f', score) || {_NL} || {_NL} || '**Type:** ' || node_type || {_NL} || {_NL} || content", f"{_NL} || {_NL}", f"'## Context' || {_NL} || {_NL}"))
def fm_markdown(spark, d):
    return rag.format_context(_retrieved(spark, d), "markdown")


@query(f"WITH {_HITS} SELECT r AS rank, id, content, node_type, round(score, 6) AS score, 0 AS hop_distance FROM x")
def fm_json(spark, d):
    """The JSON context read again, so that values are compared and not spacing."""
    text = rag.format_context(_retrieved(spark, d), "json")
    items = text.select(F.posexplode(F.from_json("context", "array<struct<id:string,content:string,node_type:string,score:double,hop_distance:int>>")).alias("at", "x"))
    return items.select((F.col("at") + 1).cast("long").alias("rank"), "x.*")


@query(f"WITH {_ALL}, z AS (SELECT id, row_number() OVER (PARTITION BY substring(content, 1, 50) ORDER BY score DESC, id) AS k FROM x) SELECT id FROM z WHERE k = 1")
def rag_compress_dedup(spark, d):
    return rag.compress(_scored(spark, d), 1, "deduplicate").select("id")


@query(f"WITH {_ALL} SELECT id FROM x WHERE r <= (SELECT count(*) // 2 FROM x)")
def rag_compress_top(spark, d):
    return rag.compress(_scored(spark, d), 1, "top_only").select("id")


@query(f"WITH {_ALL} SELECT id FROM x WHERE r > (SELECT count(*) // 2 FROM x)")
def rag_removed(spark, d):
    rows = materialize(_scored(spark, d), "scored")
    return rag.removed(rows, rag.compress(rows, 1, "cluster_summary"))


@query(f"WITH {N} SELECT 'document' AS level, count(*) AS n FROM n WHERE node_type IN ('entity', 'concept') UNION ALL SELECT 'paragraph', count(*) FROM n WHERE node_type IN ('entity', 'concept', 'fact') UNION ALL SELECT 'sentence', count(*) FROM n WHERE node_type IN ('entity', 'concept', 'fact', 'raw_chunk')")
def rag_levels(spark, d):
    n = nodes(spark, d, "node_type")
    counts = [rag.level_filter(n, level).agg(F.lit(level).alias("level"), F.count("*").alias("n")) for level in rag.LEVELS]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# Aggregates of the store


@query(f"WITH {N}, {E} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n WHERE len(embedding) > 0) AS embedded, (SELECT count(*) FROM n WHERE node_type IN {enums.NODE_TYPES}) AS typed, (SELECT count(*) FROM e) AS edges")
def a_database_stats(spark, d):
    return mutations.database_stats(nodes(spark, d, "embedding", "node_type"), edges(spark, d, "seq"))


@query(f"WITH {N} SELECT node_type, source, count(*) AS n FROM n GROUP BY CUBE (node_type, source)")
def a_type_cube(spark, d):
    return mutations.type_source_cube(nodes(spark, d, "node_type", "source")).select("node_type", "source", "n")


@query(f"WITH {E} SELECT relation, count(*) AS n, round(avg(weight), 6) AS avg_weight, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM e GROUP BY 1")
def a_relations(spark, d):
    return edges(spark, d, "weight", "seq").groupBy("relation").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("avg_weight"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"))


# Memory

_SCORE = f"CASE WHEN accessed_at IS NULL THEN access_score ELSE least(greatest(access_score * exp(-0.0015 * {HOURS}), 0.1), 10) END"


@query(f"""WITH {N} SELECT id, round({_SCORE}, 6) AS current, round(CASE WHEN accessed_at IS NULL THEN access_score ELSE access_score * exp(-0.0015 * floor({HOURS})) END, 6) AS decayed FROM n WHERE access_score IS NOT NULL""")
def md_scores(spark, d):
    n = nodes(spark, d, "access_score", "accessed_at").where("access_score is not null")
    s, a = F.col("access_score"), F.col("accessed_at")
    return n.select("id", F.round(decay.current_score(s, a, as_of()), 6).alias("current"), F.round(decay.node_decayed(s, a, as_of()), 6).alias("decayed"))


@query(f"""WITH {N}, h AS (SELECT id, floor({HOURS}) AS t FROM n WHERE accessed_at IS NOT NULL) SELECT id, round(exp(-0.0015 * t), 6) AS ebbinghaus, round(CASE WHEN t <= 1 THEN 1 ELSE t ** -0.5 END, 6) AS power_law, round(1 / (1 + 0.01 * t), 6) AS hyperbolic FROM h""")
def md_retention(spark, d):
    n = nodes(spark, d, "accessed_at").where("accessed_at is not null").select("id", decay.whole_hours(F.col("accessed_at"), as_of()).alias("t"))
    return n.select("id", *(F.round(decay.retention(F.col("t"), c), 6).alias(c) for c in ("ebbinghaus", "power_law", "hyperbolic")))


@query(f"""WITH {N} SELECT id, round(-ln(confidence) / 0.0015, 4) AS standard, round(-ln(confidence) / (0.0015 / (1 + ln(1 + chunk_index))), 4) AS repeated FROM n WHERE confidence > 0 AND confidence < 1 AND chunk_index IS NOT NULL""")
def md_time_to_threshold(spark, d):
    n = nodes(spark, d, "confidence", "chunk_index").where("confidence > 0 and confidence < 1 and chunk_index is not null")
    c = F.col("confidence")
    return n.select("id", F.round(decay.time_to_threshold(c, decay.curve_rate("standard")), 4).alias("standard"), F.round(decay.time_to_threshold(c, decay.curve_rate("with_repetition", F.col("chunk_index"))), 4).alias("repeated"))


@query(f"""WITH RECURSIVE l AS (SELECT log_id, any_value(lower(trim(node_id))) AS node_id, any_value(ts) AS ts, any_value(coalesce(boost, 1)) AS boost FROM access_log WHERE node_id IS NOT NULL AND ts <= TIMESTAMPTZ '{AS_OF}+00' GROUP BY log_id),
o AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ts, log_id) AS k FROM l),
f AS (SELECT node_id, k, ts, least(greatest(1.0 + 0.5 * boost, 0.1), 10.0)::DOUBLE AS score FROM o WHERE k = 1
 UNION ALL SELECT o.node_id, o.k, o.ts, least(greatest(least(greatest(f.score * exp(-0.002 * (epoch_us(o.ts) - epoch_us(f.ts)) / 3.6e9), 0.1), 10.0) + 0.5 * o.boost, 0.1), 10.0) FROM f JOIN o ON o.node_id = f.node_id AND o.k = f.k + 1)
SELECT node_id, round(arg_max(score, k), 5) AS score, max(k) AS accesses FROM f GROUP BY 1""")
def md_fold_access(spark, d):
    return memory.fold_access(table(spark, d, "access_log"), as_of(), SLOW).select("node_id", F.round("score", 5).alias("score"), "accesses")


@query(f"""WITH l AS (SELECT log_id, any_value(lower(trim(node_id))) AS node_id, any_value(ts) AS ts FROM access_log WHERE node_id IS NOT NULL AND ts <= TIMESTAMPTZ '{AS_OF}+00' GROUP BY log_id)
SELECT log_id, node_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY node_id ORDER BY ts, log_id))) / 3.6e9, 6) AS gap_hours FROM l""")
def md_access_gaps(spark, d):
    return memory.access_gaps(table(spark, d, "access_log"), as_of()).select("log_id", "node_id", F.round("gap_hours", 6).alias("gap_hours"))


@query(f"""WITH {N}, x AS (SELECT {_SCORE} AS s FROM n) SELECT count(*) AS total, count(*) FILTER (WHERE s >= 0.5) AS active, count(*) - count(*) FILTER (WHERE s >= 0.5) AS decayed,
round(avg(s), 6) AS average_score, round(count(*) FILTER (WHERE s >= 0.5) / count(*), 6) AS load_factor FROM x""")
def md_stats(spark, d):
    s = memory.memory_stats(nodes(spark, d, "access_score", "accessed_at"), as_of(), active_from=0.5)
    return s.select("total", "active", "decayed", F.round("average_score", 6).alias("average_score"), F.round("load_factor", 6).alias("load_factor"))


@query(f"WITH {N} SELECT id, round(CASE WHEN accessed_at IS NULL THEN access_score ELSE access_score * exp(-0.0015 * {HOURS}) END, 6) AS score FROM n WHERE CASE WHEN accessed_at IS NULL THEN access_score ELSE access_score * exp(-0.0015 * {HOURS}) END < 0.1")
def md_prune(spark, d):
    return memory.prunable(nodes(spark, d, "access_score", "accessed_at"), as_of()).select("id", F.round("score", 6).alias("score"))


# Texts and chunks

_SENT = r"regexp_replace(text, '([.!?])( |\n|$)', '\1' || chr(1) || '\2', 'g')"


@query(f"WITH x AS (SELECT doc_id, list_filter(list_transform(string_split({_SENT}, chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS l FROM documents) SELECT doc_id, len(l) AS sentences, list_sum(list_transform(l, lambda s: length(s)))::BIGINT AS characters FROM x")
def ch_sentences(spark, d):
    s = text.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s.alias("l")).select("doc_id", F.size("l").cast("long").alias("sentences"), F.when(F.size("l") > 0, F.aggregate(F.transform("l", lambda x: F.length(x).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)).alias("characters"))


@query("WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS l FROM documents) SELECT doc_id, len(l) AS paragraphs, l[1] AS first FROM x")
def ch_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", text.paragraphs(F.col("text")).alias("l")).select("doc_id", F.size("l").cast("long").alias("paragraphs"), F.get("l", F.lit(0)).alias("first"))


@query("""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda x: x <> '')) AS a,
list_distinct(list_filter(string_split_regex(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda x: x <> '')) AS b FROM documents WHERE title IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM w""")
def ch_title_jaccard(spark, d):
    t = table(spark, d, "documents").where("title is not null and text is not null")
    return t.select("doc_id", F.round(text.jaccard(text.words(F.col("text")), text.words(F.col("title"))), 6).alias("jaccard"))


_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_STOP = "CASE WHEN least({st} + 1000, n) >= n THEN n ELSE (SELECT CASE WHEN nl > {st} + 100 THEN nl WHEN sp > {st} + 100 THEN sp ELSE e END FROM (SELECT {st} + 1000 AS e, CASE WHEN instr(substring(s, {st} + 901, 100), chr(10)) > 0 THEN {st} + 900 + instr(substring(s, {st} + 901, 100), chr(10)) ELSE 0 END AS nl, CASE WHEN instr(reverse(substring(s, {st} + 2, 999)), ' ') > 0 THEN {st} + 1000 - instr(reverse(substring(s, {st} + 2, 999)), ' ') ELSE 0 END AS sp)) END"
_FIXED = f"""t AS (SELECT doc_id, document_id, {_TRIM} AS s, length({_TRIM}) AS n FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, 0 AS idx, 0::BIGINT AS st, {_STOP.format(st="0")} AS en FROM t WHERE n > 0
  UNION ALL SELECT doc_id, idx + 1, nx, {_STOP.format(st="nx")} FROM (SELECT w.doc_id, w.idx, CASE WHEN w.en + 900 < t.n THEN w.en - 100 ELSE w.en END AS nx, t.s, t.n FROM w JOIN t ON t.doc_id = w.doc_id WHERE w.en < t.n))"""


@query(f"WITH RECURSIVE {_FIXED} SELECT w.doc_id, idx, st::INT AS range_start, en::INT AS range_end, substring(s, st + 1, en - st) AS content FROM w JOIN t ON t.doc_id = w.doc_id")
def ch_fixed(spark, d):
    return chunking.chunk_fixed(table(spark, d, "documents"), "doc_id", "text").where("error is null").select("doc_id", "idx", "range_start", "range_end", "content")


def _semantic_sql(least: int, most: int, threshold: float) -> str:
    """Sentences with their bags of words, cuts by similarity, then groups by a walk over the sentences."""
    words = r"list_distinct(list_filter(string_split_regex(x, '\s+'), lambda y: y <> ''))"
    bag = lambda lo, hi: f"list_distinct(flatten([{lo}, {hi}]))"
    return rf"""src AS (SELECT doc_id, {_TRIM} AS s FROM documents WHERE text IS NOT NULL),
parts AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(s, '([.!?])( |\n|$)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM src WHERE s <> '' AND strlen(s) >= {least}),
sent AS (SELECT doc_id, i, l[i] AS x, strlen(l[i]) AS size, {words.replace("(x,", "(l[i],")} AS bag FROM parts, unnest(range(1, len(l) + 1)) AS u(i)),
near AS (SELECT a.doc_id, a.i, {bag("coalesce(b2.bag, [])", "b1.bag")} AS before, {bag("a.bag", "coalesce(a2.bag, [])")} AS after FROM sent a JOIN sent b1 ON b1.doc_id = a.doc_id AND b1.i = a.i - 1 LEFT JOIN sent b2 ON b2.doc_id = a.doc_id AND b2.i = a.i - 2 LEFT JOIN sent a2 ON a2.doc_id = a.doc_id AND a2.i = a.i + 1),
cut AS (SELECT doc_id, i FROM near WHERE CASE WHEN len(before) = 0 OR len(after) = 0 THEN 0 ELSE len(list_intersect(before, after)) / len({bag("before", "after")}) END < {threshold}),
marked AS (SELECT sent.*, cut.i IS NOT NULL AS edge FROM sent LEFT JOIN cut USING (doc_id, i)),
walk AS (SELECT doc_id, i, 0 AS idx, size FROM marked WHERE i = 1
  UNION ALL SELECT m.doc_id, m.i, CASE WHEN w.size >= {least} AND (w.size + m.size > {most} OR m.edge) THEN w.idx + 1 ELSE w.idx END, CASE WHEN w.size >= {least} AND (w.size + m.size > {most} OR m.edge) THEN m.size ELSE w.size + m.size END FROM walk w JOIN marked m ON m.doc_id = w.doc_id AND m.i = w.i + 1),
grouped AS (SELECT walk.doc_id, idx, string_agg(x, ' ' ORDER BY walk.i) AS content FROM walk JOIN sent USING (doc_id, i) GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_semantic_sql(100, 1000, 0.3)} SELECT doc_id, idx, content FROM grouped")
def ch_semantic(spark, d):
    return chunking.chunk_semantic(table(spark, d, "documents"), "doc_id", "text").where("error is null").select("doc_id", "idx", "content")


@query(rf"""WITH RECURSIVE {_semantic_sql(100, 1000, 0.3)}, cutup AS (SELECT doc_id, idx, list_filter(list_transform(string_split(regexp_replace(content, '([.!?])( |
|$)', '' || chr(1) || '', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM grouped)
SELECT doc_id, 0 AS level, 1 AS pieces, (SELECT min(length(s)) FROM src WHERE src.doc_id = grouped.doc_id) AS characters FROM grouped GROUP BY doc_id UNION ALL SELECT doc_id, 1, count(*), sum(length(content)) FROM grouped GROUP BY doc_id
UNION ALL SELECT doc_id, 2, NULL, sum(list_sum(list_transform(l, lambda x: length(x)))) FROM cutup GROUP BY doc_id""")
def ch_hierarchical(spark, d):
    """By document and level: pieces, and how much text they hold (the document itself: its length)."""
    rows = chunking.chunk_hierarchical(table(spark, d, "documents"), "doc_id", "text").where("error is null")
    long = F.when(F.col("level") == 0, F.col("range_end")).otherwise(F.length("content"))
    return rows.groupBy("doc_id", "level").agg(F.when(F.first("level") < 2, F.count("*")).alias("pieces"), F.sum(long).alias("characters"))


@query(f"WITH RECURSIVE {_FIXED} SELECT lower(trim(document_id)) || '#' || idx AS source, lower(trim(document_id)) AS target, 'is_part_of' AS relation, idx::BIGINT AS seq FROM w JOIN t ON t.doc_id = w.doc_id")
def ch_ingest_edges(spark, d):
    docs = table(spark, d, "documents").select(norm_id("document_id").alias("document_id"), "title", "text")
    return chunking.ingest_documents(docs, AS_OF, "fixed")[1].select("source", "target", "relation", "seq")


@query(f"WITH RECURSIVE {_FIXED} SELECT lower(trim(document_id)) AS id, 'concept' AS node_type, coalesce(title, '') || ': ' || coalesce(text, '') AS content FROM documents UNION ALL SELECT lower(trim(document_id)) || '#' || idx, 'raw_chunk', substring(s, st + 1, en - st) FROM w JOIN t ON t.doc_id = w.doc_id")
def ch_ingest_nodes(spark, d):
    docs = table(spark, d, "documents").select(norm_id("document_id").alias("document_id"), "title", "text")
    return chunking.ingest_documents(docs, AS_OF, "fixed")[0].select("id", "node_type", "content")


# Traces


@query(f"WITH {S} SELECT name, count(*) AS invocations, count(*) FILTER (WHERE status = 'completed') AS successes, count(*) FILTER (WHERE status <> 'completed') AS failures, round(avg(duration_ms), 6) AS avg_ms, round(sum(duration_ms), 4) AS total_ms, round(count(*) FILTER (WHERE status = 'completed') / count(*), 6) AS success_rate FROM t WHERE duration_ms IS NOT NULL GROUP BY 1")
def tr_stats(spark, d):
    s = traces.stats_by_name(spans(spark, d))
    return s.select("name", "invocations", "successes", "failures", F.round("avg_ms", 6).alias("avg_ms"), F.round("total_ms", 4).alias("total_ms"), F.round("success_rate", 6).alias("success_rate"))


@query(f"WITH {S}, o AS (SELECT name, list_sort(list(duration_ms)) AS l, count(*) AS n FROM t WHERE duration_ms IS NOT NULL GROUP BY 1) SELECT name, " + ", ".join(f"l[least(floor(n * {p}), n - 1)::BIGINT + 1] AS p{round(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM o")
def tr_percentiles(spark, d):
    return traces.index_percentiles(spans(spark, d), ["name"])


@query(f"WITH {S} SELECT coalesce(nullif(string_split_regex(regexp_replace(error, '^\\s+|\\s+$', '', 'g'), '\\s+')[1], ''), 'unknown') AS error_type, count(*) AS n FROM t WHERE status = 'failed' GROUP BY 1")
def tr_errors(spark, d):
    return traces.errors_by_type(spans(spark, d))


@query(f"WITH {S} SELECT time_bucket(INTERVAL 1 DAY, start_time) AS window_start, count(*) AS spans, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, round(avg(duration_ms), 6) AS avg_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms FROM t GROUP BY 1")
def tr_windows(spark, d):
    return traces.window_stats(spans(spark, d)).select("window_start", "spans", "completed", "failed", F.round("avg_ms", 6).alias("avg_ms"), "min_ms", "max_ms")


@query(f"""WITH {S}, m AS (SELECT name, start_time, CASE WHEN start_time - lag(start_time) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY name ORDER BY start_time)),
g AS (SELECT name, start_time, sum(fresh) OVER (PARTITION BY name ORDER BY start_time ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT name, min(start_time) AS session_start, max(start_time) + INTERVAL 1 HOUR AS session_end, count(*) AS spans FROM g GROUP BY name, k""")
def tr_sessions(spark, d):
    return traces.session_stats(spans(spark, d)).select("name", "session_start", "session_end", "spans")


@query(f"WITH {S} SELECT count(*) AS created, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE end_time IS NULL) AS open, round(count(*) FILTER (WHERE status = 'completed') / count(*) FILTER (WHERE status IN ('completed', 'failed')), 6) AS success_rate FROM t")
def tr_collector(spark, d):
    return traces.collector_stats(spans(spark, d)).withColumn("success_rate", F.round("success_rate", 6))


@query(f"WITH {S} SELECT 'enter' AS event_type, count(*) AS n FROM t UNION ALL SELECT CASE WHEN status = 'failed' THEN 'error' WHEN status = 'cancelled' THEN 'cancel' ELSE 'exit' END, count(*) FROM t WHERE end_time IS NOT NULL GROUP BY 1")
def tr_events(spark, d):
    return traces.events_by_type(traces.trace_events(spans(spark, d)))


@query(f"WITH {S} SELECT p.span_id AS parent, c.span_id AS child, p.name AS parent_name, c.name AS child_name FROM t c JOIN t p ON c.parent_id = p.span_id")
def tr_parent_child(spark, d):
    return traces.children_by_parent(spans(spark, d))


@query(f"""WITH RECURSIVE {S}, x AS (SELECT c.span_id, c.span_id AS root_id, 0 AS depth FROM t c LEFT JOIN t p ON p.span_id = c.parent_id WHERE p.span_id IS NULL UNION ALL SELECT t.span_id, x.root_id, x.depth + 1 FROM x JOIN t ON t.parent_id = x.span_id)
SELECT root_id, count(*) AS span_count, max(depth) + 1 AS max_depth FROM x GROUP BY 1""")
def tr_lifecycle_stats(spark, d):
    return traces.lifecycle_stats(traces.lifecycle(spans(spark, d)))


_TREE = f"""{S}, x AS (SELECT c.span_id, c.span_id AS root_id, 0 AS depth FROM t c LEFT JOIN t p ON p.span_id = c.parent_id WHERE p.span_id IS NULL UNION ALL SELECT t.span_id, x.root_id, x.depth + 1 FROM x JOIN t ON t.parent_id = x.span_id)"""


@query(f"""WITH RECURSIVE {_TREE} SELECT root_id, '    N' || replace(parent_id, '-', '') || ' --> N' || replace(span_id, '-', '') || '["' || name || '"]' AS line FROM x JOIN t USING (span_id) WHERE depth > 0""")
def tr_mermaid_lines(spark, d):
    return traces.mermaid_lines(traces.lifecycle(spans(spark, d))).select("root_id", "line")


@query(f"""WITH RECURSIVE {_TREE} SELECT root_id, repeat('  ', depth) || name || ' [' || coalesce(status, 'open') || ']' AS line FROM x JOIN t USING (span_id)""")
def tr_text_lines(spark, d):
    return traces.text_lines(traces.lifecycle(spans(spark, d))).select("root_id", "line")


@query(f"""WITH RECURSIVE {_TREE} SELECT root_id, span_id, name, depth FROM x JOIN t USING (span_id)""")
def tr_json_lines(spark, d):
    tree = traces.lifecycle(spans(spark, d))
    return traces.json_lines(tree.where("not in_loop")).select("root_id", "span_id", F.get_json_object("json", "$.name").alias("name"), F.get_json_object("json", "$.depth").cast("int").alias("depth"))


@query(f"WITH {S} SELECT name, round(avg(duration_ms), 6) AS avg_ms FROM t WHERE duration_ms IS NOT NULL GROUP BY 1 ORDER BY avg(duration_ms) DESC, name LIMIT 5")
def tr_top(spark, d):
    return traces.top_spans(traces.stats_by_name(spans(spark, d)), "avg_ms", 5).select("name", F.round("avg_ms", 6).alias("avg_ms"))


# Changes


@query(f"""WITH {N} SELECT CASE WHEN content IS NULL OR regexp_replace(content, '\\s', '', 'g') = '' THEN 'empty content' WHEN strlen(content) > 10485760 THEN 'content too long' WHEN node_type NOT IN {enums.NODE_TYPES} THEN 'unknown node type'
WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence out of range' WHEN NOT coalesce(access_score >= 0, false) THEN 'access score out of range' ELSE 'ok' END AS outcome, count(*) AS n FROM n GROUP BY 1""")
def mu_validate_nodes(spark, d):
    v = mutations.validate_nodes(nodes(spark, d, "content", "node_type", "confidence", "access_score"))
    return v.groupBy(F.coalesce("problem", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""WITH {N}, {E} SELECT CASE WHEN source NOT IN (SELECT id FROM n) THEN 'source not found' WHEN target NOT IN (SELECT id FROM n) THEN 'target not found' WHEN source = target THEN 'self loop'
WHEN NOT coalesce(weight BETWEEN 0 AND 1, false) THEN 'weight out of range' ELSE 'ok' END AS outcome, count(*) AS n FROM e GROUP BY 1""")
def mu_validate_edges(spark, d):
    v = mutations.validate_edges(edges(spark, d, "weight", "seq"), nodes(spark, d, "updated_at"))
    return v.groupBy(F.coalesce("problem", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {E} SELECT source, target, relation, seq FROM a")
def mu_fold_edges(spark, d):
    """The edge table as a change log: an expired row deletes its triple."""
    raw = table(spark, d, "edges")
    log = raw.select(norm_id("source").alias("source"), norm_id("target").alias("target"), norm_name("relation").alias("relation"), "weight", F.when(F.coalesce("expired", F.lit(False)), F.lit("delete")).otherwise(F.lit("put")).alias("op"), "seq")
    base = log.select("source", "target", "relation", "weight").limit(0)
    last = log.groupBy("source", "target", "relation").agg(F.max("seq").alias("seq"))
    kept = mutations.fold_changes(base, log, ["source", "target", "relation"])
    return kept.join(last, ["source", "target", "relation"]).select("source", "target", "relation", "seq")


@query(f"WITH {N}, {E}, gone AS (SELECT id FROM n WHERE node_type = 'entity') SELECT source, target, relation FROM e WHERE source NOT IN (FROM gone) AND target NOT IN (FROM gone)")
def mu_delete_cascade(spark, d):
    n = nodes(spark, d, "node_type")
    return mutations.delete_nodes(n, edges(spark, d, "seq"), n.where("node_type = 'entity'"))[1].select("source", "target", "relation")


@query(f"WITH {N} SELECT id, document_id FROM n WHERE document_id IS NOT NULL AND lower(trim(document_id)) NOT IN (SELECT lower(trim(document_id)) FROM documents WHERE document_id IS NOT NULL)")
def mu_orphan_chunks(spark, d):
    docs = table(spark, d, "documents").select(normal_id(F.col("document_id")).alias("k"))
    n = nodes(spark, d, "document_id").where("document_id is not null").withColumn("k", norm_id("document_id"))
    return n.join(docs, "k", "left_anti").select("id", "document_id")
