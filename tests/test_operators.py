"""Operators that SQL doesn't reach: order, storage, brute force on small fixtures, dirty input."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import text, vector
from memloom.operators import chunking, filters, graph, memory, mutations, paql, rag, traces, vector_search
from memloom.sources.tables import current_nodes, current_rows

EDGE = "source string, target string, relation string, weight double, expired boolean, seq long"


def brute_dfs(edges, start, depth, most):
    near = {}
    for s, t, q in sorted(((s, t, q) for s, t, q in edges if s != t), key=lambda x: (x[2], x[1])):
        near.setdefault(s, [])
        if t not in near[s]:
            near[s].append(t)
    seen, out, stack = {start}, [], [(start, 0)]
    while stack and len(out) < most:
        node, d = stack.pop()
        if d >= depth:
            continue
        fresh = []
        for t in near.get(node, []):
            if t not in seen and len(out) < most:
                seen.add(t)
                fresh.append((t, d + 1))
                out.append((t, d + 1))
        stack.extend(reversed(fresh))
    return out


@pytest.mark.parametrize("depth,most", [(2, 100), (4, 100), (3, 7)])
def test_depth_first_order(spark, depth, most):
    r = random.Random(depth)
    edges = [(f"n{r.randrange(25)}", f"n{r.randrange(25)}", i) for i in range(70)]
    e = spark.createDataFrame([(s, t, "causes", 1.0, False, q) for s, t, q in edges], EDGE)
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(25)], "id string")
    start = edges[0][0]
    got = [(x.id, x.depth) for x in graph.dfs(e, nodes, start, "forward", depth, most).orderBy("place").collect()]
    assert got == brute_dfs(edges, start, depth, most)
    assert graph.dfs(e, nodes, "missing").collect() == []


def test_two_step_summary(spark):
    r = random.Random(2)
    kinds = ["causes", "is_a", "is_part_of", "happened_after", "similar_to"]
    rows = list({(f"n{r.randrange(9)}", f"n{r.randrange(9)}"): (r.choice(kinds), r.randrange(0, 11) / 10) for _ in range(60)}.items())
    e = spark.createDataFrame([(s, t, k, w) for (s, t), (k, w) in rows], "source string, target string, relation string, weight double")
    want = {}
    for ((_, m), (k1, w1)), ((m2, _), (k2, w2)) in itertools.product(rows, rows):
        if m == m2:
            kind = "causal" if k1 == k2 == "causes" else "hierarchical" if {k1, k2} <= {"is_a", "is_part_of"} else "temporal" if k1 == k2 == "happened_after" else "hybrid"
            want.setdefault(kind, []).append((w1 * w2, min(w1, w2)))
    got = {x.path_type: (x.n, round(x.avg_confidence, 6), round(x.avg_weakest, 6)) for x in graph.two_step_summary(e).collect()}
    assert got == {k: (len(v), round(sum(a for a, _ in v) / len(v), 6), round(sum(b for _, b in v) / len(v), 6)) for k, v in want.items()}


def test_point_reads(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, content string")
    e = spark.createDataFrame([("a", "b", "causes", 0.5, False, 1)], EDGE)
    assert graph.node_by_id(nodes, "b").collect()[0].content == "y" and graph.node_by_id(nodes, "c").collect() == []
    asked = spark.createDataFrame([("a",), ("c",)], "id string")
    assert {r.id: r.found for r in graph.exist(nodes, asked).collect()} == {"a": True, "c": False}
    assert graph.edge_by_key(e, "a", "b", "causes").count() == 1 and graph.edge_by_key(e, "b", "a", "causes").count() == 0


def test_current_rows_take_the_filter_into_the_scan(spark, tmp_path):
    rows = [("A", "old", 0.9, "2024-01-01"), ("a ", "new", 0.1, "2024-01-02"), ("a", "new", 0.1, "2024-01-02"), ("b", "only", 0.8, None), (None, "no id", 0.9, "2024-01-01")]
    spark.createDataFrame(rows, "id string, content string, confidence double, at string").select("id", "content", "confidence", F.col("at").cast("timestamp").alias("updated_at")).write.parquet(str(tmp_path / "n"))
    raw = spark.read.parquet(str(tmp_path / "n"))
    assert sorted((r.id, r.content) for r in current_rows(raw).collect()) == sorted((r.id, r.content) for r in current_nodes(raw, "content").collect()) == [("a", "new"), ("b", "only")]
    high = current_rows(raw, F.col("confidence") > 0.5).select("id")
    assert [r.id for r in high.collect()] == ["b"]  # an old version that passes doesn't count
    plan = high._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(confidence,0.5)" in plan and "content" not in plan
    pushed = paql.run("only where confidence > 0.5", raw.withColumn("access_score", F.lit(1.0)), versions=True)
    assert [r.id for r in pushed.collect()] == ["b"] and "GreaterThan(confidence,0.5)" in pushed._jdf.queryExecution().executedPlan().toString()


def test_nulls_under_not(spark):
    df = spark.createDataFrame([(1, None), (2, 0.9), (3, 0.1)], "id int, confidence double")
    assert {r.id for r in filters.apply_filter(df, ~filters.greater("confidence", 0.5)).collect()} == {1, 3}
    assert {r.id for r in filters.apply_filter(df, filters.greater("confidence", 0.5) | filters.less("confidence", 0.2)).collect()} == {2, 3}


def vectors(spark, n, seed, dim=8):
    x = np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)
    return x, spark.createDataFrame([(f"v{i:03}", x[i].tolist()) for i in range(n)], "id string, embedding array<float>")


def brute_near(x, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -3)
    return {f"v{i:03}": [f"v{j:03}" for j in sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k]] for i in range(len(x))}


@pytest.mark.parametrize("block", [1000, 7])
def test_many_queries(spark, block):
    x, df = vectors(spark, 120, 1)
    want = brute_near(x, 4)
    asked = df.where("id < 'v030'")
    got = {}
    for r in vector_search.knn_many(df, asked, 4, dim=8, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {q: v for q, v in want.items() if q < "v030"}
    assert vector_search.knn_many(df, asked.limit(0), 4, dim=8).collect() == []


def test_index_is_kept_and_changed(spark, tmp_path):
    x, df = vectors(spark, 400, 2)
    params = vector_search.IndexParams("ivf", nlist=10, nprobe=5)
    index = vector_search.open_or_create(spark, str(tmp_path / "i"), df, params, dim=8)
    again = vector_search.open_or_create(spark, str(tmp_path / "i"), df.limit(0), params, dim=8)
    assert again.count() == index.count() == 400 and np.allclose(again.centres, index.centres) and again.params.nprobe == 5
    want = brute_near(x, 5)
    hits = again.search_many(df, 5, block=150).collect()
    assert sum(r.id in want[r.query_id] for r in hits) >= 0.9 * 5 * 400
    less = again.remove(df.where("id < 'v100'").select("id"))
    assert less.count() == 300 and all(r.id >= "v100" for r in less.search(x[5].tolist(), 20).collect())
    more = less.upsert(spark.createDataFrame([("v005", [9.0] + [0.0] * 7), ("v200", [0.0] * 7 + [9.0])], "id string, embedding array<float>"))
    assert more.count() == 301 and more.search([1.0] + [0.0] * 7, 1).collect()[0].id == "v005"
    with pytest.raises(Exception, match="has not 8 values"):
        less.upsert(spark.createDataFrame([("w", [1.0])], "id string, embedding array<float>"))


def test_cosine_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    got = {r.id: r.cosine for r in vector.with_cosine(df, "embedding", [1.0, 0.0]).collect()}
    assert got[2] is None and [got[i] for i in (1, 3, 4, 5, 6)] == [1.0, 0.0, 0.0, 0.0, 0.0] and abs(got[7] - 0.5**0.5) < 1e-9


def test_mean_pool(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), (2, [[1.0, 2.0]], [0]), (3, [], []), (4, None, [1])], "id int, h array<array<double>>, m array<int>")
    got = {r.id: r.p for r in df.select("id", vector.mean_pool(F.col("h"), F.col("m")).alias("p")).collect()}
    assert got == {1: [2.0, 3.0], 2: [0.0, 0.0], 3: [], 4: None}


def test_json_of_nodes_and_edges(spark):
    kinds = "id string, content string, node_type string, created_at timestamp, updated_at timestamp, accessed_at timestamp, access_score double, confidence double, source string, document_id string, chunk_index int, attributes string"
    nodes = spark.createDataFrame([("a", 'say "x" {y}', "fact", None, None, None, 1.0, 0.5, "s", None, 3, '{"k":[1,2]}'), ("b", None, None, None, None, None, None, None, None, None, None, "{broken"), ("c", "", "fact", None, None, None, 1.0, 1.0, "s", "d", 0, None)], kinds)
    back = {r.id: r for r in mutations.read_node_json(mutations.node_json(nodes)).collect()}
    assert back["a"].content == 'say "x" {y}' and back["a"].attributes == '{"k":[1,2]}' and back["a"].chunk_index == 3
    assert back["b"].attributes == "{}" and back["b"].content is None and back["c"].attributes == "{}"
    edges = spark.createDataFrame([("a", "b", "causes", 0.5, None, True, None, '{"w":1}')], "source string, target string, relation string, weight double, created_at timestamp, expired boolean, replaced_by string, attributes string")
    e = mutations.read_edge_json(mutations.edge_json(edges)).collect()[0]
    assert (e.source, e.weight, e.expired, e.attributes) == ("a", 0.5, True, '{"w":1}')


def test_metadata_and_sorted_edges(spark, tmp_path):
    meta = mutations.put_metadata(mutations.put_metadata(spark.createDataFrame([], "key string, value string"), "a", "1"), "a", "2")
    assert [r.value for r in mutations.get_metadata(meta, "a").collect()] == ["2"] and mutations.get_metadata(meta, "b").collect() == []
    mutations.save_edges(spark.createDataFrame([("b", "a", "r"), ("a", "b", "r")], "source string, target string, relation string"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2


SPAN = "span_id string, parent_id string, name string, kind string, start_time timestamp, end_time timestamp, duration_ms double, status string, error string"


def test_span_store_and_events(spark, tmp_path):
    rows = [("a", None, "x", "f", "2024-01-01 10:00:00", None, None, "running", None), ("a", None, "x", "f", "2024-01-01 10:00:00", "2024-01-01 10:00:05", 5000.0, "cancelled", None), ("b", "a", "y", "f", "2024-01-03 00:00:00", "2024-01-03 00:00:01", 1000.0, "failed", "e")]
    df = spark.createDataFrame([r[:4] + r[6:] + r[4:6] for r in rows], "span_id string, parent_id string, name string, kind string, duration_ms double, status string, error string, s string, e string")
    df = df.select("span_id", "parent_id", "name", "kind", F.col("s").cast("timestamp").alias("start_time"), F.col("e").cast("timestamp").alias("end_time"), "duration_ms", "status", "error")
    for part in (df.limit(1), df.subtract(df.limit(1))):
        traces.append_spans(part, str(tmp_path / "s"))
    assert traces.merge_spans(traces.stored(spark, str(tmp_path / "s"))).count() == 2
    assert traces.stored(spark, str(tmp_path / "s"), first="2024-01-02").count() == 1
    events = traces.trace_events(traces.merge_spans(df))
    assert sorted(r.event_type for r in events.collect()) == ["cancel", "enter", "enter", "error"]
    assert traces.filter_events(events, ["enter"], "2024-01-01 10:00:00", "2024-01-01 10:00:00").count() == 1
    assert traces.filter_events(events, []).count() == 0 and traces.filter_events(events).count() == 4


def test_context_of_a_retrieval(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"content number {i} " * 4, "fact", [1.0, i / 10.0], 1.0) for i in range(8)], "id string, content string, node_type string, embedding array<float>, access_score double")
    edges = spark.createDataFrame([], EDGE)
    cfg = rag.RetrievalConfig(mode="vector", min_relevance=0.0, max_vector_results=6, max_context_tokens=45)
    context, sources = rag.retrieve_context(nodes, edges, [1.0, 0.0], config=cfg)
    assert [r.id for r in sources.orderBy(F.desc("score")).collect()] == ["n0", "n1"]
    assert context.collect()[0].context.startswith("[1] content number 0") and "[3]" not in context.collect()[0].context
    assert [r.id for r in rag.search_text(nodes, "NUMBER 3", 5).collect()] == ["n3"]
    assert rag.search_text(nodes, "x", 2, embed=lambda t: [1.0, 0.0]).orderBy("rank").collect()[0].id == "n0"


def test_ranks_of_many_rows_are_those_of_few(spark, monkeypatch):
    rows = spark.createDataFrame([(f"r{i:03}", "word " * (i % 7), float(i % 10)) for i in range(200)], "id string, content string, score double")
    few = {r.id: (r.rank) for r in rag.ranked(rows).collect()}
    fit = {r.id: r.context_tokens for r in rag.fit_context(rows, 150).collect()}
    monkeypatch.setattr(rag, "SMALL", 10)
    assert {r.id: r.rank for r in rag.ranked(rows).collect()} == few
    assert {r.id: r.context_tokens for r in rag.fit_context(rows, 150).collect()} == fit
    best = rag.compress(rows, 1, "top_only")
    assert best.count() == 100 and rag.removed(rows, best).count() == 100


def test_expansion(spark):
    e = spark.createDataFrame([("a", "b", "r", 0.9, False, 1), ("a", "c", "r", 0.5, False, 2), ("b", "d", "r", 0.8, False, 3), ("c", "e", "r", 0.8, False, 4), ("a", "f", "r", 0.1, False, 5)], EDGE)
    nodes = spark.createDataFrame([(x, t) for x, t in zip("abcdef", ["fact", "fact", "entity", "concept", "fact", "fact"])], "id string, node_type string")
    seeds = spark.createDataFrame([("a", 1.0)], "id string, score double")
    assert {r.id for r in rag.expand(seeds, e, 2, 0.3, None, None).collect()} == set("abcde")
    assert {r.id for r in rag.expand(seeds, e, 2, 0.3, 1, None, "weighted").collect()} == set("abcd")
    assert {r.id for r in rag.expand(seeds, e, 2, 0.3, None, None, nodes=nodes, node_types=["fact"]).collect()} == {"a", "b"}
    assert {r.id for r in rag.expand_adaptive(seeds, e, nodes, 0.1, 3).collect()} == set("abc")  # one hop has two types
    assert {r.id for r in rag.expand_adaptive(seeds, e, nodes, 0.3, 3).collect()} == set("abcde")


@pytest.mark.parametrize("bucket", [1, 3, 5000])
def test_access_fold_in_buckets(spark, bucket):
    from memloom.functions.decay import DecayConfig

    r = random.Random(4)
    log = [(i, r.choice(["a", "b"]), f"2024-01-{1 + i % 9:02} {i % 24:02}:00:00", r.random()) for i in range(60)]
    df = spark.createDataFrame(log, "log_id long, node_id string, t string, boost double").withColumn("ts", F.col("t").cast("timestamp"))
    want = memory.fold_access(df, F.lit("2024-02-01").cast("timestamp"), DecayConfig(0.01, 0.1, 3.0, 0.5), bucket=10_000)
    got = memory.fold_access(df, F.lit("2024-02-01").cast("timestamp"), DecayConfig(0.01, 0.1, 3.0, 0.5), bucket=bucket)
    flat = lambda rows: {x.node_id: (round(x.score, 9), x.last_access, x.accesses) for x in rows.collect()}
    assert flat(got) == flat(want)


def test_sentences_hold_any_character(spark):
    df = spark.createDataFrame([("One\u0001 two. Three!\nFour? v1.5 end",)], "t string")
    want = ["One\u0001 two.", "Three!", "Four?", "v1.5 end"]
    assert df.select(text.sentences(F.col("t"))).first()[0] == want == chunking.split_sentences("One\u0001 two. Three!\nFour? v1.5 end")
    assert "".join(chunking.cut_bytes("aé" * 5, 4)) == "aé" * 5
    assert all(len(x.encode()) <= 4 for x in chunking.cut_bytes("aé" * 50, 4)) and chunking.cut_bytes("漢", 2) == ["漢"]


def test_shared_folder_on_a_cluster():
    """A cluster without a named folder is an error, one machine isn't."""
    from memloom import runtime

    class Fake:
        def __init__(self, master):
            self.sparkContext = type("C", (), {"master": master})()
            self.conf = self
            self.held = {}

        def get(self, key, default=None):
            return self.held.get(key, default)

        def set(self, key, value):
            self.held[key] = value

    for master in ("yarn", "local-cluster[3,2,1024]", "spark://h:1"):
        with pytest.raises(RuntimeError):
            runtime.shared_dir(Fake(master))
    assert runtime.shared_dir(Fake("local[4]")).startswith("file://")


@pytest.mark.parametrize("bucket", [1, 4, 5000])
def test_access_gaps_in_buckets(spark, bucket):
    r = random.Random(6)
    log = [(i, r.choice(["a", "b", "c"]), f"2024-01-{1 + r.randrange(9):02} {r.randrange(24):02}:00:00") for i in range(50)]
    df = spark.createDataFrame(log, "log_id long, node_id string, t string").select("log_id", "node_id", F.col("t").cast("timestamp").alias("ts"), F.lit(1.0).alias("boost"))
    last, want = {}, {}
    for i, n, t in sorted(log, key=lambda x: (x[2], x[0])):
        hours = int(t[8:10]) * 24 + int(t[11:13])
        want[i] = None if n not in last else float(hours - last[n])
        last[n] = hours
    assert {x.log_id: x.gap_hours for x in memory.access_gaps(df, F.lit("2024-02-01").cast("timestamp"), bucket).collect()} == want
