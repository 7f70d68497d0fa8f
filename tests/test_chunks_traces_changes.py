import datetime as dt

import pytest
from pyspark.sql import functions as F

from memloom.operators import chunking as C
from memloom.operators import mutations as M
from memloom.operators import rag, traces


def test_fixed():
    assert C.fixed_windows("Short text.", C.FixedConfig(100, 10))[0][1:4] == (0, 11, "Short text.")
    text = "word " * 400
    rows = C.fixed_windows(text, C.FixedConfig(100, 20))
    assert all(len(r[3]) <= 100 for r in rows) and rows[-1][2] == len(text.strip())
    n = len(text.strip())
    assert all(b[1] == (a[2] - 20 if a[2] + 80 < n else a[2]) for a, b in zip(rows, rows[1:]))  # no overlap once less than a step is left
    assert C.fixed_windows("a" * 30 + "\n" + "b" * 90, C.FixedConfig(100, 10))[0][2] == 31  # behind the first line end
    assert len(C.fixed_windows("x\n" * 300, C.FixedConfig(50, 10))) > 5  # goes on where the window is full of line ends
    with pytest.raises(ValueError):
        C.FixedConfig(10, 10)


def test_semantic():
    assert C.semantic_groups("Short.", C.SemanticConfig())[0][-1] == "InputTooShort(100, 6)"
    text = "Cats like milk. Cats drink milk. Stocks fell today. Stocks rose again. " * 4
    rows = C.semantic_groups(text, C.SemanticConfig(10, 80, 0.3))
    assert " ".join(r[3] for r in rows) == text.strip() and all(sum(len(x) for x in C.split_sentences(r[3])) <= 80 for r in rows)
    one = C.semantic_groups(text, C.SemanticConfig(10, 10_000, 0.9, first_boundary_only=True))
    assert len(one) == 2


def test_chunk_frames(spark):
    df = spark.createDataFrame([(1, "A first sentence. " * 20), (2, None), (3, "  ")], "doc_id long, text string")
    rows = C.chunk_hierarchical(df, "doc_id", "text").collect()
    assert {r.level for r in rows if r.doc_id == 1} == {0, 1, 2} and {r.error for r in rows if r.doc_id != 1} == {"EmptyInput"}
    ids = {r.chunk_id for r in rows if r.chunk_id}
    assert all(r.parent_id in ids for r in rows if r.level in (1, 2))
    kids = C.child_ids(C.chunk_hierarchical(df, "doc_id", "text")).collect()
    assert sum(len(r.child_ids) for r in kids) == sum(r.level in (1, 2) for r in rows if r.level)
    docs = spark.createDataFrame([("d1", "T", "A sentence. " * 30)], "document_id string, title string, text string")
    nodes, edges = C.ingest_documents(docs, "2024-01-01")
    assert nodes.count() == edges.count() + 1 and {r.target for r in edges.collect()} == {"d1"}


SPAN = "span_id string, parent_id string, name string, kind string, start_time timestamp, end_time timestamp, duration_ms double, status string, error string"


def spans(spark):
    t = dt.datetime(2024, 1, 1)
    s = dt.timedelta(seconds=1)
    return spark.createDataFrame([("A", None, "root", "Function", t, t + 9 * s, 9000.0, "completed", None), ("b", "a", "child", "function", t + s, None, None, "running", None), ("B ", None, "child", "function", t + s, t + 3 * s, 2000.0, "failed", "Timeout after 3 s"), ("c", "b", "leaf", "internal", t + 2 * s, t + 3 * s, 1000.0, "completed", None)], SPAN)


def test_traces(spark):
    m = traces.merge_spans(spans(spark))
    got = {r.span_id: (r.parent_id, r.status, r.duration_ms) for r in m.collect()}
    assert got == {"a": (None, "completed", 9000.0), "b": ("a", "failed", 2000.0), "c": ("b", "completed", 1000.0)}
    tree = traces.lifecycle(m).cache()
    assert {(r.span_id, r.depth) for r in tree.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert traces.mermaid(tree, "a").collect()[0].flowchart == 'flowchart TD\n    Na --> Nb["child"]\n    Nb --> Nc["leaf"]'
    assert [r.line for r in traces.text_lines(tree).orderBy("walk_order").collect()] == ["root [completed]", "  child [failed]", "    leaf [completed]"]
    events = traces.trace_events(m)
    assert [r.event_type for r in traces.timeline(events, tree, "a").collect()] == ["enter", "enter", "enter", "error", "exit", "exit"]
    assert tuple(traces.lifecycle_stats(tree).collect()[0]) == ("a", 3, 3) and traces.timeline_total(tree).collect()[0].total_ms == 9000
    assert {r.error_type: r.n for r in traces.errors_by_type(m).collect()} == {"Timeout": 1}
    assert traces.json_lines(tree).count() == 3 and traces.roots(m).count() == 1


def test_percentiles_and_stats(spark):
    df = spark.createDataFrame([("x", float(v)) for v in range(10, 101, 10)] + [("y", None)], "name string, duration_ms double")
    r = traces.index_percentiles(df, ["name"]).collect()
    assert [tuple(x) for x in r] == [("x", 60.0, 100.0, 100.0)]
    s = spark.createDataFrame([("f", 100.0, "completed"), ("f", 200.0, "completed"), ("f", 50.0, "failed")], "name string, duration_ms double, status string")
    row = traces.stats_by_name(s).collect()[0]
    assert (row.invocations, row.successes, row.failures, round(row.avg_ms, 3), round(row.success_rate, 6)) == (3, 2, 1, 116.667, 0.666667)


def test_changes(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    log = spark.createDataFrame([("a", 9, "put", 1), ("a", 8, "delete", 2), ("c", 3, "delete", 3), ("c", 4, "put", 4), ("d", 0, "delete", 5)], "id string, v int, op string, seq int")
    assert sorted(map(tuple, M.fold_changes(base, log, ["id"]).collect())) == [("b", 2), ("c", 4)]
    assert sorted(map(tuple, M.upsert(base, spark.createDataFrame([("b", 7)], "id string, v int"), ["id"]).collect())) == [("a", 1), ("b", 7)]
    nodes = spark.createDataFrame([("a", "x", "fact", 0.5, 1.0), ("b", " ", "fact", 0.5, 1.0), ("c", "x", "other", 0.5, 1.0), ("d", "x", "Entity", 2.0, 1.0)], "id string, content string, node_type string, confidence double, access_score double")
    edges = spark.createDataFrame([("a", "b", "causes", 0.5), ("a", "q", "causes", 0.5), ("q", "a", "causes", 0.5), ("a", "a", "causes", 0.5), ("a", "c", "causes", 5.0)], "source string, target string, relation string, weight double")
    assert {r.id: r.problem for r in M.validate_nodes(nodes).collect()} == {"a": None, "b": "empty content", "c": "unknown node type", "d": "confidence out of range"}
    checked = M.validate_edges(edges, nodes)
    assert sorted(str(r.problem) for r in checked.collect()) == ["None", "self loop", "source not found", "target not found", "weight out of range"]
    assert M.bulk_summary(M.validate_nodes(nodes), checked).agg(F.sum("n")).collect()[0][0] == 9
    rest, kept, gone = M.delete_nodes(nodes, edges, nodes.where("id = 'b'"))
    assert rest.count() == 3 and kept.count() == 4 and gone.collect()[0].deleted == 1
    assert {r.weight for r in M.clamp_edges(edges).collect()} == {0.5, 1.0}


def test_import_export(spark, tmp_path):
    (tmp_path / "in.json").write_text('[{"content": "a", "node_type": "FACT"}, {"content": "b", "node_type": "thing"}, {"node_type": "fact"}]')
    nodes, rejected = M.import_json(spark, str(tmp_path / "in.json"), "2024-01-01")
    assert sorted((r.content, r.node_type) for r in nodes.collect()) == [("a", "fact"), ("b", "concept")] and rejected.count() == 1
    M.export_json(nodes, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_formats(spark):
    rows = spark.createDataFrame([("1", "First", "fact", 0.905, 0), ("2", "Second", "fact", 0.5, 1)], "id string, content string, node_type string, score double, hop_distance int")
    text = lambda style: rag.format_context(rows, style).collect()[0].context
    assert text("compact") == "First Second" and text("flat") == "First\n\n---\n\nSecond"
    assert text("default").startswith("[1] First (relevance: 0.9") and "\n\n[2] Second (relevance: 0.50)" in text("default")
    assert text("structured").startswith("=== Context ===\n\n[1]\nRelevance: ") and text("markdown").startswith("## Context\n\n### 1. First")
    assert text("json").startswith('[{"id":"1","content":"First"')
    assert rag.format_context(rows.limit(0), "structured").collect()[0].context == "No relevant context found."
    assert [r.id for r in rag.fit_context(rows, 1).collect()] == ["1"]
    assert [r.id for r in rag.compress(rows, 1, "top_only").collect()] == ["1"]
