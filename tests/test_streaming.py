import datetime as dt
import math

from pyspark.sql import functions as F

from memloom.functions.decay import DecayConfig
from memloom.operators import memory, traces
from memloom.streaming import processors as P


def stream(spark, df, path):
    df.coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_access_scores_equal_the_batch_fold(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, f"n{i % 3}", t0 + dt.timedelta(hours=i * 5), 1.0) for i in range(30)]
    df = spark.createDataFrame(rows + rows[:4], "log_id long, node_id string, ts timestamp, boost double")
    cfg = DecayConfig(rate=0.05)
    want = {r.node_id: (round(r.score, 6), r.accesses) for r in memory.fold_access(df, F.lit("2025-01-01").cast("timestamp"), cfg).collect()}
    out = P.run_to_table(P.access_scores(stream(spark, df, tmp_path / "in"), cfg), "access", str(tmp_path / "cp"), "update")
    got = {r.node_id: (round(r.score, 6), r.accesses) for r in out.orderBy("accesses").collect()}
    assert got == want and not math.isnan(got["n0"][0])


def test_spans_and_windows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    s = [(f"s{i}", None, "op", "function", t0 + dt.timedelta(minutes=i), t0 + dt.timedelta(minutes=i, seconds=30), 30000.0, "failed" if i % 4 == 0 else "completed", None) for i in range(40)]
    schema = "span_id string, parent_id string, name string, kind string, start_time timestamp, end_time timestamp, duration_ms double, status string, error string"
    spans = spark.createDataFrame(s, schema)
    joined = P.run_to_table(P.completed_spans(stream(spark, traces.trace_events(spans), tmp_path / "ev")), "joined", str(tmp_path / "c1"))
    assert {(r.span_id, r.status, r.duration_ms) for r in joined.collect()} == {(x[0], x[7], 30000.0) for x in s}
    late = stream(spark, spans, tmp_path / "sp")
    tumbling = P.run_to_table(P.windowed_span_stats(late, "10 minutes", watermark="0 seconds"), "tumbling", str(tmp_path / "c2"), "complete")
    assert tumbling.agg(F.sum("spans")).collect()[0][0] == 40 and tumbling.count() == 4
    sessions = P.run_to_table(P.session_span_stats(late, "5 minutes"), "sessions", str(tmp_path / "c3"), "complete")
    assert [r.spans for r in sessions.collect()] == [40]


def test_decay_ticks(spark, tmp_path):
    import time

    from memloom.streaming.processors import decay_ticks

    nodes = spark.createDataFrame([("a", 5.0, "2020-01-01"), ("b", 5.0, None)], "id string, access_score double, at string").select("id", "access_score", F.col("at").cast("timestamp").alias("accessed_at"))
    saved = []
    query = decay_ticks(spark, lambda: nodes, lambda df: saved.append({r.id: r.access_score for r in df.collect()}), str(tmp_path / "c"), every="1 second")
    for _ in range(100):
        if saved:
            break
        time.sleep(0.2)
    query.stop()
    assert saved[0] == {"a": 0.1, "b": 5.0}
