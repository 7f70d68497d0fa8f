import math

import pytest
from pyspark.sql import functions as F

from memloom.functions import decay, enums, text, vector
from memloom.operators import memory, rag, vector_search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def test_relations(spark):
    assert [one(spark, enums.reverse_relation(F.lit(r))) for r in ("causes", "Contradicts", "custom x")] == ["caused_by", "similar_to", "reverse_custom_x"]
    assert one(spark, enums.parse_node_type(F.lit("Raw-Chunk"))) == "raw_chunk" and one(spark, enums.parse_node_type(F.lit("thing"))) is None
    assert enums.includes("forward", True) and not enums.includes("backward", True) and enums.includes("both", False)


def test_texts(spark):
    assert one(spark, text.sentences(F.lit("Hello world. How are you? I'm fine!"))) == ["Hello world.", "How are you?", "I'm fine!"]
    assert one(spark, text.sentences(F.lit("v1.5 is out"))) == ["v1.5 is out"]
    assert one(spark, text.paragraphs(F.lit("First.\n\nSecond.\n\n\nThird."))) == ["First.", "Second.", "Third."]
    assert one(spark, text.jaccard(text.words(F.lit("cat dog mouse")), text.words(F.lit("cat bird fish")))) == pytest.approx(0.2)
    assert one(spark, text.preview(F.lit("x" * 120))) == "x" * 97 + "..."
    assert one(spark, text.token_estimate(F.lit("seven b")) + text.token_estimate(F.lit("nine byte"))) == 3


def test_decay(spark):
    t = lambda h: F.lit(float(h))
    assert one(spark, decay.retention(t(24))) == pytest.approx(0.964640, abs=1e-6)
    assert one(spark, decay.retention(t(1000))) == pytest.approx(0.223130, abs=1e-6)
    assert [one(spark, decay.retention(t(h), "power_law")) for h in (1, 4)] == [1.0, 0.5]
    assert one(spark, decay.retention(t(100), "hyperbolic")) == 0.5 and one(spark, decay.retention(t(5), "none")) == 1.0
    assert one(spark, decay.boosted(F.lit(5.0), F.lit(2))) == 7.0
    assert one(spark, decay.boosted(F.lit(5.0), F.lit(5), decay.DecayConfig(max_score=8.0))) == 8.0
    assert one(spark, decay.time_to_threshold(F.lit(0.22), decay.curve_rate("standard"))) == pytest.approx(1009.418, abs=1e-3)
    assert one(spark, decay.time_to_threshold(F.lit(1.0), decay.curve_rate("standard"))) is None
    a, b = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:59:00").cast("timestamp")
    assert one(spark, decay.node_decayed(F.lit(1.0), a, b)) == 1.0
    assert one(spark, decay.current_score(F.lit(1.0), a, b)) == pytest.approx(math.exp(-0.0015 * 59 / 60))
    with pytest.raises(ValueError):
        decay.DecayConfig(rate=2)


def test_scores(spark):
    assert one(spark, rag.combine(F.lit(0.95), F.lit(1.0), F.lit(0))) == pytest.approx(0.97)
    assert one(spark, rag.combine(F.lit(0.8), F.lit(1.0), F.lit(2))) == pytest.approx(0.22)
    assert one(spark, rag.score_graph_only(F.lit(1))) == pytest.approx(0.2)
    assert one(spark, rag.expansion_score(F.lit(0.9), F.lit(0.8), F.lit(1))) == pytest.approx(0.783)
    assert one(spark, rag.expansion_priority(F.lit(0.9), F.lit(0.8), F.lit(1))) == pytest.approx(0.36)
    assert rag.select_level(5000, 4096, 0.5) == "document" and rag.select_level(100, 4096, 0.5) == "sentence" and rag.select_level(2000, 4096, 0.1, "sentence") == "paragraph"


def test_vectors(spark):
    v = lambda *xs: F.array(*(F.lit(float(x)) for x in xs))
    assert one(spark, vector.cosine(v(1, 0), v(1, 1))) == pytest.approx(0.5**0.5)
    assert [one(spark, vector.cosine(v(1, 0), w)) for w in (v(0, 0), v(1), v(float("nan"), 1))] == [0.0, 0.0, 0.0]
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0]), ("f", [2.0, 0.1]), ("g", [float("nan"), 1.0])], "id string, embedding array<float>")
    got = [(r.id, round(r.score, 3)) for r in vector_search.knn(df, [1.0, 0.0], 10).collect()]
    assert got == [("a", 1.0), ("f", 0.999), ("c", 0.0), ("g", 0.0), ("b", 0.0)]
    assert vector_search.knn(df, [1.0, 0.0], 0).collect() == []
    emb = spark.createDataFrame([("some words here",), ("",), (None,)], "t string").select(vector.hash_embedding(F.col("t"), 16).alias("e")).collect()
    assert sum(x * x for x in emb[0].e) == pytest.approx(1, abs=1e-5) and emb[1].e is None and emb[2].e is None


def test_ivf_finds_most(spark):
    import random

    r = random.Random(4)
    rows = [(f"v{i:04}", [r.gauss(0, 1) for _ in range(8)]) for i in range(800)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    index = vector_search.IVF(df, vector_search.IndexParams("ivf", nlist=20, nprobe=8), dim=8)
    hit = 0
    for q in rows[:5]:
        want = {x.id for x in vector_search.knn(df, q[1], 10).collect()}
        hit += len(want & {x.id for x in index.search(q[1], 10).collect()})
    assert hit / 50 >= 0.9


def test_fold_equals_the_loop(spark):
    import datetime as dt
    import random

    r = random.Random(3)
    cfg = decay.DecayConfig(rate=0.05, min_score=0.5, max_score=3.0, boost=0.7)
    log, t0 = [], dt.datetime(2024, 1, 1)
    for i in range(400):
        log.append((i, r.choice(["hot", "hot", "hot", f"n{i % 9}"]), t0 + dt.timedelta(minutes=r.randrange(60 * 24 * 40)), r.choice([None, 0.1, 1.0, 3.0])))
    want = {}
    for i, node, ts, boost in sorted(log, key=lambda x: (x[2], x[0])):
        s, last, n = want.get(node, (1.0, None, 0))
        if last is not None:
            s = min(max(s * math.exp(-cfg.rate * (ts - last).total_seconds() / 3600), cfg.min_score), cfg.max_score)
        want[node] = (min(max(s + cfg.boost * (1.0 if boost is None else boost), cfg.min_score), cfg.max_score), ts, n + 1)
    df = spark.createDataFrame(log + log[:50], "log_id long, node_id string, ts timestamp, boost double")
    got = {x.node_id: (x.score, x.accesses) for x in memory.fold_access(df, F.lit("2025-01-01").cast("timestamp"), cfg).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][2] for k in want)
