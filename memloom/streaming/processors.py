"""Streaming forms of the stateful pieces: access scores, spans from enter and exit events, windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memloom.functions.decay import DecayConfig


def access_scores(events: DataFrame, config: DecayConfig = DecayConfig(), start: float = 1.0, watermark: str = "3 days") -> DataFrame:
    """``node_id, score, last_access, accesses`` after every batch that has accesses of the node.

    State is (score, last access, count). Events are taken by time within a batch; one that is older
    than the last access of its node adds its boost without decay. Update mode."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        score, last, n = state.get if state.exists else (start, None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "log_id"])
        times = rows["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
        boosts = rows["boost"].astype("float64").fillna(1.0).tolist()
        for micros, boost in zip(times, boosts):  # the clamps make every step depend on the one before
            if last is not None:
                gap = max(0.0, (micros - last) / 3.6e9)
                score = min(max(score * math.exp(-config.rate * gap), config.min_score), config.max_score)
            score = min(max(score + config.boost * boost, config.min_score), config.max_score)
            last = micros if last is None else max(last, micros)
            n += 1
        state.update((float(score), last, n))
        yield pd.DataFrame({"node_id": [key[0]], "score": [float(score)], "last_access": [pd.Timestamp(last, unit="us")], "accesses": [n]})

    keyed = events.withColumn("node_id", F.lower(F.trim("node_id"))).where("node_id is not null and ts is not null").withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["log_id"])
    return keyed.groupBy("node_id").applyInPandasWithState(update, "node_id string, score double, last_access timestamp, accesses long", "score double, last long, n long", "update", GroupStateTimeout.NoTimeout)


def completed_spans(events: DataFrame, watermark: str = "1 hour", longest: str = "1 hour") -> DataFrame:
    """Spans from enter and exit, error or cancel events, joined within the longest duration. Both sides wait in a
    bounded buffer: what is older than the watermark and the longest duration is evicted."""
    enter = events.where(F.col("event_type") == "enter").select("span_id", "parent_id", "name", F.col("ts").alias("start_time")).withWatermark("start_time", watermark)
    leave = events.where(F.col("event_type").isin("exit", "error", "cancel")).select(F.col("span_id").alias("s"), F.col("ts").alias("end_time"), F.when(F.col("event_type") == "error", F.lit("failed")).when(F.col("event_type") == "cancel", F.lit("cancelled")).otherwise(F.lit("completed")).alias("status"), "error").withWatermark("end_time", watermark)
    on = (F.col("span_id") == F.col("s")) & (F.col("end_time") >= F.col("start_time")) & (F.col("end_time") <= F.col("start_time") + F.expr(f"interval {longest}"))
    joined = enter.join(leave, on)
    return joined.select("span_id", "parent_id", "name", "start_time", "end_time", ((F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000).alias("duration_ms"), "status", "error")


def windowed_span_stats(spans: DataFrame, width: str = "1 hour", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Tumbling or sliding windows by start time; rows later than the watermark are dropped."""
    w = F.window("start_time", width, slide) if slide else F.window("start_time", width)
    agg = spans.withWatermark("start_time", watermark).groupBy(w.alias("w"), "name").agg(F.count("*").alias("spans"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "name", "spans", "avg_ms", "max_ms")


def session_span_stats(spans: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    agg = spans.withWatermark("start_time", watermark).groupBy(F.session_window("start_time", gap).alias("w"), "name").agg(F.count("*").alias("spans"))
    return agg.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "name", "spans")


def decay_ticks(spark, load, save, checkpoint: str, config: DecayConfig = DecayConfig(), every: str = "1 hour"):
    """Starts the periodic decay: at every tick of processing time ``save(decay_update(load(), now))``. ``load`` gives the
    nodes, ``save`` keeps them; the running query comes back."""
    from memloom.operators.memory import decay_update

    def tick(batch: DataFrame, number: int) -> None:
        save(decay_update(load(), F.current_timestamp(), config))

    source = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return source.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and gives its rows; for batch-like use and tests."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
