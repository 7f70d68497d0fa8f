"""Spans and their events: merging, statistics, trees, timelines, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.enums import _name
from memloom.operators.hierarchy import build_hierarchy, normal_id
from memloom.operators.skew import stitched_rank

DONE, FAILED, CANCELLED = "completed", "failed", "cancelled"


def merge_spans(spans: DataFrame) -> DataFrame:
    """One row a span: the row written at its end where there is one, with the parent from any row."""
    s = spans.select(normal_id(F.col("span_id")).alias("span_id"), normal_id(F.col("parent_id")).alias("parent_id"), "name", _name(F.col("kind")).alias("kind"), "start_time", "end_time", "duration_ms", _name(F.col("status")).alias("status"), "error").where("span_id is not null")
    rest = ["name", "kind", "start_time", "end_time", "duration_ms", "status", "error"]
    # Ended before open, then by value, so that the choice is the same on every run.
    order = F.struct(F.col("end_time").isNotNull(), F.col("end_time"), F.coalesce("duration_ms", F.lit(-1.0)), F.coalesce("status", F.lit("")), F.coalesce("name", F.lit("")), F.coalesce("kind", F.lit("")), F.coalesce("error", F.lit("")), F.col("start_time"))
    return s.groupBy("span_id").agg(F.min("parent_id").alias("parent_id"), F.max_by(F.struct(*rest), order).alias("r")).select("span_id", "parent_id", *(F.col("r")[c].alias(c) for c in rest))


def trace_events(spans: DataFrame) -> DataFrame:
    """An enter and, for ended spans, an exit, error or cancel event."""
    enter = spans.select("span_id", "parent_id", F.lit("enter").alias("event_type"), "name", F.col("start_time").alias("ts"), F.lit(None).cast("double").alias("duration_ms"), F.lit(None).cast("string").alias("error"))
    leave = spans.where("end_time is not null").select("span_id", "parent_id", F.when(F.col("status") == FAILED, F.lit("error")).when(F.col("status") == CANCELLED, F.lit("cancel")).otherwise(F.lit("exit")).alias("event_type"), "name", F.col("end_time").alias("ts"), "duration_ms", "error")
    return enter.unionByName(leave)


def stats_by_name(spans: DataFrame) -> DataFrame:
    """Spans with a duration only; success is status completed; the rate of no spans is 1."""
    s = spans.where("duration_ms is not null")
    return s.groupBy("name").agg(
        F.count("*").alias("invocations"), F.count_if(F.col("status") == DONE).alias("successes"), F.avg("duration_ms").alias("avg_ms"), F.sum("duration_ms").alias("total_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms")
    ).withColumn("failures", F.col("invocations") - F.col("successes")).withColumn("success_rate", F.coalesce(F.try_divide(F.col("successes"), F.col("invocations")), F.lit(1.0)))


def index_percentiles(spans: DataFrame, keys: list[str], value: str = "duration_ms", shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The value at position min(floor(n * p), n - 1) of the sorted values, by stitched ranks: a name with
    very many spans is cut over partitions and its values are never gathered."""
    rows = spans.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    ranked = stitched_rank(rows, keys, ["_v"])
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    joined = ranked.join(counts, keys)
    at = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1) + 1
    return joined.groupBy(*keys).agg(*(F.max(F.when(F.col("rank") == at(p), F.col("_v"))).alias(f"p{round(p * 100)}") for p in shares))


def errors_by_type(spans: DataFrame) -> DataFrame:
    """First word of the message, else unknown."""
    first = F.split(F.regexp_replace("error", r"^\s+|\s+$", ""), r"\s+")[0]
    return spans.where(F.col("status") == FAILED).groupBy(F.coalesce(F.when(first != "", first), F.lit("unknown")).alias("error_type")).agg(F.count("*").alias("n"))


def window_stats(spans: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    w = F.window("start_time", width, slide) if slide else F.window("start_time", width)
    return spans.groupBy(w.alias("w")).agg(
        F.count("*").alias("spans"), F.count_if(F.col("status") == DONE).alias("completed"), F.count_if(F.col("status") == FAILED).alias("failed"), F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "spans", "completed", "failed", "avg_ms", "min_ms", "max_ms")


def session_stats(spans: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Sessions of spans of a name with no pause longer than the gap."""
    w = F.session_window("start_time", gap)
    return spans.groupBy("name", w.alias("w")).agg(F.count("*").alias("spans"), F.avg("duration_ms").alias("avg_ms")).select("name", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "spans", "avg_ms")


def window_percentiles(spans: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """``window_stats`` with p50, p95 and p99 of the durations (null in windows without any)."""
    w = F.window("start_time", width, slide) if slide else F.window("start_time", width)
    rows = spans.select(w.alias("w"), "duration_ms").select(F.col("w.start").alias("window_start"), "duration_ms")
    return window_stats(spans, width, slide).join(index_percentiles(rows, ["window_start"]), "window_start", "left")


def storage_stats(spans: DataFrame, events: DataFrame) -> DataFrame:
    """One row: stored spans and events."""
    return spans.agg(F.count("*").alias("span_count")).crossJoin(events.agg(F.count("*").alias("event_count")))  # one row each


def append_spans(spans: DataFrame, path: str) -> None:
    """Adds spans to a store, a folder a day of start; a reader merges the rows of a span with ``merge_spans``."""
    spans.withColumn("day", F.to_date("start_time")).write.mode("append").partitionBy("day").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def stored(spark, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """What was appended, of the days from ``first`` to ``last`` only where they are given (whole folders are skipped)."""
    df = spark.read.parquet(path)
    for test in ([F.col("day") >= first] if first else []) + ([F.col("day") <= last] if last else []):
        df = df.where(test)
    return df.drop("day")


def filter_events(events: DataFrame, types: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Events of the types named, within both times, bounds included."""
    out = events if types is None else events.where(F.col("event_type").isin(*types) if types else F.lit(False))
    out = out if start is None else out.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    return out if end is None else out.where(F.col("ts") <= F.lit(end).cast("timestamp"))


def children_by_parent(spans: DataFrame) -> DataFrame:
    """(parent, child, parent_name, child_name) for spans whose parent is there."""
    parents = spans.select(F.col("span_id").alias("parent"), F.col("name").alias("parent_name"))
    return spans.select(F.col("span_id").alias("child"), F.col("parent_id").alias("parent"), F.col("name").alias("child_name")).join(parents, "parent")


def collector_stats(spans: DataFrame) -> DataFrame:
    return spans.agg(F.count("*").alias("created"), F.count_if(F.col("status") == DONE).alias("completed"), F.count_if(F.col("status") == FAILED).alias("failed"), F.count_if(F.col("end_time").isNull()).alias("open")).withColumn(
        "success_rate", F.coalesce(F.try_divide(F.col("completed"), F.col("completed") + F.col("failed")), F.lit(1.0))
    )


def events_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def top_spans(stats: DataFrame, by: str = "avg_ms", n: int = 10) -> DataFrame:
    return stats.orderBy(F.desc(by), "name").limit(n)


def roots(spans: DataFrame) -> DataFrame:
    return spans.where("parent_id is null")


def lifecycle(spans: DataFrame) -> DataFrame:
    """Every span with its root and depth, and the order it has in a walk of the tree (preorder)."""
    h = build_hierarchy(spans.select("span_id", "parent_id"))
    return spans.drop("parent_id").join(h.select(F.col("node_id").alias("span_id"), "parent_id", "root_id", "depth", "in_loop", "n_descendants", F.col("pre").alias("walk_order")), "span_id")


def lifecycle_stats(tree: DataFrame) -> DataFrame:
    """A row a root: spans in its tree, and its height."""
    return tree.where("not in_loop").groupBy("root_id").agg(F.count("*").alias("span_count"), (F.max("depth") + 1).alias("max_depth"))


def timeline(events: DataFrame, tree: DataFrame, root_id: str) -> DataFrame:
    """Events of the root's tree by time; those of the same moment by span and type."""
    inside = tree.where(F.col("root_id") == root_id).select("span_id")
    return events.join(inside, "span_id", "left_semi").orderBy("ts", "span_id", "event_type")


def timeline_total(tree: DataFrame) -> DataFrame:
    """Milliseconds from start to end of every root."""
    return tree.where("depth = 0").select("root_id", ((F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000).alias("total_ms"))


def _trimmed(id_col: Column) -> Column:
    return F.concat(F.lit("N"), F.replace(id_col, F.lit("-"), F.lit("")))


def mermaid_lines(tree: DataFrame) -> DataFrame:
    """(root_id, walk_order, line): a flowchart line for every child."""
    names = tree.select("span_id", "parent_id", "root_id", "name", "walk_order", "depth")
    return names.where("depth > 0").select("root_id", "walk_order", F.concat(F.lit("    "), _trimmed(F.col("parent_id")), F.lit(" --> "), _trimmed(F.col("span_id")), F.lit('["'), F.col("name"), F.lit('"]')).alias("line"))


def mermaid(tree: DataFrame, root_id: str) -> DataFrame:
    """One row ``flowchart`` for one tree."""
    lines = mermaid_lines(tree.where(F.col("root_id") == root_id))
    return lines.agg(F.array_join(F.concat(F.array(F.lit("flowchart TD")), F.transform(F.sort_array(F.collect_list(F.struct("walk_order", "line"))), lambda x: x["line"])), "\n").alias("flowchart"))


def text_lines(tree: DataFrame) -> DataFrame:
    """(root_id, walk_order, line): names indented by depth."""
    return tree.where("not in_loop").select("root_id", "walk_order", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("name"), F.lit(" ["), F.coalesce("status", F.lit("open")), F.lit("]")).alias("line"))


def json_lines(tree: DataFrame) -> DataFrame:
    return tree.select("root_id", "span_id", F.to_json(F.struct("span_id", "parent_id", "name", "kind", "status", "duration_ms", "depth")).alias("json"))
