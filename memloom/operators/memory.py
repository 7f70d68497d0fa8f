"""Access history to scores, statistics of the memory, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.decay import DecayConfig, clamp, current_score, raw_score
from memloom.operators.skew import stitched_rank
from memloom.runtime import materialize


def access_events(log: DataFrame, as_of: Column, default_boost: float = 1.0) -> DataFrame:
    """Each log_id once, up to ``as_of``; a null boost is the default one."""
    once = log.select(F.lower(F.trim("node_id")).alias("node_id"), "ts", F.coalesce("boost", F.lit(default_boost)).alias("boost"), "log_id").where(F.col("node_id").isNotNull() & (F.col("ts") <= as_of))
    return once.dropDuplicates(["log_id"])


def fold_access(log: DataFrame, as_of: Column, config: DecayConfig = DecayConfig(), start: float = 1.0, bucket: int = 5_000) -> DataFrame:
    """``node_id, score, last_access, accesses``: every access decays the score since the one before and adds its boost.

    The clamps make the steps depend on each other, so they are taken in order of (ts, log_id). The
    composition of clamped affine steps is again one, x -> clamp(a * x + b, low, high): every ``bucket``
    consecutive accesses of a node are folded to these four numbers first, and the buckets in order after, so
    that no row holds all accesses of a hot node. Ranks are stitched over range partitions.
    """
    events = access_events(log, as_of)
    lo, hi = config.min_score, config.max_score
    ranked = stitched_rank(events, ["node_id"], ["ts", "log_id"])
    keyed = ranked.select("node_id", F.floor((F.col("rank") - 1) / bucket).alias("bucket"), F.struct("ts", "log_id", "boost").alias("e"))
    lists = keyed.groupBy("node_id", "bucket").agg(F.sort_array(F.collect_list("e")).alias("es"))
    # Within a bucket: the first access adds its boost; every other decays first. State: x -> clamp(a x + b, l, h).
    first = F.element_at("es", 1)
    state = F.struct(F.lit(1.0).alias("a"), (config.boost * first["boost"]).alias("b"), F.lit(lo).alias("l"), F.lit(hi).alias("h"), first["ts"].alias("ts"))

    def step(s, x):
        f = F.exp(-F.lit(config.rate) * F.greatest((F.unix_micros(x["ts"]) - F.unix_micros(s["ts"])) / 3.6e9, F.lit(0.0)))
        plus = config.boost * x["boost"]
        after = lambda v: clamp(clamp(v * f, lo, hi) + plus, lo, hi)
        # The slope and offset of the middle part, and what its ends are mapped to.
        return F.struct((s["a"] * f).alias("a"), (s["b"] * f + plus).alias("b"), after(s["l"]).alias("l"), after(s["h"]).alias("h"), x["ts"].alias("ts"))

    folded = lists.select("node_id", "bucket", first["ts"].alias("begin"), F.size("es").alias("n"), F.aggregate(F.slice("es", 2, F.size("es")), state, step).alias("s"))
    whole = folded.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "begin", "n", "s"))).alias("bs"))  # a row a bucket

    def join(acc, x):
        f = F.exp(-F.lit(config.rate) * F.greatest((F.unix_micros(x["begin"]) - F.unix_micros(acc["ts"])) / 3.6e9, F.lit(0.0)))
        v = F.when(acc["ts"].isNull(), acc["score"]).otherwise(clamp(acc["score"] * f, lo, hi))
        s = x["s"]
        return F.struct(F.least(F.greatest(s["a"] * v + s["b"], s["l"]), s["h"]).alias("score"), s["ts"].alias("ts"), (acc["n"] + x["n"]).alias("n"))

    zero = F.struct(F.lit(float(start)).alias("score"), F.lit(None).cast("timestamp").alias("ts"), F.lit(0).alias("n"))
    return whole.select("node_id", F.aggregate("bs", zero, join).alias("r")).select("node_id", F.col("r.score").alias("score"), F.col("r.ts").alias("last_access"), F.col("r.n").cast("long").alias("accesses"))


def access_gaps(log: DataFrame, as_of: Column, bucket: int = 5_000) -> DataFrame:
    """Every access with the hours since the one before of the same node.

    Ranks are stitched over range partitions, every ``bucket`` of them are a window of their own, so a hot node is
    cut; the first access of a bucket takes the last one of the bucket before from a table with a row a bucket."""
    events = access_events(log, as_of)
    ranked = materialize(stitched_rank(events, ["node_id"], ["ts", "log_id"]).withColumn("part", F.floor((F.col("rank") - 1) / bucket)), "gaps")
    within = F.lag("ts").over(Window.partitionBy("node_id", "part").orderBy("rank"))
    ends = ranked.groupBy("node_id", (F.col("part") + 1).alias("part")).agg(F.max("ts").alias("end"))  # ranks go by time
    cut = ranked.where(F.col("part") > 0).select("node_id").distinct()
    lagged = ranked.withColumn("lagged", within)
    joined = lagged.join(ends.join(cut, "node_id", "left_semi"), ["node_id", "part"], "left")
    return joined.withColumn("before", F.coalesce("lagged", "end")).select("log_id", "node_id", "ts", ((F.unix_micros("ts") - F.unix_micros("before")) / 3.6e9).alias("gap_hours"))


def all_scores(nodes: DataFrame, as_of: Column, config: DecayConfig = DecayConfig()) -> DataFrame:
    return nodes.select("id", current_score(F.col("access_score"), F.col("accessed_at"), as_of, config).alias("score"))


def memory_stats(nodes: DataFrame, as_of: Column, config: DecayConfig = DecayConfig(), active_from: float | None = None) -> DataFrame:
    """One row: total, active, decayed, average_score, load_factor (0 for no nodes)."""
    least = config.min_score if active_from is None else active_from
    s = all_scores(nodes, as_of, config)
    return s.agg(F.count("*").alias("total"), F.count_if(F.col("score") >= least).alias("active"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score")).select(
        "total", "active", (F.col("total") - F.col("active")).alias("decayed"), "average_score", F.coalesce(F.try_divide(F.col("active"), F.col("total")), F.lit(0.0)).alias("load_factor")
    )


def prunable(nodes: DataFrame, as_of: Column, config: DecayConfig = DecayConfig(), below: float | None = None, parity: bool = False) -> DataFrame:
    """(id, score) of nodes to forget: their decayed score is under the bound, before the clamp.

    With ``parity`` the clamped score decides, which no node that was ever accessed can fall under."""
    least = config.min_score if below is None else below
    score = (current_score if parity else raw_score)(F.col("access_score"), F.col("accessed_at"), as_of, config)
    return nodes.select("id", score.alias("score")).where(F.col("score") < least)


def prune_summary(pruned: DataFrame) -> DataFrame:
    return pruned.agg(F.count("*").alias("pruned"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("score_reclaimed"))


def decay_update(nodes: DataFrame, as_of: Column, config: DecayConfig = DecayConfig()) -> DataFrame:
    """The batch job of decay: nodes with their scores as of then."""
    return nodes.withColumn("access_score", current_score(F.col("access_score"), F.col("accessed_at"), as_of, config))


def record_access(nodes: DataFrame, log: DataFrame, as_of: Column, config: DecayConfig = DecayConfig()) -> DataFrame:
    """Nodes with score and accessed_at after the accesses of the log; unknown ids change nothing."""
    folded = fold_access(log, as_of, config).select(F.col("node_id").alias("id"), F.col("score").alias("_s"), F.col("last_access").alias("_t"))
    return nodes.join(folded, "id", "left").withColumn("access_score", F.coalesce("_s", "access_score")).withColumn("accessed_at", F.coalesce("_t", "accessed_at")).drop("_s", "_t")
