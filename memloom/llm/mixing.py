"""Mixing sources to target shares of a total size, by whole copies and Pareto order sampling.

A source that has to give ``wanted`` times its size gives every document floor(wanted) times for certain. What is
left, ``extra`` tokens, is a sample of fixed size in tokens with unequal probabilities: the inclusion probability of
a document is c times its weight (its size, unless a weight column is named), at most 1, with c such that the
expected size is ``extra``. Documents with probability 1 are certain and taken out; the others draw a uniform
number from their id and are taken in the order of (random odds) / (inclusion odds), the Pareto order, until
the size is reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators.skew import stitched_rank
from memloom.runtime import drop, materialize
from memloom.sources.tables import norm_name

SMALLEST = 1e-12  # odds of documents that weigh nothing: they come last


def allocate(sizes: DataFrame, targets: DataFrame, total_factor: float = 1.0, fit: str = "shares") -> DataFrame:
    """One row a (mix_id, source): share, target, goal, source_tokens, largest (document), max_repeats, whole, extra.

    The full size of a mix is ``total_factor`` times the tokens of all documents; ``target`` is the share of that.
    ``goal`` is what is drawn. With ``fit="shares"`` the size of the mix is lowered until no source has to be
    repeated more than max_repeats times, so the shares hold; shares of sources without documents go to the
    others in proportion. With ``fit="total"`` every source gives its target as far as max_repeats allows.
    Several rows of one source in a mix add up. Weights that are null, not positive or not finite are 0.
    """
    if fit not in ("shares", "total"):
        raise ValueError(f"fit {fit!r}")
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.max("n_tokens").alias("largest"))
    total = sizes.agg((F.coalesce(F.sum("n_tokens"), F.lit(0)) * total_factor).alias("full"))  # one row
    fine = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight")).otherwise(F.lit(0.0))
    rows = targets.groupBy("mix_id", norm_name("source").alias("source")).agg(F.sum(fine).alias("weight"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("max_repeats"))
    a = rows.join(have, "source", "left").crossJoin(F.broadcast(total)).withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    most = F.col("max_repeats") * F.col("source_tokens")
    sums = a.groupBy("mix_id").agg(F.sum("weight").alias("weights"), F.sum(F.when(most > 0, F.col("weight")).otherwise(0.0)).alias("present"), F.min(F.when((most > 0) & (F.col("weight") > 0), most / F.col("weight"))).alias("tightest"))
    a = a.join(sums, "mix_id")
    share = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(F.lit(0.0))
    target = share * F.col("full")
    if fit == "shares":
        # Of a mix of size M a present source gives M * weight / present, at most max_repeats times what it has.
        size = F.least(F.col("full"), F.col("tightest") * F.col("present"))
        goal = F.when((F.col("present") > 0) & (most > 0), size * F.col("weight") / F.col("present")).otherwise(F.lit(0.0))
    else:
        goal = F.least(target, most.cast("double"))
    a = a.select("mix_id", "source", "max_repeats", share.alias("share"), target.alias("target"), F.least(goal, most.cast("double")).alias("goal"), "source_tokens", F.coalesce("largest", F.lit(0)).alias("largest"))
    wanted = F.when(F.col("source_tokens") > 0, F.round(F.col("goal") / F.col("source_tokens"), 9)).otherwise(F.lit(0.0))
    return a.select("*", F.floor(wanted).cast("int").alias("whole"), (F.col("source_tokens") * (wanted - F.floor(wanted))).alias("extra"))


def _inclusion(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """(mix_id, source, c, left): documents with weight * c >= 1 are certain, ``left`` tokens are drawn from the rest.

    Certain documents are taken out until no further one is: the sums are over (source, weight), not documents,
    and there is a row a (mix_id, source)."""
    sums = docs.groupBy("source", "weight").agg(F.sum("n_tokens").alias("tokens"))
    work = materialize(plan.where("extra > 0").select("mix_id", "source", "extra").join(sums, "source"), "weights")
    state = materialize(plan.where("extra > 0").select("mix_id", "source", "extra", F.lit(float("inf")).alias("cut"), F.lit(-1).cast("long").alias("n")), "inclusion")
    while True:
        tagged = work.drop("extra").join(state.select("mix_id", "source", "extra", "cut"), ["mix_id", "source"])
        rest = F.col("weight") < F.col("cut")
        found = tagged.groupBy("mix_id", "source", "extra").agg(
            F.sum(F.when(~rest, F.col("tokens")).otherwise(0)).alias("certain"), F.sum(F.when(rest, F.col("tokens") * F.col("weight")).otherwise(0.0)).alias("mass"), F.count_if(~rest).alias("n")
        )
        left = F.greatest(F.col("extra") - F.col("certain"), F.lit(0.0))
        c = F.when(F.col("mass") > 0, left / F.col("mass")).otherwise(F.lit(0.0))
        following = materialize(found.select("mix_id", "source", "extra", F.when(c > 0, 1 / c).otherwise(F.lit(float("inf"))).alias("next"), "n", c.alias("c"), left.alias("left"), "certain"), "inclusion")
        moved = following.join(state.select("mix_id", "source", F.col("n").alias("before")), ["mix_id", "source"]).where("n > before").limit(1).count()
        if not moved:
            drop(work, state)
            return following.select("mix_id", "source", "c", "left", "n")
        drop(state)
        state = following.select("mix_id", "source", "extra", F.col("next").alias("cut"), "n")


def mix_sources(sizes: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: int = 17, weight_col: str | None = None, total_factor: float = 1.0, fit: str = "shares") -> tuple[DataFrame, DataFrame]:
    """(chosen, report). ``chosen``: mix_id, source, ``id_col``, n_tokens, copies (>= 1). ``report``: a row a
    (mix_id, source) with share, target, goal, tokens, actual_share, documents, copies, missing, exhausted (every
    document was taken max_repeats times and the target isn't reached).

    ``sizes`` has ``id_col, source, n_tokens``; sources are compared in normal form, a null source is in
    no mix but counts in the total; null sizes count 0. Documents without tokens take part in whole
    copies only. Empty tables give empty results; a source without documents gets a report row.
    """
    weight = F.col(weight_col).cast("double") if weight_col else F.col("n_tokens").cast("double")
    positive = F.when((weight > 0) & (weight < float("inf")), weight).otherwise(F.lit(0.0))
    docs = sizes.select(F.col(id_col), norm_name("source").alias("source"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), positive.alias("weight"))
    plan = materialize(allocate(docs, targets, total_factor, fit), "plan")  # as many rows as targets
    odds = _inclusion(docs.where("n_tokens > 0"), plan)
    settings = plan.where("whole > 0 or extra > 0").join(odds, ["mix_id", "source"], "left").select("mix_id", "source", "whole", "extra", F.coalesce("c", F.lit(0.0)).alias("c"), F.coalesce("left", F.lit(0.0)).alias("left"))
    per_doc = docs.join(settings, "source")  # settings is as small as the table of targets; Spark broadcasts it where its size allows
    lam = F.col("weight") * F.col("c")
    drawn = (F.col("extra") > 0) & (F.col("n_tokens") > 0)
    certain = drawn & (lam >= 1)
    lam = F.least(F.greatest(lam, F.lit(SMALLEST)), F.lit(1 - SMALLEST))
    u = (F.pmod(F.xxhash64(F.lit(seed), "mix_id", F.col(id_col)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    open_ = per_doc.where(drawn & ~certain).withColumn("q", (u / (1 - u)) / (lam / (1 - lam)))
    sampled = stitched_rank(open_.select("mix_id", "source", id_col, "n_tokens", "whole", "left", "q"), ["mix_id", "source"], ["q", id_col], size="n_tokens", running="reached")
    # Taken while that brings the sum nearer to the tokens wanted.
    more = F.when(F.col("reached") - F.col("n_tokens") / 2 <= F.col("left"), F.lit(1)).otherwise(F.lit(0))
    fields = ["mix_id", "source", id_col, "n_tokens"]
    settled = per_doc.where(~drawn | certain).select(*fields, (F.col("whole") + certain.cast("int")).cast("int").alias("copies"))
    chosen = materialize(sampled.select(*fields, (F.col("whole") + more).cast("int").alias("copies")).unionByName(settled).where("copies > 0"), "chosen")
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"))
    sums = got.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    report = plan.join(got, ["mix_id", "source"], "left").join(sums, "mix_id", "left").select(
        "mix_id", "source", "share", "target", "goal", "source_tokens", "largest", "max_repeats",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "copies", "mix_tokens")),
        F.when(F.col("mix_tokens") > 0, F.coalesce("tokens", F.lit(0)) / F.col("mix_tokens")).otherwise(F.lit(0.0)).alias("actual_share"),
        F.greatest(F.col("target") - F.coalesce("tokens", F.lit(0)), F.lit(0.0)).alias("missing"),
        ((F.coalesce("tokens", F.lit(0)) >= F.col("max_repeats") * F.col("source_tokens")) & (F.coalesce("tokens", F.lit(0)) < F.col("target"))).alias("exhausted"),
    )
    return chosen, report
