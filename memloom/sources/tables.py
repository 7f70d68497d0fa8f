"""Readers of the stored tables and the rules that say which of their rows count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def norm_id(column) -> F.Column:
    return F.lower(F.trim(F.col(column) if isinstance(column, str) else column))


def norm_name(column) -> F.Column:
    """Enum spellings: trimmed, lower case, hyphen and blank as underscore."""
    return F.regexp_replace(F.lower(F.trim(F.col(column) if isinstance(column, str) else column)), "[- ]", "_")


def current_nodes(nodes: DataFrame, *columns: str) -> DataFrame:
    """The row with the greatest updated_at of every id, with the columns asked for only.

    Ties are identical rows, so any of them will do; rows without an id are no nodes.
    """
    pick = columns or tuple(c for c in nodes.columns if c != "id")
    best = F.max_by(F.struct(*pick), F.coalesce("updated_at", F.lit(0).cast("timestamp"))).alias("_row")
    return nodes.where("id is not null").groupBy(norm_id("id").alias("id")).agg(best).select("id", *(F.col("_row")[c].alias(c) for c in pick))


def current_rows(nodes: DataFrame, where: F.Column | None = None) -> DataFrame:
    """Current rows with all columns, of which a scan reads those that are used later.

    The greatest updated_at is found on two narrow columns and joined. ``where``, a test on a row as it is
    stored, goes into the scan of the wide columns: the current row passes it exactly if it does as one of
    the versions."""
    keyed = nodes.where("id is not null").withColumn("_at", F.coalesce("updated_at", F.lit(0).cast("timestamp")))
    best = keyed.groupBy(norm_id("id").alias("_id")).agg(F.max("_at").alias("_best"))
    wide = keyed if where is None else keyed.where(where)
    joined = wide.withColumn("id", norm_id("id")).join(best, (F.col("id") == F.col("_id")) & (F.col("_at") == F.col("_best")))
    return joined.drop("_id", "_at", "_best").dropDuplicates(["id"])


def latest_edges(edges: DataFrame, *columns: str) -> DataFrame:
    """The row with the greatest seq of every (source, target, relation), compared in normal form."""
    pick = columns or tuple(c for c in edges.columns if c not in ("source", "target", "relation"))
    keys = [norm_id("source").alias("source"), norm_id("target").alias("target"), norm_name("relation").alias("relation")]
    return edges.groupBy(*keys).agg(F.max_by(F.struct(*pick), F.col("seq")).alias("_row")).select("source", "target", "relation", *(F.col("_row")[c].alias(c) for c in pick))
