"""Session helpers: default configuration, shared-folder tables, parallelism."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def session(app: str = "memloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; anything in ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary folder takes its
    place on a single machine (master ``local``); on a cluster, whose executors would each write to a
    disk of their own, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="memloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, is columnar (later reads
    prune columns) and fixes the result of non-repeatable steps such as range
    partitioning with sampled bounds. The tables go when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized = path
    return out


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, for tables that a query keeps by name; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/memloom/{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN.append((spark, path))
    return path


def drop(*frames: DataFrame) -> None:
    """Delete materialized tables that nothing unfinished reads any more: loops call this for superseded
    states. Frames that aren't from ``materialize`` are left alone."""
    for df in frames:
        path = getattr(df, "_materialized", None)
        for item in [x for x in _WRITTEN if x[1] == path]:
            _remove(*item)
            _WRITTEN.remove(item)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            _remove(spark, path)
        except Exception:  # the session is gone already
            return


def slots(spark: SparkSession, factor: int = 3) -> int:
    """Partitions for compute-bound stages: a few per core of the whole cluster."""
    return max(1, spark.sparkContext.defaultParallelism * factor)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
