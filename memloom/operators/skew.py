"""Per-key results over tables in which a few keys hold most of the rows.

Rows are range partitioned on the composite of key and secondary order. Spark
samples the quantiles of that composite, so a heavy key is cut into as many
partitions as its share of the rows asks for. Each partition makes one partial
state for every key in it; only the first and the last key of a partition can
go on in a neighbour, and those boundary states (two a partition at most) are
stitched in partition order afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.runtime import materialize, shuffle_partitions, slots


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """Positions at which a row differs from the row before; 0 is always one. Null equals null."""
    n = len(columns[0])
    changed = np.zeros(n, dtype=bool)
    if n:
        changed[0] = True
    for c in columns:
        if n > 1:
            differs = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
            null = pc.is_null(c).to_numpy(zero_copy_only=False)
            changed[1:] |= differs | (null[1:] != null[:-1])
    return np.flatnonzero(changed)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def range_split(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Range partition on keys + order by sampled quantiles; partitions come out sorted."""
    n = partitions or max(shuffle_partitions(df.sparkSession), slots(df.sparkSession, 2))
    return df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)


def key_profile(df: DataFrame, keys: list[str], other: str, weight: str, tie: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """For every key: ``n_rows``, ``weight_sum`` (null if no row has a weight), ``n_others`` (distinct
    non-null values of ``other``), ``first_other`` and ``last_other`` in its order.

    Null keys form a key of their own; an empty table gives an empty result; repeated rows count as
    often as they are there. Columns besides the named ones are not read. ``tie`` orders rows of equal key and
    ``other``, so that a pair that is there very often is cut over partitions too; without it such rows are
    spread by a number of their own.
    """
    if not tie:
        df, tie = df.withColumn("_tie", F.monotonically_increasing_id()), ["_tie"]
    work = df.select(*keys, F.col(other).alias("_other"), F.col(weight).cast("double").alias("_weight"), *tie)
    key_fields = [work.schema[k] for k in keys]
    state = T.StructType(
        [
            *key_fields,
            T.StructField("pid", T.IntegerType()),
            T.StructField("edge", T.BooleanType()),
            T.StructField("n_rows", T.LongType()),
            T.StructField("n_weights", T.LongType()),
            T.StructField("weight_sum", T.DoubleType()),
            T.StructField("n_others", T.LongType()),
            T.StructField("first_other", T.StringType()),
            T.StructField("last_other", T.StringType()),
        ]
    )

    def partials(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        held: list | None = None  # the run that may go on in the next batch
        first = True

        def out(runs, edges):
            n = len(runs)
            columns = list(zip(*runs))
            arrays = [pa.array(columns[i], type=pa_types[i]) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays(
                [*arrays, pa.array([pid] * n, pa.int32()), pa.array(edges, pa.bool_()), *(pa.array(columns[len(keys) + j], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.string())))],
                names=state.names,
            )

        pa_types: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key_columns = [_column(batch, k) for k in keys]
            pa_types = pa_types or [c.type for c in key_columns]
            others = _column(batch, "_other").cast(pa.string())
            weights = _column(batch, "_weight")
            starts = _changes(key_columns)
            ends = np.append(starts[1:], batch.num_rows)
            pairs = np.zeros(batch.num_rows, dtype=np.int64)
            pairs[_changes([*key_columns, others])] = 1
            pairs[pc.is_null(others).to_numpy(zero_copy_only=False)] = 0
            valid = pc.is_valid(weights).to_numpy(zero_copy_only=False).astype(np.int64)
            value = np.nan_to_num(pc.fill_null(weights, 0.0).to_numpy(zero_copy_only=False), nan=0.0)
            n_valid, total, distinct = (np.add.reduceat(x, starts) for x in (valid, value, pairs))
            names = [c.take(pa.array(starts)).to_pylist() for c in key_columns]
            first_other = others.take(pa.array(starts)).to_pylist()
            last_other = others.take(pa.array(ends - 1)).to_pylist()
            runs = [[*(k[i] for k in names), int(ends[i] - starts[i]), int(n_valid[i]), float(total[i]), int(distinct[i]), first_other[i], last_other[i]] for i in range(len(starts))]
            k = len(keys)
            if held is not None and held[:k] == runs[0][:k]:
                runs[0] = held[:k] + _merge(held[k:], runs[0][k:])
            elif held is not None:
                runs.insert(0, held)
            held = runs.pop()
            if runs:
                yield out(runs, [first] + [False] * (len(runs) - 1))
                first = False
        if held is not None:
            yield out([held], [True])

    split = range_split(work, keys, ["_other", *tie], partitions)
    states = materialize(split.mapInArrow(partials, state), "profile")
    names = ["n_rows", "n_weights", "weight_sum", "n_others", "first_other", "last_other"]
    inner = states.where(~F.col("edge")).select(*keys, *names)
    # At most two rows a partition: gathering a key's boundary states is bounded by the number of partitions.
    parts = states.where("edge").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pid", *names))).alias("s"))
    merged = F.aggregate(
        F.slice("s", 2, F.size("s")),
        F.struct(*(F.col("s")[0][n].alias(n) for n in names)),
        lambda a, b: F.struct(
            (a.n_rows + b.n_rows).alias("n_rows"),
            (a.n_weights + b.n_weights).alias("n_weights"),
            (a.weight_sum + b.weight_sum).alias("weight_sum"),
            (a.n_others + b.n_others - F.coalesce((a.last_other == b.first_other).cast("long"), F.lit(0))).alias("n_others"),
            a.first_other.alias("first_other"),
            b.last_other.alias("last_other"),
        ),
    )
    stitched = parts.withColumn("m", merged).select(*keys, *(F.col("m")[n].alias(n) for n in names))
    return inner.unionByName(stitched).select(*keys, "n_rows", F.when(F.col("n_weights") > 0, F.col("weight_sum")).alias("weight_sum"), "n_others", "first_other", "last_other")


def _merge(a: list, b: list) -> list:
    same = a[5] is not None and a[5] == b[4]
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3] - same, a[4], b[5]]


def stitched_rank(df: DataFrame, keys: list[str], order: list[str], size: str | None = None, rank: str = "rank", running: str = "running", partitions: int | None = None) -> DataFrame:
    """Adds the 1-based ``rank`` of a row in its key and, with ``size``, the sum of ``size`` up to and
    with the row, as a window function over the key would, but with heavy keys cut over partitions.

    ``order`` must be total for a repeatable result; null sizes count as 0.
    """
    base = df.drop(rank, running)
    value = F.coalesce(F.col(size).cast("long"), F.lit(0)) if size else F.lit(0).cast("long")
    split = range_split(base.withColumn("_size", value), keys, order, partitions)
    schema = T.StructType([*split.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_run", T.LongType()), T.StructField(rank, T.LongType()), T.StructField(running, T.LongType())])

    def number(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last, count, total, run = None, 0, 0, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [_column(batch, k) for k in keys]
            starts = _changes(columns)
            at = np.arange(batch.num_rows, dtype=np.int64)
            group = np.searchsorted(starts, at, side="right") - 1
            sums = np.cumsum(_column(batch, "_size").to_numpy(zero_copy_only=False))
            before = np.append(0, sums)[starts]
            ranks, runs = at - starts[group] + 1, sums - before[group]
            head = [c[0].as_py() for c in columns]
            go_on = head == last
            if go_on:
                ranks[group == 0] += count
                runs[group == 0] += total
            numbers = group + run + (0 if go_on else 1)
            last, count, total, run = [c[-1].as_py() for c in columns], int(ranks[-1]), int(runs[-1]), int(numbers[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, pid, np.int32)), pa.array(numbers), pa.array(ranks), pa.array(runs)], names=schema.names)

    local = materialize(split.mapInArrow(number, schema), "rank")
    # One row a partition: what its last key has reached, and whether that key fills the whole partition.
    tails = local.groupBy("_pid").agg(
        F.max_by(F.struct(*keys, F.col(rank).alias("_n"), F.col(running).alias("_s"), "_run"), F.struct("_run", rank)).alias("t"),
        F.min_by(F.struct(*keys), F.struct("_run", rank)).alias("h"),
    )
    carry: list[tuple[int, int, int]] = []
    key, n, s = None, 0, 0
    for row in tails.orderBy("_pid").collect():  # as many rows as partitions
        head, tail = tuple(row.h), tuple(row.t[k] for k in keys)
        if key is None or head != key:
            n, s = 0, 0
        if n or s:
            carry.append((row._pid, n, s))
        n, s = (n + row.t._n, s + row.t._s) if row.t._run == 0 else (row.t._n, row.t._s)
        key = tail
    spark = df.sparkSession
    offsets = spark.createDataFrame(carry, "_pid int, _n long, _s long")
    add = lambda c: F.coalesce(F.when(F.col("_run") == 0, F.col(c)), F.lit(0))
    out = local.join(F.broadcast(offsets), "_pid", "left").withColumn(rank, F.col(rank) + add("_n")).withColumn(running, F.col(running) + add("_s"))
    return out.select(*base.columns, rank, *([running] if size else []))


def heavy_keys(profile: DataFrame, total_by: list[str], share: float) -> DataFrame:
    """Keys of ``key_profile`` that hold at least ``share`` of all rows of their side."""
    totals = profile.groupBy(*total_by).agg(F.sum("n_rows").alias("_total"))
    return profile.join(totals, total_by).where(F.col("n_rows") >= F.col("_total") * share).drop("_total")


def top_per_key(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of every key; Spark's window group limit drops the rest before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
