"""Filling containers of fixed capacity: shortest-pack-first over the histogram of lengths.

Only the histogram, at most ``capacity`` rows, comes to the driver. Lengths are placed from the
longest down: each goes to the packs with the least in them that still have room for it, many packs
at a time, and what finds no room opens new packs. The result is a list of packing patterns with
counts; the slots of the patterns give every (length, rank) its container, and documents are joined
to them by their rank among the documents of that length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators.skew import stitched_rank
from memloom.runtime import materialize

CAPACITY = 4096


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns (number of packs, lengths in each) for lengths 1..capacity with their counts."""
    groups: dict[int, list[list]] = {}  # sum of lengths -> [[count, lengths], ...]
    sums: list[int] = []  # ascending

    def put(total: int, count: int, lengths: list[int]) -> None:
        if total not in groups:
            groups[total] = []
            insort(sums, total)
        groups[total].append([count, lengths])

    for length in sorted((k for k, v in histogram.items() if v > 0), reverse=True):
        left = histogram[length]
        while left and sums and sums[0] <= capacity - length:
            total = sums[0]
            entry = groups[total][-1]
            used = min(left, entry[0])
            entry[0] -= used
            grown = [*entry[1], length]
            if not entry[0]:
                groups[total].pop()
                if not groups[total]:
                    del groups[total]
                    sums.pop(bisect_left(sums, total))
            put(total + length, used, grown)
            left -= used
        if left:
            # As many of the length as go into a pack, then one pack for the rest.
            each = max(1, capacity // length)
            full, rest = divmod(left, each)
            if full:
                put(each * length, full, [length] * each)
            if rest:
                put(rest * length, 1, [length] * rest)
    return [(count, lengths) for total in sums for count, lengths in groups[total]]


def slots_of(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, last rank, first container): consecutive ranks go to consecutive containers."""
    out, next_rank, base = [], {}, 0
    for count, lengths in patterns:
        for length in lengths:
            first = next_rank.get(length, 1)
            out.append((length, first, first + count - 1, base))
            next_rank[length] = first + count
        base += count
    return sorted(out)


def pack_items(sizes: DataFrame, id_col: str, size_col: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """``id_col, part, part_tokens, container``: one row for every item, or for each part of an item
    over the capacity, which is cut into parts of ``capacity`` and a rest.

    Items of null or no size take no room and come out with container -1. Repeated rows are items of
    their own; an empty table gives no rows; other columns aren't read.
    """
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long")
    whole = sizes.select(F.col(id_col), size.alias("_size"))
    parts = whole.select(id_col, F.posexplode(F.expr(f"CASE WHEN _size <= {capacity} THEN array(_size) ELSE concat(array_repeat(CAST({capacity} AS BIGINT), CAST(_size div {capacity} AS INT)), filter(array(_size % {capacity}), x -> x > 0)) END")).alias("part", "part_tokens"))
    parts = materialize(parts, "parts")
    histogram = {r.part_tokens: r.n for r in parts.where("part_tokens > 0").groupBy("part_tokens").agg(F.count("*").alias("n")).collect()}
    slots = slots_of(pack_histogram(histogram, capacity))
    # Ranks within a length; the hot length is cut over partitions like any heavy key.
    ranked = stitched_rank(parts.where("part_tokens > 0"), ["part_tokens"], [id_col, "part"])
    # (length, last rank) as one ascending number: the slot of an item is the first that isn't below it.
    top = max(histogram.values(), default=0) + 1
    ends = np.array([length * top + last for length, _, last, _ in slots], dtype=np.int64)
    shift = np.array([first_container - first for _, first, _, first_container in slots], dtype=np.int64)
    held = sizes.sparkSession.sparkContext.broadcast((ends, shift))  # a row a slot, bounded by patterns x lengths in a pack

    def place(batches):
        last, move = held.value
        for batch in batches:
            length = batch.column(2).to_numpy()
            rank = batch.column(3).to_numpy()
            at = np.searchsorted(last, length * top + rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rank + move[at])], names=[id_col, "part", "part_tokens", "container"])

    kind = sizes.schema[id_col].dataType.simpleString()
    placed = ranked.select(id_col, "part", "part_tokens", "rank").mapInArrow(place, f"`{id_col}` {kind}, part int, part_tokens bigint, container bigint")
    empty = parts.where("part_tokens = 0").select(id_col, "part", "part_tokens", F.lit(-1).cast("long").alias("container"))
    return placed.unionByName(empty)


def container_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, unused tokens, share used."""
    used = packed.where("container >= 0").groupBy("container").agg(F.sum("part_tokens").alias("n"))
    return used.agg(F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(capacity - F.col("n")), F.lit(0)).alias("unused"), F.max("n").alias("fullest")).withColumn("share_used", F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * capacity)))
