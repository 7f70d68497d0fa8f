"""The k most similar vectors of every vector, by robust-pruned directed graphs over shards.

A k-means of a sample (bounded by the number of shards) cuts the space into shards of a bounded size. In every shard a directed
graph is grown in two passes: a greedy beam search proposes neighbours for a batch of vectors, and
relaxed distance pruning keeps those that no kept one is much nearer to, so long edges survive beside
short ones; edges are added in both directions and pruned again where there are too many. The second
pass searches the whole graph of the shard and gives each vector its neighbours there. Every vector is
also sent, as a query, to the next nearest shards and beam-searched in their graphs; a hit counts for
both ends. All vectors are indexed and all are queries.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.runtime import materialize, slots

SAMPLE = 16_384  # vectors the shards' centres are fitted on
SHARD, LARGE_SHARD, SHARDS = 4_096, 65_536, 64  # vectors a shard should have: n / SHARDS within the two bounds
SAMPLED = 32  # vectors of the sample a shard needs at least
LARGEST = 3  # a shard of more than so many times its size is cut at random, and queries for it search all its parts
SALT = 100_000  # rows of equal vectors one task is given at once
DEGREE, SLACK, BEAM, RELAX = 16, 8, 32, 1.2


def prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Robust pruning for many vectors at once: (n, degree) ids, -1 where there are fewer.

    ``cand`` (n, c) holds proposals, -1 for none. In order of nearness a proposal is kept, and all
    others that are nearer to it than to the vector, by more than the factor ``relax``, go.
    """
    n, c = cand.shape
    safe = np.maximum(cand, 0)
    points = x[safe]
    sims = np.matmul(points, x[own][:, :, None])[:, :, 0]
    sims[(cand < 0) | (cand == own[:, None])] = -3.0
    order = np.argsort(-sims, axis=1)
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    same = (cand[:, 1:] == cand[:, :-1]) & (sims[:, 1:] > -2)
    sims[:, 1:][same] = -3.0
    points = np.take_along_axis(points, order[:, :, None], 1)
    between = 2.0 - 2.0 * np.matmul(points, points.transpose(0, 2, 1))
    to = 2.0 - 2.0 * sims
    alive = sims > -2
    kept = np.full((n, degree), -1, dtype=np.int32)
    count = np.zeros(n, dtype=np.int64)
    rows = np.arange(n)
    for i in range(c):
        use = alive[:, i] & (count < degree)
        if not use.any():
            continue
        kept[rows[use], count[use]] = cand[use, i]
        count += use
        alive &= ~(use[:, None] & (relax * relax * between[:, i, :] <= to))
        alive[:, : i + 1] = False
    return kept


class Graph:
    """A robust-pruned graph over the unit vectors ``x`` of one shard."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, slack: int = SLACK, beam: int = BEAM, relax: float = RELAX, batch: int = 512, seed: int = 7):
        self.x, self.degree, self.width, self.beam = x, degree, degree + slack, beam
        n = len(x)
        self.nbr = np.full((n, self.width), -1, dtype=np.int32)
        self.deg = np.zeros(n, dtype=np.int64)
        rng = np.random.default_rng(seed)
        self.order = rng.permutation(n).astype(np.int32)
        self.entries = self.order[: min(32, n)]
        self.near = np.full((n, beam), -1, dtype=np.int32)
        self.near_sim = np.full((n, beam), -2.0, dtype=np.float32)
        start = 1
        while start < n:  # batches never larger than what the graph has already
            stop = min(n, start + min(batch, start))
            self._insert(self.order[start:stop], 1.0, limit=start)
            start = stop
        for start in range(0, n, batch):
            self._insert(self.order[start : start + batch], relax, limit=n, keep=True)

    def search(self, q: np.ndarray, beam: int, own: np.ndarray | None = None, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for all rows of ``q`` in step: (ids, similarities), nearest first, -1 where there are fewer."""
        n, m = len(self.x), len(q)
        entries = self.entries if limit is None else self.entries[: max(1, min(len(self.entries), limit))]
        ids = np.full((m, beam), -1, dtype=np.int32)
        sims = np.full((m, beam), -2.0, dtype=np.float32)
        done = np.ones((m, beam), dtype=bool)
        visited = np.zeros((m, n), dtype=bool)
        if own is not None:
            visited[np.arange(m), own] = True
        begin = q @ self.x[entries].T
        if own is not None:
            begin[own[:, None] == entries[None, :]] = -2.0
        take = min(4, len(entries), beam)
        best = np.argsort(-begin, axis=1)[:, :take]
        ids[:, :take] = entries[best]
        sims[:, :take] = np.take_along_axis(begin, best, 1)
        ids[sims <= -2.0] = -1
        done[:, :take] = ids[:, :take] < 0
        visited[np.arange(m)[:, None], entries[best]] = True
        if own is not None and take:
            # A vector that is an entry itself starts from its neighbours.
            for r in np.flatnonzero((ids[:, :take] < 0).all(1)):
                first = self.nbr[own[r]][: self.deg[own[r]]][:beam]
                ids[r, : len(first)], sims[r, : len(first)] = first, self.x[first] @ q[r]
                done[r, : len(first)] = False
                visited[r, first] = True
        active = np.flatnonzero(~done.all(1))
        while len(active):
            at = np.argmax(~done[active], axis=1)
            node = ids[active, at]
            done[active, at] = True
            around = self.nbr[node]
            fresh = (around >= 0) & ~visited[active[:, None], np.maximum(around, 0)]
            row, col = np.nonzero(fresh)
            found = around[row, col]
            visited[active[row], found] = True
            value = np.full(around.shape, -2.0, dtype=np.float32)
            value[row, col] = np.einsum("nd,nd->n", self.x[found], q[active[row]])
            all_sims = np.concatenate([sims[active], value], 1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[active] = np.take_along_axis(all_sims, top, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, around, -1)], 1), top, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], 1), top, 1)
            active = active[~done[active].all(1)]
        return ids, sims

    def _insert(self, batch: np.ndarray, relax: float, limit: int, keep: bool = False) -> None:
        ids, sims = self.search(self.x[batch], self.beam, own=batch, limit=limit)
        if keep:
            self.near[batch], self.near_sim[batch] = ids, sims
        cand = np.concatenate([ids, self.nbr[batch]], 1)
        kept = prune(self.x, batch, cand, self.degree, relax)
        self.nbr[batch] = -1
        self.nbr[batch, : self.degree] = kept
        self.deg[batch] = (kept >= 0).sum(1)
        # The way back, for all targets at once.
        row, col = np.nonzero(kept >= 0)
        target, source = kept[row, col], batch[row]
        there = (self.nbr[target] == source[:, None]).any(1)
        target, source = target[~there], source[~there]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        if not len(target):
            return
        uniq, first, n_new = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, n_new)
        new = np.full((len(uniq), int(n_new.max())), -1, dtype=np.int32)
        new[np.repeat(np.arange(len(uniq)), n_new), place] = source
        fits = self.deg[uniq] + n_new <= self.width
        fit_row = np.repeat(fits, n_new)
        self.nbr[target[fit_row], self.deg[target[fit_row]] + place[fit_row]] = source[fit_row]
        self.deg[uniq[fits]] += n_new[fits]
        over = uniq[~fits]
        if len(over):
            kept = prune(self.x, over, np.concatenate([self.nbr[over], new[~fits]], 1), self.degree, relax)
            self.nbr[over] = -1
            self.nbr[over, : self.degree] = kept
            self.deg[over] = (kept >= 0).sum(1)


def shard_size(n: int) -> int:
    """Vectors a shard should have, of n."""
    return max(SHARD, min(LARGE_SHARD, -(-n // SHARDS)))


def probes_for(shards: int, min_cosine: float) -> int:
    """Shards a vector is searched in, its own included; it follows the number of shards, so that recall doesn't
    fall as they get more. Neighbours above a high floor are nearer, and fewer shards have them."""
    root = shards**0.5
    return min(shards, max(3, round(0.4 * root)) if min_cosine >= 0.8 else 2 + round(1.2 * root))


def beam_for(shard: int, min_cosine: float) -> int:
    """Candidates a search keeps. Without a high floor it follows the root of the shard: far neighbours are many and
    alike, and a narrow beam misses more of them in a larger graph."""
    return BEAM if min_cosine >= 0.8 else max(BEAM, round(BEAM * (shard / 1024) ** 0.5))


def _unit_rows(c: np.ndarray) -> np.ndarray:
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _halves(sample: np.ndarray, group: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """A group of the sample cut at the median along its main axis."""
    own = sample[group] - sample[group].mean(0)
    axis = rng.standard_normal(own.shape[1]).astype(np.float32)
    for _ in range(6):
        axis = own.T @ (own @ axis)
        axis /= np.linalg.norm(axis) + 1e-12
    order = np.argsort(own @ axis, kind="stable")
    return group[order[: len(group) // 2]], group[order[len(group) // 2 :]]


def fit_centres(sample: np.ndarray, k: int, rounds: int = 5, seed: int = 11, at_once: int = 256) -> np.ndarray:
    """Centres of about k shards of about equal size: halving at the median along the main axis, then a few
    k-means rounds, then groups of more than twice the mean are halved again, so a dense region gets centres of
    its own. Many centres are fitted in two steps, first few, then some in the region of each."""
    if k > at_once:
        few = fit_centres(sample, int(k**0.5), rounds, seed, at_once)
        at = np.argmax(sample @ few.T, axis=1)
        parts = [sample[at == i] for i in range(len(few))]
        return np.concatenate([fit_centres(p, max(1, round(k * len(p) / len(sample))), rounds, seed, at_once) for p in parts if len(p)])
    groups = [np.arange(len(sample))]
    rng = np.random.default_rng(seed)
    while len(groups) < k:
        groups.sort(key=len)
        big = groups.pop()
        if len(big) < 2:
            groups.append(big)
            break
        groups += _halves(sample, big, rng)
    centres = _unit_rows(np.stack([sample[g].mean(0) for g in groups]))
    for _ in range(rounds):
        at = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        empty = np.bincount(at, minlength=len(centres)) == 0
        centres = np.where(empty[:, None], centres, _unit_rows(sums)).astype(np.float32)
    at = np.argmax(sample @ centres.T, axis=1)
    most = max(2, 2 * len(sample) / len(centres))
    done, todo = [], [(centres[i], np.flatnonzero(at == i)) for i in range(len(centres))]
    while todo:
        centre, group = todo.pop()
        if len(group) > most:
            todo += [(_unit_rows(sample[h].mean(0)[None, :])[0], h) for h in _halves(sample, group, rng)]
        else:
            done.append(centre)
    return np.stack(done)


def _placed(weights: dict[int, float], tasks: int, spark) -> dict[int, int]:
    """A value for every shard such that a hash partitioning on it puts the shards, heaviest first, into the
    task with the least so far."""
    keys: dict[int, int] = {}
    span = 0
    while len(keys) < tasks:  # the partitioner's own hash says which values go where
        for r in spark.range(span, span + 16 * tasks).select(F.col("id").cast("int").alias("v"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks)).alias("t")).collect():
            keys.setdefault(r.t, r.v)
        span += 16 * tasks
    heap = [(0.0, t) for t in range(tasks)]
    out = {}
    for shard in sorted(weights, key=lambda s: (-weights[s], s)):
        load, t = heapq.heappop(heap)
        out[shard] = keys[t]
        heapq.heappush(heap, (load + weights[shard], t))
    return out


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, key, vec): the values as float32 bytes, for rows whose vector has ``dim`` finite values, not
    all zero. ``key`` is equal for equal vectors."""
    v = F.col(vector_col).cast("array<float>")
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)

    def pack(batches):
        for batch in batches:
            raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            values = [r.tobytes() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh128_digest(x) for x in values], pa.binary()), pa.array(values, pa.binary())], names=["id", "key", "vec"])

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col)).where(good).select("id", v.alias("v")).mapInArrow(pack, "id string, key binary, vec binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    return _unit(np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim))


def _unit(raw: np.ndarray) -> np.ndarray:
    """Scaled by the greatest value first, so that very large and very small vectors keep their direction."""
    x = raw.astype(np.float64)
    if len(x):
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def nearest_vectors(df: DataFrame, id_col: str, vector_col: str, k: int = 5, min_cosine: float = -1.0, dim: int = 64, probes: int | None = None, shard: int | None = None, beam: int | None = None) -> DataFrame:
    """``id, neighbour, cosine, rank``: up to ``k`` most similar ids of every id with a usable vector,
    those with at least ``min_cosine`` only, nearest first, ties by the smaller id.

    ``df`` has one row an id. Vectors that are null, empty, of another length, all zero or not finite
    have no row and are nobody's neighbour. Equal vectors are indexed once and each of them gets the
    smallest ids of its equals first. An empty table gives no rows; other columns aren't read.
    """
    spark = df.sparkSession
    vectors = materialize(usable_vectors(df, id_col, vector_col, dim), "vectors")
    classes = vectors.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("m"))
    # One vector a class goes on; the id of the class is its smallest member.
    reps = vectors.join(classes.select(F.col("first").alias("id")), "id", "left_semi").select(F.col("id").alias("cid"), "vec")
    n = classes.count()
    schema = "id string, neighbour string, cosine double, rank int"
    if not n:
        return spark.createDataFrame([], schema)
    shard = shard or shard_size(n)
    beam = beam or beam_for(shard, min_cosine)
    wanted = -(-n // shard)
    sampled = max(SAMPLE, SAMPLED * wanted)
    # Drawn by the hash of the value, so a vector that is there many times is in the sample once or not at all.
    sample = vectors.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000_000)) < int(min(1.0, sampled / n) * 1_000_000_000)).dropDuplicates(["key"]).select("vec").limit(2 * sampled).collect()
    points = _unit(np.frombuffer(b"".join(bytes(r.vec) for r in sample), dtype=np.float32).reshape(-1, dim)).astype(np.float32)
    centres = fit_centres(points, wanted) if wanted > 1 and len(points) else np.zeros((1, dim), np.float32)
    p = min(probes or probes_for(len(centres), min_cosine), len(centres))
    held = spark.sparkContext.broadcast(centres)  # dim floats a shard of LARGE_SHARD vectors

    def route(batches):
        c = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = _matrix(part.column(1), dim).astype(np.float32)
                near = x @ c.T
                to = np.argpartition(-near, p - 1, axis=1)[:, :p]
                to = np.take_along_axis(to, np.argsort(-np.take_along_axis(near, to, 1), axis=1, kind="stable"), 1).astype(np.int32)
                row = np.repeat(np.arange(len(x)), p)
                yield pa.RecordBatch.from_arrays([pa.array(to.ravel()), pa.array(np.tile(np.arange(p, dtype=np.int32), len(x))), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], names=["shard", "turn", "cid", "vec"])

    routed = materialize(reps.select("cid", "vec").mapInArrow(route, "shard int, turn int, cid string, vec binary"), "routed")
    counts = routed.groupBy("shard").agg(F.count_if(F.col("turn") == 0).alias("members"), F.count("*").alias("rows")).collect()  # a row a centre
    tasks = max(1, min(len(centres) * 2, max(slots(spark, 3), len(centres) // 4)))
    largest = LARGEST * shard
    # A member is put into the graph and searched, which takes about three times a guest's search.
    place = _placed({r.shard: r.rows + 2.0 * r.members for r in counts}, tasks, spark)
    shown_parts = spark.createDataFrame([(r.shard, max(1, -(-r.members // largest)), place[r.shard]) for r in counts], "shard int, parts int, task int")
    own = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    spread = routed.join(F.broadcast(shown_parts), "shard").select(
        "shard", "task", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), own.alias("own"), "turn", "cid", "vec"
    ).select("shard", "task", "part", ((F.col("turn") == 0) & (F.col("part") == F.col("own"))).alias("member"), "cid", "vec")
    ready = spread.repartition(tasks, "task").select("shard", "part", "member", "cid", "vec").sortWithinPartitions("shard", "part", F.desc("member"), "cid")

    def hits(ids_a, ids_b, sims):
        return pa.RecordBatch.from_arrays([pa.array(ids_a, pa.string()), pa.array(ids_b, pa.string()), pa.array(sims, pa.float64())], names=["a", "b", "cosine"])

    def exact(xa, xb):
        return np.einsum("nd,nd->n", xa, xb)

    def scan(batches):
        at, names, rows, graph, x = None, [], [], None, None
        floor = min_cosine - 1e-5

        def build():
            nonlocal graph, x
            x = np.concatenate(rows)
            graph = Graph(x.astype(np.float32), beam=beam)
            order = np.argsort(-graph.near_sim, axis=1, kind="stable")[:, : k + 3]
            near, sim = np.take_along_axis(graph.near, order, 1), np.take_along_axis(graph.near_sim, order, 1)
            r, c = np.nonzero((near >= 0) & (sim >= floor))
            if len(r):
                return hits([names[i] for i in r.tolist()] + [names[i] for i in near[r, c].tolist()], [names[i] for i in near[r, c].tolist()] + [names[i] for i in r.tolist()], np.tile(exact(x[r], x[near[r, c]]), 2))

        for batch in batches:
            if not batch.num_rows:
                continue
            shard_no, part_no, member = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            member = member.astype(bool)
            cut = np.flatnonzero(np.append(True, (shard_no[1:] != shard_no[:-1]) | (part_no[1:] != part_no[:-1]) | (member[1:] != member[:-1])))
            for lo, hi in zip(cut, np.append(cut[1:], batch.num_rows)):
                group = (int(shard_no[lo]), int(part_no[lo]))
                if group != at:
                    if rows and graph is None and (out := build()) is not None:
                        yield out
                    at, names, rows, graph = group, [], [], None
                block = batch.slice(lo, hi - lo)
                ids, vec = block.column(3).to_pylist(), _matrix(block.column(4), dim)
                if member[lo]:
                    names += ids
                    rows.append(vec)
                    continue
                if not rows:
                    continue  # a part without members
                if graph is None and (out := build()) is not None:
                    yield out
                for s in range(0, len(ids), 512):
                    near, sim = graph.search(vec[s : s + 512].astype(np.float32), beam)
                    near, sim = near[:, : k + 3], sim[:, : k + 3]
                    r, c = np.nonzero((near >= 0) & (sim >= floor))
                    if len(r):
                        mine, theirs = [ids[s + i] for i in r.tolist()], [names[i] for i in near[r, c].tolist()]
                        yield hits(mine + theirs, theirs + mine, np.tile(exact(vec[s + r], x[near[r, c]]), 2))
        if rows and graph is None and (out := build()) is not None:
            yield out

    links = ready.mapInArrow(scan, "a string, b string, cosine double").where(F.col("cosine") >= min_cosine).where("a <> b")
    ranked = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    best = links.dropDuplicates(["a", "b"]).withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k).select("a", "b", "cosine")
    best = materialize(best, "best")
    # Back from classes to ids: the k + 1 smallest members stand for a class wherever it is a neighbour. Rows of
    # a class are dealt out over salts, and what each of them is given is repeated for every salt.
    many = classes.where("m > 1").select("key", F.col("first").alias("cid"), F.ceil(F.col("m") / SALT).cast("int").alias("salts"))
    several = materialize(vectors.join(many, "key").select("id", "cid", "salts", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt")), "copies")
    in_class = Window.partitionBy("cid").orderBy("id")  # cut to k + 1 rows a task before its shuffle
    shown = materialize(several.withColumn("r", F.row_number().over(in_class)).where(F.col("r") <= k + 1).select("cid", F.col("id").alias("neighbour"), "salts"), "shown")
    each = shown.select("cid", "salts").distinct()
    to_many = best.join(shown.select(F.col("cid").alias("b"), "neighbour"), "b").select("a", "neighbour", "cosine")
    to_one = best.join(each.select(F.col("cid").alias("b")), "b", "left_anti").select("a", F.col("b").alias("neighbour"), "cosine")
    towards = to_one.unionByName(to_many)
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    members = several.select("id", "cid", "salt")
    from_many = members.join(salted(towards.withColumnRenamed("a", "cid").join(each, "cid")), ["cid", "salt"]).select("id", "neighbour", "cosine")
    from_one = towards.join(each.select(F.col("cid").alias("a")), "a", "left_anti").select(F.col("a").alias("id"), "neighbour", "cosine")
    equals = members.join(salted(shown), ["cid", "salt"]).where("id <> neighbour").select("id", "neighbour", F.lit(1.0).alias("cosine"))
    final = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return from_one.unionByName(from_many).unionByName(equals).withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("id", "neighbour", "cosine", "rank")
