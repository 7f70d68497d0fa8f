"""k nearest vectors of one query or a few: exact scan, filtered scan, inverted-file index."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions.vector import similarity_score, with_cosine
from memloom.operators.filters import Filter, apply_filter
from memloom.runtime import materialize


@dataclass(frozen=True)
class IndexParams:
    """Kinds: flat, ivf, auto (ivf from ``min_vectors`` on). A graph index ("hnsw") isn't offered: over a cluster its
    search is one that follows links from task to task, and ivf gives the same recall in one pass."""

    kind: str = "auto"
    nlist: int = 100
    nprobe: int = 24
    min_vectors: int = 5000
    sample: int = 20_000

    def __post_init__(self):
        if self.kind not in ("flat", "ivf", "auto"):
            raise ValueError(f"index kind {self.kind!r}")
        if self.nlist < 1 or self.nprobe < 1:
            raise ValueError("nlist and nprobe start at 1")


def check_dimension(vectors: DataFrame, dim: int, vector_col: str = "embedding") -> DataFrame:
    """Fails the job if a stored vector has another length; nulls pass."""
    bad = F.col(vector_col).isNotNull() & (F.size(vector_col) != dim)
    return vectors.where(F.assert_true(~bad, F.lit(f"a vector has not {dim} values")).isNull())


def embedded(nodes: DataFrame, vector_col: str = "embedding") -> DataFrame:
    return nodes.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0))


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``id, score, cosine``: the k nearest rows whose vector has the query's length. Reported scores are
    clamped to [0, 1]; the order goes by the cosine itself, ties by id. k = 0 gives no rows."""
    rows = vectors.where(F.size(vector_col) == len(query)).select(F.col(id_col).alias("id"), vector_col)
    scored = with_cosine(rows, vector_col, query)
    return scored.select("id", similarity_score(F.col("cosine")).alias("score"), "cosine").orderBy(F.desc("cosine"), "id").limit(k)


def knn_filtered(nodes: DataFrame, query: list[float], test: Filter, k: int) -> DataFrame:
    """The filter comes first, so the k nearest of the rows that pass are found."""
    return knn(apply_filter(nodes, test), query, k)


def _near(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows with queries, (rows, queries); 0 where one has no direction."""
    with np.errstate(all="ignore"):
        c = (x @ q.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :])
    return np.where(np.isfinite(c), c, 0.0)


def _best(ids: pa.Array, cosines: np.ndarray, names: list, k: int) -> pa.RecordBatch | None:
    """(query_id, id, cosine) of a batch's rows that may be among the k nearest, ties with the k-th included."""
    n = len(cosines)
    if not n:
        return None
    kth = np.partition(cosines, n - k, axis=0)[n - k] if n > k else np.full(cosines.shape[1], -2.0)
    row, col = np.nonzero(cosines >= kth[None, :])
    return pa.RecordBatch.from_arrays([pa.array([names[i] for i in col.tolist()], ids.type), ids.take(pa.array(row)), pa.array(cosines[row, col])], names=["query_id", "id", "cosine"])


def _top(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")  # cut to k rows a query and task before its shuffle
    ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "id", similarity_score(F.col("cosine")).alias("score"), "cosine", "rank")


def knn_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "embedding", dim: int = 64, block: int = 2048) -> DataFrame:
    """``query_id, id, score, cosine, rank``: the k nearest other rows of every query, exact, for a query set that may be large.

    Queries (same two columns) are taken in blocks of about ``block`` by the hash of their id; a block is one matrix
    in every task, a pass over the vectors is one product a batch, and only what may be among the k nearest
    leaves a task. Vectors of another length take no part; ids are those of one table, so no query finds itself.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    named = lambda df: df.where(F.size(vector_col) == dim).select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    rows, asked = named(vectors), materialize(named(queries), "queries")
    blocks = -(-asked.count() // block)
    schema = f"query_id {kind}, id {kind}, cosine double"
    out = vectors.sparkSession.createDataFrame([], schema)
    for i in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()
        names, q = [r.id for r in held], np.array([r.embedding for r in held], dtype=np.float64).reshape(-1, dim)

        def scan(batches, names=names, q=q):
            own = {name: at for at, name in enumerate(names)}
            for batch in batches:
                for lo in range(0, batch.num_rows, 4096):
                    part = batch.slice(lo, 4096)
                    c = _near(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), q)
                    for at, name in enumerate(part.column(0).to_pylist()):
                        if name in own:
                            c[at, own[name]] = -3.0
                    found = _best(part.column(0), c, names, k)
                    if found is not None:
                        yield found

        if names:
            out = out.unionByName(rows.mapInArrow(scan, schema).where("cosine > -2.5"))
    return _top(out, k)


class IVF:
    """Inverted-file index: lists around centres of a bounded sample; a query scans the lists nearest to it.

    ``save`` and ``open`` keep it as two tables; ``upsert`` and ``remove`` change rows, centres stay."""

    def __init__(self, vectors: DataFrame, params: IndexParams = IndexParams(), id_col: str = "id", vector_col: str = "embedding", dim: int = 64, seed: int = 3):
        self.params, self.dim = params, dim
        rows = self._named(vectors, id_col, vector_col)
        n = rows.count()
        share = min(1.0, params.sample / max(1, n))
        drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000_000)) < int(share * 1_000_000_000)).select("embedding").limit(2 * params.sample).collect()
        x = self._unit(np.array([r.embedding for r in drawn], dtype=np.float64).reshape(-1, dim))
        rng = np.random.default_rng(seed)
        k = max(1, min(params.nlist, len(x)))
        centres = x[rng.permutation(len(x))[:k]] if len(x) else np.zeros((1, dim))
        for _ in range(8 if len(x) else 0):
            at = np.argmax(x @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, at, x)
            filled = np.bincount(at, minlength=len(centres)) > 0
            centres[filled] = self._unit(sums[filled])
        self.centres = centres
        self.rows = self._listed(rows)

    def _named(self, df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        return df.where(F.size(vector_col) == self.dim).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("embedding"))

    def _listed(self, rows: DataFrame) -> DataFrame:
        held, dim = rows.sparkSession.sparkContext.broadcast(self.centres), self.dim  # nlist x dim numbers

        def assign(batches):
            for batch in batches:
                v = IVF._unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
                lists = np.argmax(v @ held.value.T, axis=1).astype(np.int32) if len(v) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists)], names=["id", "embedding", "list"])

        kind = rows.schema["id"].dataType.simpleString()
        listed = rows.mapInArrow(assign, f"id {kind}, embedding array<float>, list int")
        # By list, so that files hold few lists and a search skips the others; large lists go over several tasks.
        return materialize(listed.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list"), "ivf")

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n > 0, n, 1.0)

    def search(self, query: list[float], k: int, nprobe: int | None = None) -> DataFrame:
        q = np.asarray(query, dtype=np.float64)
        near = np.argsort(-(self.centres @ q))[: nprobe or self.params.nprobe].tolist()
        return knn(self.rows.where(F.col("list").isin([int(i) for i in near])), query, k)

    def search_many(self, queries: DataFrame, k: int, nprobe: int | None = None, id_col: str = "id", vector_col: str = "embedding", block: int = 2048) -> DataFrame:
        """``query_id, id, score, cosine, rank``, as ``knn_many``, over the ``nprobe`` lists nearest to each query."""
        asked = materialize(self._named(queries, id_col, vector_col), "queries")
        blocks = -(-asked.count() // block)
        kind, dim = asked.schema["id"].dataType.simpleString(), self.dim
        schema = f"query_id {kind}, id {kind}, cosine double"
        out = queries.sparkSession.createDataFrame([], schema)
        for i in range(blocks):
            held = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()
            if not held:
                continue
            names, q = [r.id for r in held], np.array([r.embedding for r in held], dtype=np.float64).reshape(-1, dim)
            probes = np.argsort(-(self._unit(q) @ self.centres.T), axis=1)[:, : nprobe or self.params.nprobe]
            of = {int(c): np.flatnonzero((probes == c).any(1)) for c in np.unique(probes)}

            def scan(batches, names=names, q=q, of=of):
                for batch in batches:
                    lists = batch.column(2).to_numpy()
                    for c in np.unique(lists).tolist():
                        if c not in of:
                            continue
                        part = batch.take(pa.array(np.flatnonzero(lists == c)))
                        some = [names[j] for j in of[c].tolist()]
                        near = _near(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), q[of[c]])
                        own = {name: at for at, name in enumerate(some)}
                        for at, name in enumerate(part.column(0).to_pylist()):
                            if name in own:
                                near[at, own[name]] = -3.0
                        found = _best(part.column(0), near, some, k)
                        if found is not None:
                            yield found

            out = out.unionByName(self.rows.mapInArrow(scan, schema).where("cosine > -2.5"))
        return _top(out, k)

    def upsert(self, vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> "IVF":
        """The index with rows added or put in the place of those of the same id. Another length is an error."""
        check = check_dimension(vectors, self.dim, vector_col)
        fresh = self._listed(self._named(check, id_col, vector_col))
        return self._with(self.rows.join(fresh.select("id"), "id", "left_anti").unionByName(fresh))

    def remove(self, ids: DataFrame) -> "IVF":
        return self._with(self.rows.join(ids.select("id").distinct(), "id", "left_anti"))

    def count(self) -> int:
        return self.rows.count()

    def _with(self, rows: DataFrame) -> "IVF":
        out = object.__new__(IVF)
        out.params, out.dim, out.centres, out.rows = self.params, self.dim, self.centres, materialize(rows, "ivf")
        return out

    def save(self, path: str) -> None:
        """Two tables under ``path``: centres, a row a list, and rows, a folder a list."""
        spark = self.rows.sparkSession
        centres = [(i, [float(v) for v in c], self.params.nlist, self.params.nprobe) for i, c in enumerate(self.centres)]
        self.rows.write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
        spark.createDataFrame(centres, "list int, centre array<double>, nlist int, nprobe int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")

    @staticmethod
    def open(spark: SparkSession, path: str) -> "IVF":
        """A saved index; a search reads the folders of its lists only."""
        held = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
        out = object.__new__(IVF)
        out.centres = np.array([r.centre for r in held])
        out.dim, out.params = out.centres.shape[1], IndexParams("ivf", held[0].nlist, held[0].nprobe)
        out.rows = spark.read.parquet(f"{path}/rows").select("id", "embedding", "list")
        return out


def open_or_create(spark: SparkSession, path: str, vectors: DataFrame, params: IndexParams = IndexParams("ivf"), dim: int = 64) -> IVF:
    """The index at ``path``; where there is none, one is built from ``vectors`` and saved."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/centres/_SUCCESS")
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        IVF(vectors, params, dim=dim).save(path)
    return IVF.open(spark, path)


def build_index(vectors: DataFrame, params: IndexParams = IndexParams(), dim: int = 64):
    """A function (query, k) -> rows by the kind of index that the parameters ask for."""
    flat = params.kind == "flat" or (params.kind == "auto" and vectors.where(F.size("embedding") == dim).limit(params.min_vectors).count() < params.min_vectors)
    if flat:
        return lambda query, k: knn(vectors, query, k)
    return IVF(vectors, params, dim=dim).search
