"""Vector expressions and a deterministic text embedding for use without a model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, a zero vector, or values that aren't finite."""
    n = norm(a) * norm(b)
    c = dot(a, b) / n
    return F.when((F.size(a) != F.size(b)) | (n == 0) | n.isNull() | F.isnan(c), F.lit(0.0)).otherwise(c)


def with_cosine(df: DataFrame, vector_col: str, query: list[float], name: str = "cosine") -> DataFrame:
    """Cosine of every row with one query vector, by one matrix product a batch.

    The rules of ``cosine`` hold; a null vector has a null cosine."""
    q = np.asarray(query, dtype=np.float64)
    qn = float(np.linalg.norm(q))

    def score(batches):
        for batch in batches:
            vectors = batch.column(at)
            if isinstance(vectors, pa.ChunkedArray):
                vectors = vectors.combine_chunks()
            sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
            out = np.where(sizes >= 0, 0.0, np.nan)
            rows = np.flatnonzero(sizes == len(q))
            if len(rows) and qn > 0:
                x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
                with np.errstate(all="ignore"):
                    c = (x @ q) / (np.linalg.norm(x, axis=1) * qn)
                out[rows] = np.where(np.isfinite(c), c, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, mask=sizes < 0)], names=names)

    rest = [c for c in df.columns if c != name]
    names, at = [*rest, name], rest.index(vector_col)
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(name, T.DoubleType())])
    return df.select(*rest).mapInArrow(score, schema)


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Sum of hidden * mask over tokens, divided by max(sum of mask, 1); not scaled to length 1. ``hidden`` is an array
    of equally long arrays, ``mask`` one number a token. Null where either is null, empty for no tokens."""
    pairs = F.zip_with(hidden, mask, lambda h, m: F.transform(h, lambda x: x.cast("double") * m.cast("double")))
    first = F.transform(F.get(hidden, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(pairs, F.coalesce(first, F.array().cast("array<double>")), lambda a, h: F.zip_with(a, h, lambda x, y: x + y))
    count = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double"))
    return F.when(hidden.isNotNull() & mask.isNotNull(), F.transform(total, lambda x: x / F.greatest(count, F.lit(1.0))))


def similarity_score(cosine_value: Column) -> Column:
    """What a search reports: the cosine, not below 0 and not above 1."""
    return F.least(F.greatest(cosine_value, F.lit(0.0)), F.lit(1.0))


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A unit vector of signed word counts: each word goes to one place with one sign, both by its hash.

    Null and blank texts give null. Runs in the JVM."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+"), lambda w: w != "")
    signed = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dim)).alias("at"), (F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) * 2 - 1).cast("double").alias("sign")))
    zero = F.array_repeat(F.lit(0.0), dim)
    counts = F.aggregate(signed, zero, lambda acc, x: F.transform(acc, lambda v, i: F.when(i == x["at"], v + x["sign"]).otherwise(v)))
    length = norm(counts)
    return F.when(F.size(words) > 0, F.transform(counts, lambda v: F.when(length > 0, v / length).otherwise(v).cast("float")))

