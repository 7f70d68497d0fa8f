"""Queries of the general problems 4 and 6 with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import hierarchy as H
from memloom.operators import skew
from memloom.sources.tables import norm_id, table


def p4_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = H.build_hierarchy(table(spark, sf_dir, "spans"))
    return h.select("node_id", "root_id", "depth", "in_loop", "n_descendants")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = H.build_hierarchy(table(spark, sf_dir, "spans"))
    return h.where("parent_id is not null").select(F.col("node_id").alias("span_id"), "root_id", "depth")


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = H.materialize(H.build_hierarchy(table(spark, sf_dir, "spans")), "hierarchy")
    return H.expand_paths(h).select("node_id", F.array_join("path", "/").alias("path"))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descendants of every root that heads a tree, as its SQL has them; those of every node are in p4_all_descendants."""
    h = H.materialize(H.build_hierarchy(table(spark, sf_dir, "spans")), "hierarchy")
    return H.descendants(h, h.where("depth = 0").select("node_id"))


def p4_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descendants of every node, roots and inner nodes alike."""
    h = H.materialize(H.build_hierarchy(table(spark, sf_dir, "spans")), "hierarchy")
    return H.descendants(h, h.select("node_id"))


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "edges").select(norm_id("source").alias("s"), norm_id("target").alias("t"), "weight", "seq")
    row = lambda side, key, other: F.struct(F.lit(side).alias("side"), F.col(key).alias("node_id"), F.col(other).alias("other"))
    return e.select(F.explode(F.array(row("source", "s", "t"), row("target", "t", "s"))).alias("x"), "weight", "seq").select("x.*", "weight", "seq")


def p6_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = skew.key_profile(_ends(spark, sf_dir), ["side", "node_id"], "other", "weight", tie=["seq"])
    return p.select("side", "node_id", "n_rows", F.round("weight_sum", 6).alias("weight_sum"), "n_others", "first_other", "last_other")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = skew.key_profile(_ends(spark, sf_dir), ["side", "node_id"], "other", "weight", tie=["seq"])
    return skew.heavy_keys(p, ["side"], 0.02).select("side", "node_id")


QUERIES = {"p4_hierarchy": p4_hierarchy, "p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants, "p4_all_descendants": p4_all_descendants, "p6_profile": p6_profile, "p6_found": p6_found}

_LINKS = """links AS (SELECT lower(trim(span_id)) AS id, min(nullif(lower(trim(parent_id)), '')) AS parent
  FROM spans WHERE nullif(lower(trim(span_id)), '') IS NOT NULL GROUP BY 1)"""
_TREE = f"""{_LINKS},
tree AS (SELECT l.id, l.id AS root, 0 AS depth, l.id AS path FROM links l WHERE NOT EXISTS (SELECT 1 FROM links p WHERE p.id = l.parent)
  UNION ALL SELECT c.id, t.root, t.depth + 1, t.path || '/' || c.id FROM tree t JOIN links c ON c.parent = t.id)"""
# A loop is walked from each of its members until it comes back to the start.
_LOOPS = """rest AS (SELECT id, parent FROM links WHERE id NOT IN (SELECT id FROM tree)),
walk AS (SELECT id AS start, parent AS here, least(id, parent) AS low, 1 AS n FROM rest
  UNION ALL SELECT w.start, r.parent, least(w.low, r.parent), w.n + 1 FROM walk w JOIN rest r ON r.id = w.here WHERE w.here <> w.start AND w.n <= (SELECT count(*) FROM rest)),
ring AS (SELECT start AS id, min(low) AS loop FROM walk WHERE here = start GROUP BY 1),
drift AS (SELECT id AS start, id AS here, 0 AS n FROM rest
  UNION ALL SELECT d.start, r.parent, d.n + 1 FROM drift d JOIN rest r ON r.id = d.here WHERE d.here NOT IN (SELECT id FROM ring)),
looped AS (SELECT d.start AS id, any_value(g.loop) AS root FROM drift d JOIN ring g ON g.id = d.here GROUP BY 1)"""
_ENDS = """ends AS (SELECT 'source' AS side, lower(trim(source)) AS node_id, lower(trim(target)) AS other, weight FROM edges
  UNION ALL SELECT 'target', lower(trim(target)), lower(trim(source)), weight FROM edges)"""

SQL = {
    "p4_found": f"""WITH RECURSIVE {_TREE}, {_LOOPS}
SELECT id AS span_id, root AS root_id, depth FROM tree WHERE id IN (SELECT id FROM links WHERE parent IS NOT NULL)
UNION ALL SELECT id, root, -1 FROM looped""",
    "p4_hierarchy": f"""WITH RECURSIVE {_TREE}, {_LOOPS},
up AS (SELECT id, id AS anc FROM tree UNION ALL SELECT u.id, l.parent FROM up u JOIN links l ON l.id = u.anc WHERE l.parent IN (SELECT id FROM links)),
below AS (SELECT anc, count(*) - 1 AS n FROM up GROUP BY 1)
SELECT id AS node_id, root AS root_id, depth, false AS in_loop, n AS n_descendants FROM tree JOIN below ON anc = id
UNION ALL SELECT id, root, -1, true, NULL FROM looped""",
    "p4_paths": f"WITH RECURSIVE {_TREE} SELECT id AS node_id, path FROM tree",
    "p4_descendants": f"WITH RECURSIVE {_TREE} SELECT root AS node_id, id AS descendant_id FROM tree WHERE depth > 0",
    "p4_all_descendants": f"""WITH RECURSIVE {_TREE},
up AS (SELECT id, id AS anc FROM tree UNION ALL SELECT u.id, l.parent FROM up u JOIN links l ON l.id = u.anc WHERE l.parent IN (SELECT id FROM links))
SELECT anc AS node_id, id AS descendant_id FROM up WHERE anc <> id""",
    "p6_profile": f"""WITH {_ENDS} SELECT side, node_id, count(*) AS n_rows, round(sum(weight), 6) AS weight_sum, count(DISTINCT other) AS n_others,
min(other) AS first_other, max(other) AS last_other FROM ends GROUP BY 1, 2""",
    "p6_found": f"""WITH {_ENDS} SELECT side, node_id FROM ends GROUP BY 1, 2 HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)""",
}
