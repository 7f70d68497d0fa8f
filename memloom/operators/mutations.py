"""Changes of nodes and edges as folds over change logs; validation, bulk loads, import and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.enums import NODE_TYPES, parse_node_type

MAX_CONTENT_BYTES = 10 * 1024 * 1024


def fold_changes(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` after an ordered batch: ``changes`` has its columns and ``op`` (put or delete) and ``seq``;
    of each key the last change holds."""
    columns = base.columns
    last = changes.groupBy(*keys).agg(F.max_by(F.struct("op", *[c for c in columns if c not in keys]), "seq").alias("c"))
    kept = base.join(last.select(*keys), keys, "left_anti")
    put = last.where(F.col("c.op") == "put").select(*[F.col(c) if c in keys else F.col("c")[c].alias(c) for c in columns])
    return kept.unionByName(put)


def upsert(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, one row with what went): edges go with either of their ends."""
    gone = ids.select("id").distinct()
    rest = nodes.join(gone, "id", "left_anti")
    kept = edges
    for side in ("source", "target"):
        kept = kept.join(gone.withColumnRenamed("id", side), side, "left_anti")
    counts = nodes.join(gone, "id", "left_semi").agg(F.count("*").alias("deleted"))
    return rest, kept.select(*edges.columns), counts


def validate_nodes(nodes: DataFrame) -> DataFrame:
    """Every node with ``problem``, null for a valid one."""
    return nodes.withColumn(
        "problem",
        F.when(F.col("content").isNull() | (F.regexp_replace("content", r"\s", "") == ""), "empty content")
        .when(F.octet_length("content") > MAX_CONTENT_BYTES, "content too long")
        .when(parse_node_type(F.col("node_type")).isNull(), "unknown node type")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence out of range")
        .when(~F.coalesce(F.col("access_score") >= 0, F.lit(False)), "access score out of range"),
    )


def validate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every edge with ``problem``; the source is looked for first."""
    ids = nodes.select("id").distinct()
    e = edges.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    return e.select(
        *edges.columns,
        F.when(F.col("_s").isNull(), "source not found").when(F.col("_t").isNull(), "target not found").when(F.col("source") == F.col("target"), "self loop").when(~F.coalesce(F.col("weight").between(0, 1), F.lit(False)), "weight out of range").alias("problem"),
    )


def clamp_edges(edges: DataFrame) -> DataFrame:
    """Weights brought into [0, 1]; a missing one is 1."""
    return edges.withColumn("weight", F.least(F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)), F.lit(1.0)))


def bulk_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a kind and problem of validated frames: what a bulk load takes and what it turns down."""
    count = lambda df, kind: df.groupBy(F.lit(kind).alias("kind"), F.coalesce("problem", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))
    return count(nodes, "node").unionByName(count(edges, "edge"))


def ingest_nodes(rows: DataFrame, as_of: str) -> DataFrame:
    """New nodes with defaults: an unknown type is a concept, scores are 1, times are ``as_of``; an id is
    made from content and type where there is none."""
    now = F.lit(as_of).cast("timestamp")
    have = set(rows.columns)
    default = lambda c, v: F.coalesce(c, v) if c in have else v
    kind = F.coalesce(parse_node_type(F.col("node_type")), F.lit("concept")) if "node_type" in have else F.lit("concept")
    made = F.md5(F.concat_ws("|", kind, F.coalesce("content", F.lit(""))))
    uuid = F.concat_ws("-", F.substring(made, 1, 8), F.substring(made, 9, 4), F.substring(made, 13, 4), F.substring(made, 17, 4), F.substring(made, 21, 12))
    return rows.select(
        default("id", uuid).alias("id"), "content", kind.alias("node_type"),
        *([F.col("embedding")] if "embedding" in have else []),
        default("created_at", now).alias("created_at"), default("updated_at", now).alias("updated_at"),
        (F.col("accessed_at") if "accessed_at" in have else F.lit(None).cast("timestamp")).alias("accessed_at"),
        F.greatest(default("access_score", F.lit(1.0)), F.lit(0.0)).alias("access_score"),
        F.least(F.greatest(default("confidence", F.lit(1.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        default("source", F.lit("user_input")).alias("source"),
    )


def import_json(spark: SparkSession, path: str, as_of: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, rejected) of a file with objects; those without content are rejected."""
    raw = spark.read.schema("content string, node_type string, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path, multiLine=multi_line)
    good = F.col("content").isNotNull()
    return ingest_nodes(raw.where(good).select("content", "node_type"), as_of), raw.where(~good)


def export_json(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("errorifexists").json(path)


def _attributes() -> Column:
    """Attributes as they are where they are a JSON object, else an empty one."""
    kept = F.when(F.get_json_object("attributes", "$").startswith("{"), F.col("attributes"))
    return F.coalesce(kept, F.lit("{}"))


def _with_attributes(body: Column) -> Column:
    """A JSON object with the attributes put in as they were written."""
    return F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"attributes":'), _attributes(), F.lit("}"))


NODE_META = "created_at timestamp, updated_at timestamp, accessed_at timestamp, access_score double, confidence double, source string, document_id string, chunk_index int"
EDGE_FIELDS = "source string, target string, relation string, weight double, created_at timestamp, expired boolean, replaced_by string"


def node_json(nodes: DataFrame) -> DataFrame:
    """(id, json): nested as the interfaces show a node; attributes are passed through."""
    meta = F.struct("created_at", "updated_at", "accessed_at", "access_score", "confidence", "source", "document_id", "chunk_index")
    return nodes.select("id", _with_attributes(F.to_json(F.struct("id", "content", "node_type", meta.alias("meta")))).alias("json"))


def edge_json(edges: DataFrame) -> DataFrame:
    """(source, target, relation, json)."""
    names = [x.split()[0] for x in EDGE_FIELDS.split(", ")]
    return edges.select("source", "target", "relation", _with_attributes(F.to_json(F.struct(*names))).alias("json"))


def read_node_json(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """Nodes from their JSON; rows that are none come out with null fields."""
    x = F.from_json(json_col, f"id string, content string, node_type string, meta struct<{NODE_META.replace(' ', ':').replace(',:', ',')}>")
    return rows.select(x.alias("x"), F.get_json_object(json_col, "$.attributes").alias("attributes")).select("x.id", "x.content", "x.node_type", "x.meta.*", "attributes")


def read_edge_json(rows: DataFrame, json_col: str = "json") -> DataFrame:
    return rows.select(F.from_json(json_col, EDGE_FIELDS).alias("x"), F.get_json_object(json_col, "$.attributes").alias("attributes")).select("x.*", "attributes")


def put_metadata(table: DataFrame, key: str, value: str) -> DataFrame:
    """The (key, value) table with one value set."""
    return upsert(table, table.sparkSession.createDataFrame([(key, value)], "key string, value string"), ["key"])


def get_metadata(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.col("key") == key).select("value")


def save_edges(edges: DataFrame, path: str) -> None:
    """Writes edges sorted by source within files, so reads of one source skip most of them."""
    edges.repartitionByRange("source").sortWithinPartitions("source", "target", "relation").write.mode("overwrite").parquet(path)


def page(nodes: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return nodes.orderBy("id").offset(offset).limit(limit)


def page_with_total(nodes: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """The rows of a page, each with the ``total`` of all pages; a limit of 0 gives no rows."""
    return page(nodes, limit, offset).crossJoin(nodes.agg(F.count("*").alias("total")))  # one row


def database_stats(nodes: DataFrame, edges: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """One row of counts; with ``memory``, the row of ``memory_stats``, also its columns."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.size("embedding") > 0).alias("embedded"), F.count_if(parse_node_type(F.col("node_type")).isin(*NODE_TYPES)).alias("typed"))
    out = n.crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each
    return out if memory is None else out.crossJoin(memory)


def type_source_cube(nodes: DataFrame) -> DataFrame:
    return nodes.cube("node_type", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
