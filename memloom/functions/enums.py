"""Algebra of relations, node types, sources and directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
NODE_TYPES = ("entity", "concept", "fact", "raw_chunk")
STRUCTURED_TYPES = ("entity", "concept", "fact")
RELATIONS = ("is_part_of", "belongs_to", "causes", "happened_after", "located_at", "is_a", "similar_to", "contradicts")
REVERSE = {
    "is_part_of": "belongs_to", "belongs_to": "is_part_of", "causes": "caused_by", "happened_after": "happened_before",
    "located_at": "contains", "is_a": "has_instance", "similar_to": "similar_to", "contradicts": "similar_to",
}
TRANSITIVE = ("is_part_of", "is_a", "causes", "located_at")
SYMMETRIC = ("similar_to", "contradicts")
SOURCES = ("user_input", "auto_extracted", "web_crawl", "file_upload", "api_import")
AUTOMATED_SOURCES = ("auto_extracted", "web_crawl", "api_import")
DIRECTIONS = ("forward", "backward", "both")
PATH_TYPES = ("causal", "hierarchical", "temporal", "associative", "hybrid")
SPAN_KINDS = ("function", "async_task", "database_query", "external_call", "internal")


def _name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")


def reverse_relation(c: Column) -> Column:
    """The relation read from the other end; a custom one gets the prefix ``reverse_``."""
    n = _name(c)
    out = F.concat(F.lit("reverse_"), n)
    for k, v in REVERSE.items():
        out = F.when(n == k, F.lit(v)).otherwise(out)
    return out


def is_transitive(c: Column) -> Column:
    return _name(c).isin(*TRANSITIVE)


def is_symmetric(c: Column) -> Column:
    return _name(c).isin(*SYMMETRIC)


def is_directional(c: Column) -> Column:
    return ~is_symmetric(c)


def is_custom_relation(c: Column) -> Column:
    return ~_name(c).isin(*RELATIONS)


def is_structured(c: Column) -> Column:
    return _name(c).isin(*STRUCTURED_TYPES)


def is_raw(c: Column) -> Column:
    return _name(c) == "raw_chunk"


def is_automated(c: Column) -> Column:
    """Sources are compared as they are written."""
    return c.isin(*AUTOMATED_SOURCES)


def source_kind(c: Column) -> Column:
    """The source, or ``custom`` for any that isn't built in."""
    return F.when(c.isin(*SOURCES), c).otherwise(F.lit("custom"))


def parse_node_type(c: Column) -> Column:
    """The node type in normal form; null where it is none."""
    n = _name(c)
    return F.when(n.isin(*NODE_TYPES), n)


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Every edge seen from its target; what is stored about its life isn't taken along."""
    keep = [c for c in edges.columns if c not in ("source", "target", "relation", "expired", "replaced_by", "created_at")]
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"), reverse_relation(F.col("relation")).alias("relation"), *keep)


def edge_id(source: Column, target: Column, relation: Column) -> Column:
    return F.concat_ws("::", source, target, relation)


def includes(direction: str, outgoing: bool) -> bool:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction {direction!r}")
    return direction == "both" or (direction == "forward") == outgoing
