"""Filter trees compiled to Columns, so that Catalyst pushes them into the scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.enums import _name
from memloom.functions.text import contains_ci


@dataclass(frozen=True)
class Filter:
    """op: eq ne gt ge lt le contains in range and or not. Missing values never match, also under ``not``:
    a test on a null is false and its negation true."""

    op: str
    field: str | None = None
    value: Any = None
    parts: tuple["Filter", ...] = ()

    def __and__(self, other: "Filter") -> "Filter":
        return Filter("and", parts=(self, other))

    def __or__(self, other: "Filter") -> "Filter":
        return Filter("or", parts=(self, other))

    def __invert__(self) -> "Filter":
        return Filter("not", parts=(self,))


def equals(f: str, v: Any) -> Filter:
    return Filter("eq", f, v)


def contains(f: str, v: str) -> Filter:
    return Filter("contains", f, v)


def greater(f: str, v: Any) -> Filter:
    return Filter("gt", f, v)


def less(f: str, v: Any) -> Filter:
    return Filter("lt", f, v)


def one_of(f: str, vs: list) -> Filter:
    return Filter("in", f, tuple(vs))


def between(f: str, low: Any, high: Any) -> Filter:
    return Filter("range", f, (low, high))


def column_of(name: str, columns: list[str]) -> Column:
    """A stored column, or else an attribute of the JSON in ``attributes`` (null where that is broken)."""
    if name in columns:
        return _name(F.col(name)) if name in ("node_type", "relation") else F.col(name)
    return F.get_json_object("attributes", f"$.{name}")


def compile_filter(f: Filter, columns: list[str]) -> Column:
    """A test for ``where``: null counts as false at every test, also under ``not``. Tests stay bare outside of it, so
    that comparisons with stored columns reach the scan."""
    if f.op == "and":
        return reduce(lambda a, b: a & b, (compile_filter(p, columns) for p in f.parts), F.lit(True))
    if f.op == "or":
        return reduce(lambda a, b: a | b, (compile_filter(p, columns) for p in f.parts), F.lit(False))
    if f.op == "not":
        return ~F.coalesce(compile_filter(f.parts[0], columns), F.lit(False))
    c, v = column_of(f.field, columns), f.value
    if f.field not in columns and isinstance(v, (int, float)) and not isinstance(v, bool):
        c = c.try_cast("double")
    return {
        "eq": lambda: c == v, "ne": lambda: c != v, "gt": lambda: c > v, "ge": lambda: c >= v, "lt": lambda: c < v, "le": lambda: c <= v,
        "contains": lambda: contains_ci(c.cast("string"), str(v)), "in": lambda: c.isin(*v) if v else F.lit(False), "range": lambda: c.between(*v),
    }[f.op]()


def apply_filter(df: DataFrame, f: Filter) -> DataFrame:
    return df.where(compile_filter(f, df.columns))


@dataclass(frozen=True)
class NodeFilter:
    """Bounds are inclusive; node types are alternatives; ``custom`` is a filter tree."""

    node_types: tuple[str, ...] = ()
    min_confidence: float | None = None
    max_confidence: float | None = None
    min_access_score: float | None = None
    created_after: str | None = None
    custom: Filter | None = None

    def condition(self, columns: list[str]) -> Column:
        tests = [F.lit(True)]
        if self.node_types:
            tests.append(_name(F.col("node_type")).isin(*self.node_types))
        if self.min_confidence is not None:
            tests.append(F.col("confidence") >= self.min_confidence)
        if self.max_confidence is not None:
            tests.append(F.col("confidence") <= self.max_confidence)
        if self.min_access_score is not None:
            tests.append(F.col("access_score") >= self.min_access_score)
        if self.created_after is not None:
            tests.append(F.col("created_at") >= F.lit(self.created_after).cast("timestamp"))
        if self.custom is not None:
            tests.append(compile_filter(self.custom, columns))
        return reduce(lambda a, b: a & b, tests)

    def apply(self, nodes: DataFrame) -> DataFrame:
        return nodes.where(self.condition(nodes.columns))


@dataclass(frozen=True)
class SpanFilter:
    """Tests on spans; an open span ends at ``as_of``; durations are tested only if both bounds are given."""

    span_id: str | None = None
    name_contains: str | None = None
    kind: str | None = None
    start_after: str | None = None
    end_before: str | None = None
    min_duration: float | None = None
    max_duration: float | None = None
    as_of: str = "2024-09-01 00:00:00"
    limit: int | None = None
    offset: int = 0
    extra: tuple[Column, ...] = field(default=())

    def apply(self, spans: DataFrame) -> DataFrame:
        out = spans
        if self.span_id is not None:
            out = out.where(F.col("span_id") == self.span_id)
        if self.name_contains is not None:
            out = out.where(F.contains("name", F.lit(self.name_contains)))
        if self.kind is not None:
            out = out.where(_name(F.col("kind")) == self.kind)
        if self.start_after is not None:
            out = out.where(F.col("start_time") >= F.lit(self.start_after).cast("timestamp"))
        if self.end_before is not None:
            out = out.where(F.coalesce("end_time", F.lit(self.as_of).cast("timestamp")) <= F.lit(self.end_before).cast("timestamp"))
        if self.min_duration is not None and self.max_duration is not None:
            out = out.where(F.col("duration_ms").between(self.min_duration, self.max_duration))
        for test in self.extra:
            out = out.where(test)
        if self.limit is not None or self.offset:
            out = out.orderBy("start_time", "span_id").offset(self.offset)
        return out if self.limit is None else out.limit(self.limit)
