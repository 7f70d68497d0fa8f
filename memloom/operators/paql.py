"""The query language: a recursive parser, an AST, and its compilation to DataFrame plans.

Grammar, keywords in any case and at word boundaries only::

    query     = node [modifiers]
    modifiers = "limit|top|first" N | "sort by|order by" field [asc|desc] {"," field [asc|desc]}
    node      = or;  or = and {"or" and};  and = not {"and" not};  not = "not" not | primary
    primary   = "(" node ")" | traversal | [text] "where|with" condition {"and|or" condition} | text
    traversal = ["traverse" | "starting"] "from" id ["forward" | "backward"] ["within" N]
    condition = field (= | != | > | >= | < | <= | contains | in) value

A filter takes the ``and`` and ``or`` behind it as long as they go on with a condition.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.text import contains_ci
from memloom.operators.filters import Filter, compile_filter
from memloom.sources.tables import current_rows

MAX_DEPTH = 10
DEFAULT_HOPS = 2
# Words that only introduce a search, the longest first.
INTRODUCTIONS = ("search for ", "look for ", "show me ", "search ", "find ", "show ")
SORT_FIELDS = {"relevance": "access_score", "score": "access_score", "access": "access_score", "access_score": "access_score", "confidence": "confidence", "created": "created_at", "created_at": "created_at", "date": "created_at"}
OPERATORS = {"=": "eq", "==": "eq", "!=": "ne", ">": "gt", ">=": "ge", "<": "lt", "<=": "le", "contains": "contains", "in": "in"}


class ParseError(ValueError):
    """The text is no query."""


class QueryTooComplex(ParseError):
    """Nested deeper than MAX_DEPTH."""


@dataclass(frozen=True)
class Empty:
    pass


@dataclass(frozen=True)
class TextSearch:
    text: str


@dataclass(frozen=True)
class SemanticSearch:
    text: str
    k: int = 10
    min_score: float = 0.0


@dataclass(frozen=True)
class HybridSearch:
    text: str
    k: int = 10
    hops: int = 1


@dataclass(frozen=True)
class Traversal:
    start: str
    direction: str = "both"
    hops: int = DEFAULT_HOPS


@dataclass(frozen=True)
class Filtered:
    base: object
    test: Filter


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    part: object


@dataclass
class Query:
    root: object = field(default_factory=Empty)
    limit: int | None = None
    sort: list[tuple[str, bool]] = field(default_factory=list)  # (field, ascending)

    def with_limit(self, n: int) -> "Query":
        return Query(self.root, n, self.sort)

    def with_sort(self, name: str, ascending: bool = False) -> "Query":
        return Query(self.root, self.limit, [*self.sort, (name, ascending)])


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[()]|,|!=|>=|<=|==|=|>|<|[^\s()",=<>!]+|!')
_LIMIT = re.compile(r"\b(?:limit|top|first)\s+(\d+)\b", re.I)
_SORT = re.compile(r"\b(?:sort|order)\s+by\s+((?:[\w.]+(?:\s+(?:asc|desc)\b)?)(?:\s*,\s*[\w.]+(?:\s+(?:asc|desc)\b)?)*)", re.I)
_TRAVERSAL = re.compile(r"(?:traverse\s+from|starting\s+from|from)\s+(\S+)((?:\s+(?:forward|backward|both|within\s+\d+(?:\s+hops?)?))*)\s*$", re.I)
_UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)


def parse(text: str) -> Query:
    text = (text or "").strip()
    if not text:
        return Query()
    query = Query()
    if m := _SORT.search(text):
        for item in m.group(1).split(","):
            words = item.split()
            query.sort.append((SORT_FIELDS.get(words[0].lower(), words[0]), len(words) > 1 and words[1].lower() == "asc"))
        text = text[: m.start()] + " " + text[m.end() :]
    if m := _LIMIT.search(text):
        query.limit = int(m.group(1))
        text = text[: m.start()] + " " + text[m.end() :]
    text = text.strip()
    query.root = _Parser(text).whole() if text else Empty()
    return query


def _clean(text: str) -> str:
    text = text.strip()
    for lead in INTRODUCTIONS:
        if text.lower().startswith(lead):
            text = text[len(lead) :].strip()
            break
    if len(text) >= 2 and text[0] == text[-1] == '"':
        text = text[1:-1]
    return text


class _Parser:
    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        self.at = 0
        self.depth = 0

    def word(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i][0].lower() if i < len(self.tokens) else ""

    def whole(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise ParseError(f"unexpected {self.tokens[self.at][0]!r}")
        return node

    def _nested(self, f):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise QueryTooComplex(f"nested deeper than {MAX_DEPTH}")
        try:
            return f()
        finally:
            self.depth -= 1

    def either(self):
        node = self.both()
        while self.word() == "or":
            self.at += 1
            node = Or(node, self.both())
        return node

    def both(self):
        node = self.inverted()
        while self.word() == "and":
            self.at += 1
            node = And(node, self.inverted())
        return node

    def inverted(self):
        if self.word() == "not":
            self.at += 1
            return Not(self._nested(self.inverted))
        return self.primary()

    def primary(self):
        if self.word() == "(":
            self.at += 1
            node = self._nested(self.either)
            if self.word() != ")":
                raise ParseError("a closing bracket is missing")
            self.at += 1
            return self.filtered(node)
        begin = self.at
        while self.at < len(self.tokens) and self.word() not in ("and", "or", "where", "with", "(", ")"):
            self.at += 1
        if self.word() == "with" and not self._condition_ahead(1):
            while self.at < len(self.tokens) and self.word() not in ("and", "or", "where", "(", ")"):
                self.at += 1
        raw = self.text[self.tokens[begin][1] : self.tokens[self.at - 1][2]] if self.at > begin else ""
        if m := _TRAVERSAL.fullmatch(raw.strip()):
            if _UUID.fullmatch(m.group(1)):
                tail = m.group(2).lower()
                hops = re.search(r"within\s+(\d+)", tail)
                direction = "forward" if "forward" in tail else "backward" if "backward" in tail else "both"
                return self.filtered(Traversal(m.group(1).lower(), direction, int(hops.group(1)) if hops else DEFAULT_HOPS))
        if not raw and self.word() not in ("where", "with"):
            raise ParseError("a search term is missing")
        return self.filtered(TextSearch(_clean(raw)))

    def filtered(self, base):
        if self.word() not in ("where", "with"):
            return base
        self.at += 1
        return Filtered(base, self.conditions())

    def _condition_ahead(self, ahead: int) -> bool:
        return self.word(ahead + 1) in OPERATORS

    def conditions(self) -> Filter:
        test = self.all_of()
        while self.word() == "or" and self._condition_ahead(1):
            self.at += 1
            test = test | self.all_of()
        return test

    def all_of(self) -> Filter:
        test = self.condition()
        while self.word() == "and" and self._condition_ahead(1):
            self.at += 1
            test = test & self.condition()
        return test

    def condition(self) -> Filter:
        if not self._condition_ahead(0):
            raise ParseError(f"no condition at {self.word() or 'the end'!r}")
        name, op = self.word(), OPERATORS[self.word(1)]
        self.at += 2
        if op == "in":
            if self.word() != "(":
                raise ParseError("in needs a list in brackets")
            self.at += 1
            values = []
            while self.word() and self.word() != ")":
                if self.word() != ",":
                    values.append(self.value())
                else:
                    self.at += 1
            if self.word() != ")":
                raise ParseError("a closing bracket is missing")
            self.at += 1
            return Filter("in", name, tuple(values))
        return Filter(op, name, self.value())

    def value(self):
        if self.at >= len(self.tokens):
            raise ParseError("a value is missing")
        raw = self.tokens[self.at][0]
        self.at += 1
        if raw.startswith('"'):
            return raw[1:-1].replace('\\"', '"')
        if raw.lower() in ("true", "false"):
            return raw.lower() == "true"
        for kind in (int, float):
            try:
                return kind(raw)
            except ValueError:
                pass
        return raw


def predicate(node, columns: list[str]) -> Column | None:
    """The node as one test on a row of nodes, or None where it needs more than the row."""
    if isinstance(node, Empty):
        return F.lit(True)
    if isinstance(node, TextSearch):
        return contains_ci(F.col("content"), node.text)
    if isinstance(node, Filtered):
        base = predicate(node.base, columns)
        return None if base is None else base & compile_filter(node.test, columns)
    if isinstance(node, Not):
        part = predicate(node.part, columns)
        return None if part is None else ~F.coalesce(part, F.lit(False))
    if isinstance(node, (And, Or)):
        left, right = predicate(node.left, columns), predicate(node.right, columns)
        if left is None or right is None:
            return None
        return left & right if isinstance(node, And) else left | right
    return None


def compile_node(node, nodes: DataFrame, edges: DataFrame | None = None, embed=None) -> DataFrame:
    """Rows of ``nodes`` that the query node selects. Pure row tests become one scan; the rest are
    semi, anti and distinct joins by id."""
    test = predicate(node, nodes.columns)
    if test is not None:
        return nodes.where(test)
    if isinstance(node, Traversal):
        from memloom.operators.graph import bfs

        reached = bfs(edges, nodes.select("id"), [node.start], node.direction, node.hops, max_nodes=None)
        return nodes.join(reached.select("id"), "id", "left_semi")
    if isinstance(node, (SemanticSearch, HybridSearch)):
        from memloom.operators import rag, vector_search

        if embed is None:
            return nodes.where(F.coalesce(contains_ci(F.col("content"), node.text), F.lit(False)))
        if isinstance(node, SemanticSearch):
            hits = vector_search.knn(nodes, embed(node.text), node.k).where(F.col("score") >= node.min_score)
        else:
            hits = rag.hybrid_retrieve(nodes, edges, embed(node.text), rag.RetrievalConfig(top_k=node.k, max_hops=node.hops, min_relevance=0.0))
        return nodes.join(hits.select("id"), "id", "left_semi")
    if isinstance(node, Filtered):
        return compile_node(node.base, nodes, edges, embed).where(compile_filter(node.test, nodes.columns))
    if isinstance(node, Not):
        return nodes.join(compile_node(node.part, nodes, edges, embed).select("id"), "id", "left_anti")
    left, right = compile_node(node.left, nodes, edges, embed), compile_node(node.right, nodes, edges, embed)
    if isinstance(node, And):
        return left.join(right.select("id"), "id", "left_semi")
    return left.unionByName(right).dropDuplicates(["id"])


def run(query: Query | str, nodes: DataFrame, edges: DataFrame | None = None, limit: int | None = None, embed=None, versions: bool = False) -> DataFrame:
    """The rows of a query, ordered by its sort fields, else by access score; ties by id. The smaller of
    the two limits holds. With ``versions``, ``nodes`` is the stored table with all versions of a node: tests on a
    row then go into the scan before the current versions are found."""
    q = parse(query) if isinstance(query, str) else query
    test = predicate(q.root, nodes.columns) if versions and not isinstance(q.root, Empty) else None
    nodes = current_rows(nodes, test) if versions else nodes
    if isinstance(q.root, Empty):
        rows = nodes.where(F.lit(False))
    else:
        rows = nodes if test is not None else compile_node(q.root, nodes, edges, embed)
    keys = []
    for name, ascending in q.sort or [("access_score", False)]:
        c = F.col(name) if name in nodes.columns else F.get_json_object("attributes", f"$.{name}")
        keys.append(c.asc_nulls_last() if ascending else c.desc_nulls_last())
    rows = rows.orderBy(*keys, "id")
    limits = [x for x in (q.limit, limit) if x is not None]
    return rows.limit(min(limits)) if limits else rows


def result_summary(query: Query | str, nodes: DataFrame, edges: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """One row: how many rows match, how many are returned, and whether some were left out."""
    q = parse(query) if isinstance(query, str) else query
    total = run(Query(q.root), nodes, edges).agg(F.count("*").alias("total_count"))
    limits = [x for x in (q.limit, limit) if x is not None]
    shown = F.least(F.col("total_count"), F.lit(min(limits))) if limits else F.col("total_count")
    return total.select("total_count", shown.cast("long").alias("returned"), (shown < F.col("total_count")).alias("truncated"))
