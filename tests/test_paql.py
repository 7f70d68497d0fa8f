import pytest

from memloom.operators import paql
from memloom.operators.filters import Filter
from memloom.operators.paql import And, Empty, Filtered, Not, Or, Query, TextSearch, Traversal, parse

ID = "123e4567-e89b-12d3-a456-426614174000"


@pytest.mark.parametrize(
    "text,root,limit,sort",
    [
        ("", Empty(), None, []),
        ("machine learning", TextSearch("machine learning"), None, []),
        ("find AI concepts limit 10", TextSearch("AI concepts"), 10, []),
        ("find AI sort by confidence asc limit 5", TextSearch("AI"), 5, [("confidence", True)]),
        ("find AI limit 5 order by created, score asc", TextSearch("AI"), 5, [("created_at", False), ("access_score", True)]),
        ("a and b or c", Or(And(TextSearch("a"), TextSearch("b")), TextSearch("c")), None, []),
        ("a and (b or c)", And(TextSearch("a"), Or(TextSearch("b"), TextSearch("c"))), None, []),
        ("not x", Not(TextSearch("x")), None, []),
        ("show me laptop 5", TextSearch("laptop 5"), None, []),
        ('SEARCH FOR "limits and more"', TextSearch("limits and more"), None, []),
        ("top 3 things", TextSearch("things"), 3, []),
        (f"from {ID} forward within 3", Traversal(ID, "forward", 3), None, []),
        (f"traverse from {ID}", Traversal(ID, "both", 2), None, []),
        ("from nowhere", TextSearch("from nowhere"), None, []),
        ("x where confidence > 0.5", Filtered(TextSearch("x"), Filter("gt", "confidence", 0.5)), None, []),
        ('x with node_type in (fact, "raw_chunk")', Filtered(TextSearch("x"), Filter("in", "node_type", ("fact", "raw_chunk"))), None, []),
        ("tea with milk", TextSearch("tea with milk"), None, []),
    ],
)
def test_parse(text, root, limit, sort):
    q = parse(text)
    assert (q.root, q.limit, q.sort) == (root, limit, sort)


def test_builder():
    q = Query(TextSearch("x")).with_limit(3).with_sort("confidence", True)
    assert (q.limit, q.sort) == (3, [("confidence", True)])


@pytest.mark.parametrize("text", ["(a", "a and", "x where confidence >", "x where", "or b"])
def test_errors(text):
    with pytest.raises(paql.ParseError):
        parse(text)


def test_too_deep():
    with pytest.raises(paql.QueryTooComplex):
        parse("(" * 11 + "a" + ")" * 11)


def test_run(spark):
    nodes = spark.createDataFrame([("1", "AI notes", "fact", 0.9, 2.0, '{"lang": "de", "n": 3}'), ("2", "More ai", "entity", 0.2, 1.0, "broken"), ("3", "Tea", "fact", None, 5.0, None), ("4", None, "fact", 0.5, None, "{}")], "id string, content string, node_type string, confidence double, access_score double, attributes string")
    ids = lambda q, **k: [r.id for r in paql.run(q, nodes, **k).collect()]
    assert ids("ai") == ["1", "2"]
    assert ids("not ai") == ["3", "4"]
    assert ids("ai or tea sort by confidence asc") == ["2", "1", "3"]
    assert ids("ai where lang = de") == ["1"]
    assert ids("where n >= 3") == ["1"]
    assert ids("tea or ai limit 2", limit=1) == ["3"]
    assert ids("") == []
    assert tuple(paql.result_summary("ai limit 1", nodes).collect()[0]) == (2, 1, True)
