import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memloom.llm import neardup as N


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**16 - 1), max_size=40), st.integers(0, 2**16 - 1), st.integers(0, 16))
def test_tree_finds_all_within_the_radius(values, q, r):
    tree = N.BKTree()
    for i, v in enumerate(values):
        tree.add(v, i)
    assert sorted(t for _, t in tree.within(q, r)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= r]


def corpus(seed, hot=0):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for k in range(40):
        base = r.sample(vocabulary, r.randrange(20, 60))
        for j in range(r.randrange(1, 5)):
            words = list(base)
            for _ in range(r.randrange(0, 9)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            r.shuffle(words)
            texts[f"n{k:02}-{j}"] = ". ".join(words)
    texts["copy1"] = texts["copy2"] = texts["copy3"] = " ".join(vocabulary[:30])
    for j in range(hot):
        words = vocabulary[:40]
        words[j % 40] = f"x{j}"
        texts[f"hot{j:03}"] = " ".join(words)
    return texts


def brute(texts, t=0.8, least=20):
    sets = {i: N.words_of(x) for i, x in texts.items()}
    ids = sorted(i for i, s in sets.items() if len(s) >= least)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


def pairs(spark, texts, **kw):
    df = spark.createDataFrame(list(texts.items()), "id string, content string")
    rows = N.near_duplicate_pairs(df, "id", "content", **kw).collect()
    got = {(r.node_a, r.node_b) for r in rows}
    assert len(got) == len(rows)
    return got


def test_all_links(spark):
    texts = corpus(1)
    assert pairs(spark, texts) == brute(texts)


def test_other_threshold(spark):
    texts = corpus(2)
    assert pairs(spark, texts, threshold=0.6) == brute(texts, 0.6)


def test_hot_words_in_blocks(spark):
    texts = corpus(3, hot=90)
    df = spark.createDataFrame(list(texts.items()), "id string, content string")
    members, links = N.near_duplicate_classes(df, "id", "content", block=16)
    first = {r.cid: r.id for r in members.orderBy("id", ascending=False).collect()}
    got = {tuple(sorted((first[r.a], first[r.b]))) for r in links.collect()}
    assert got | {("copy1", "copy2"), ("copy1", "copy3"), ("copy2", "copy3")} >= {p for p in brute(texts) if not p[0].startswith("copy") and not p[1].startswith("copy")}


def test_large_class_of_copies_as_membership(spark):
    texts = {f"c{i:02}": " ".join(f"w{j}" for j in range(25)) for i in range(12)}
    texts["near"] = " ".join(f"w{j}" for j in range(24)) + " other"
    assert pairs(spark, texts, expand=5) == {("c00", f"c{i:02}") for i in range(1, 12)} | {("c00", "near")}


def test_nulls_short_long_and_empty(spark):
    words = [f"w{i}" for i in range(30)]
    texts = {"null": None, "empty": "", "short": "a b c", "a": " ".join(words), "b": " ".join(reversed(words)), "long": " ".join(f"v{i}" for i in range(20_000)), "long2": " ".join(f"v{i}" for i in range(19_500))}
    assert pairs(spark, texts) == {("a", "b"), ("long", "long2")}
    assert pairs(spark, {"x": None}) == set()


def test_words():
    assert N.words_of("It's É_Straße 42!") == {"it", "s", "é", "straße", "42"}


def test_all_pairs_of_large_classes(spark):
    words = [f"w{i}" for i in range(25)]
    r = random.Random(6)
    texts = {"near": " ".join(words[:24]) + " other"}
    for i in range(70):
        r.shuffle(words)
        texts[f"c{i:02}"] = " ".join(words)
    texts.update({f"d{i:02}": " ".join(sorted(words)) for i in range(70)})
    assert pairs(spark, texts) == brute(texts)


def test_star_form_for_equal_texts_only(spark):
    words = [f"w{i}" for i in range(25)]
    texts = {f"c{i}": " ".join(words) for i in range(6)} | {f"d{i}": " ".join(words[i + 1 :] + words[: i + 1]) for i in range(6)} | {"near": " ".join(words[:24]) + " other"}
    shown = {k: texts[k] for k in texts if k == "c0" or k[0] != "c"}
    assert pairs(spark, texts, expand=3) == brute(shown) | {("c0", f"c{i}") for i in range(1, 6)}


@pytest.mark.parametrize("common", [0, 5, 50, 8192])
@pytest.mark.parametrize("block", [8, 2048])
def test_order_and_blocks_lose_nothing(spark, common, block):
    """The order of rare words is joined, hot words give way to pairs of words, and what is still hot to blocks."""
    texts = corpus(7, hot=30)
    sets = {i: N.words_of(x) for i, x in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "id string, content string")
    members, links = N.near_duplicate_classes(df, "id", "content", block=block, common_words=common)
    of = {}
    for r in members.collect():
        of.setdefault(r.cid, []).append(r.id)
    found = {tuple(sorted((x, y))) for r in links.collect() for x in of[r.a] for y in of[r.b]}
    found |= {(a, b) for ids in of.values() for a in ids for b in ids if a < b}
    assert found == brute(texts) and all(len({frozenset(sets[i]) for i in ids}) == 1 for ids in of.values())


@pytest.mark.parametrize("block", [8, 2048])
def test_groups(spark, block, monkeypatch):
    """Two searches, the first for the nearest candidates only, give the groups that all links give."""
    monkeypatch.setattr(N, "NEAREST", 1)
    texts = corpus(9, hot=40)
    links = brute(texts)
    ids = sorted({i for i, t in texts.items() if len(N.words_of(t)) >= 20})
    group = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    df = spark.createDataFrame(list(texts.items()) + [("null", None), ("short", "a b c")], "id string, content string")
    assert {r.id: r.group_id for r in N.near_duplicate_groups(df, "id", "content", block=block).collect()} == group
    assert N.near_duplicate_groups(df.limit(0), "id", "content").collect() == []
