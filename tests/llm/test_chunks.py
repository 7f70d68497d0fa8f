import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memloom.llm import chunks as C

ALPHABET = st.sampled_from(list("ab .!?\n,;。é") + ["  ", "\n\n", "word "])


@settings(max_examples=200, deadline=None)
@given(st.lists(ALPHABET, max_size=200).map("".join), st.integers(1, 40), st.integers(0, 39), st.integers(0, 10), st.booleans(), st.booleans())
def test_bodies_cover_the_text_within_the_limit(text, limit, overlap, minimum, sentences, paragraphs):
    overlap = min(overlap, limit - 1)
    starts = C.bisect_text(C.Boundaries(text), limit, overlap, minimum, sentences, paragraphs)
    if not text:
        assert starts == [0]
        return
    ends = [*starts[1:], len(text)]
    assert starts[0] == 0 and all(0 < e - s <= limit - overlap for s, e in zip(starts, ends))
    assert "".join(text[s:e] for s, e in zip(starts, ends)) == text


def test_sentences_that_fit_are_not_cut():
    text = " ".join(f"Sentence number {i} has a few words." for i in range(40))
    starts = C.bisect_text(C.Boundaries(text), 120, 20, 10, True, False)
    assert all(text[s:].startswith("Sentence") for s in starts)


def test_words_are_kept_where_sentences_are_not_asked_for():
    text = "alpha beta gamma delta " * 30
    starts = C.bisect_text(C.Boundaries(text), 60, 10, 5, False, False)
    assert all(s == 0 or text[s - 1] == " " for s in starts)


def test_longest_sentence():
    assert C.sentence_cuts("One two. Three!  Four five six? v1.5 end")[1] == len("Four five six?")
    assert C.sentence_cuts("一二三。四五")[1] == 4


CONFIG = "config_id int, max_chunk_size int, min_chunk_size int, overlap int, respect_sentences boolean, respect_paragraphs boolean, semantic_threshold double"


@pytest.mark.parametrize("most", [10_000, 2])
def test_operator(spark, most, monkeypatch):
    monkeypatch.setattr(C, "MAX_CONFIGS", most)  # fewer than there are: lists of settings, one after another
    monkeypatch.setattr(C, "BATCH", 500)
    configs = spark.createDataFrame([(1, 50, 5, 10, True, True, 0.3), (2, 20, 1, 19, False, False, 0.5), (3, 0, 0, 0, True, True, 0.3), (4, 10, 20, 1, True, True, 0.3), (5, 10, 1, 10, True, True, 0.3), (6, 10, 1, 1, True, True, 1.5), (7, None, 1, 1, True, True, 0.5)], CONFIG)
    texts = {"a": "Short one. " * 12, "b": "x" * 75, "c": "tiny", "n": None, "e": "", "long": "Ein Satz mit Wörtern. " * 3000}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "id string, content string, starts int")
    cuts = C.chunk_texts(df, configs)
    found = {(r.config_id, r.id, r.forced) for r in cuts.collect()}
    assert found == {(1, "a", 0), (2, "a", 0), (1, "b", 1), (2, "b", 0), (1, "long", 0), (2, "long", 0)}
    limit = {1: 50, 2: 20}
    overlap = {1: 10, 2: 19}
    rows = {}
    for r in C.chunk_pieces(df, configs).collect():
        rows.setdefault((r.config_id, r.id), []).append(r)
    assert set(rows) == {(c, k) for c, k, _ in found}
    for (cid, key), pieces in rows.items():
        pieces.sort(key=lambda r: r.piece)
        text = texts[key]
        assert "".join(text[p.body : p.end] for p in pieces) == text
        assert all(len(p.text) <= limit[cid] and p.text == text[p.start : p.end] for p in pieces)
        assert all(p.start == max(0, p.body - overlap[cid]) for p in pieces)


def test_no_rows(spark):
    configs = spark.createDataFrame([], CONFIG)
    df = spark.createDataFrame([("a", "text " * 50)], "id string, content string")
    assert C.chunk_texts(df, configs).collect() == [] == C.chunk_pieces(df, configs).collect()
