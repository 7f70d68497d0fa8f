"""Splitting texts over a size limit at natural boundaries, by recursive bisection.

A span longer than the limit minus the overlap is cut at the strongest boundary near its middle, and
both halves are cut again until they fit. Then every piece but the first is begun ``overlap``
characters earlier. Positions are found once a text; pieces are offsets, or cut out where the text is held.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.runtime import slots

# What ends a sentence, a paragraph, a clause, a word.
SENTENCE_END = re.compile(r"[.!?](?=[ \t\r\n]|\Z)|[。！？]")
PARAGRAPH_END = re.compile(r"\r?\n[ \t]*\r?\n[ \t\r\n]*")
CLAUSE_END = re.compile(r"[,;:](?=\s)|[，；：、]|\r?\n")
BLANK = re.compile(r"[^\S\r\n]+")
EDGE = " \t\r\n"

CONFIG_FIELDS = ["config_id", "max_chunk_size", "min_chunk_size", "overlap", "respect_sentences", "respect_paragraphs", "semantic_threshold"]
MAX_CONFIGS = 10_000  # settings sent to every task at once
BATCH = 4_000_000  # code points in a batch of pieces


def valid_configs(configs: DataFrame) -> DataFrame:
    return configs.where("max_chunk_size > 0 and min_chunk_size <= max_chunk_size and overlap < max_chunk_size and overlap >= 0 and semantic_threshold between 0 and 1")


def _after_blanks(text: str, at: int) -> int:
    n = len(text)
    while at < n and text[at] in EDGE:
        at += 1
    return at


def sentence_cuts(text: str) -> tuple[list[int], int]:
    """(positions at which a sentence begins, code points of the longest sentence without blanks at its ends)."""
    cuts, longest, start = [], 0, 0
    for m in SENTENCE_END.finditer(text):
        end = m.end()
        longest = max(longest, len(text[start:end].strip(EDGE)))
        start = end
        cuts.append(_after_blanks(text, end))
    longest = max(longest, len(text[start:].strip(EDGE)))
    return [c for c in cuts if 0 < c < len(text)], longest


class Boundaries:
    """The cut positions of one text by strength, found when first needed."""

    def __init__(self, text: str):
        self.text = text
        self._sentences: tuple[list[int], int] | None = None
        self._others: dict[str, list[int]] = {}

    @property
    def sentences(self) -> list[int]:
        if self._sentences is None:
            self._sentences = sentence_cuts(self.text)
        return self._sentences[0]

    @property
    def longest(self) -> int:
        return self._sentences[1] if self.sentences is not None and self._sentences else 0

    def of(self, kind: str) -> list[int]:
        if kind == "sentence":
            return self.sentences
        if kind not in self._others:
            pattern = {"paragraph": PARAGRAPH_END, "clause": CLAUSE_END, "word": BLANK}[kind]
            found = (_after_blanks(self.text, m.end()) for m in pattern.finditer(self.text))
            self._others[kind] = sorted({c for c in found if 0 < c < len(self.text)})
        return self._others[kind]


def _nearest(cuts: list[int], lo: int, hi: int, middle: int, low: int, high: int) -> int:
    """The cut in (lo, hi) nearest the middle; one within [low, high] comes first. 0 if there is none."""
    i = bisect_left(cuts, middle)
    best = 0
    for j in (i - 1, i):
        if 0 <= j < len(cuts) and lo < cuts[j] < hi and (not best or abs(cuts[j] - middle) < abs(best - middle)):
            best = cuts[j]
    if best and not low <= best <= high:
        return -best
    return best


def bisect_text(b: Boundaries, limit: int, overlap: int, minimum: int, sentences: bool, paragraphs: bool) -> list[int]:
    """Starts of the bodies, ascending, the first being 0. Every body has at most limit - overlap code points."""
    size = max(1, limit - overlap)
    n = len(b.text)
    strong = [b.of(k) for k, on in (("paragraph", paragraphs), ("sentence", sentences)) if on]
    weak = [b.of("clause"), b.of("word")]
    starts, stack = [], [(0, n)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= size:
            starts.append(lo)
            continue
        middle, reach = (lo + hi) // 2, (hi - lo) // 4
        low, high = max(lo + minimum, middle - reach), min(hi - minimum, middle + reach)
        # Near the middle the strongest kind wins. A boundary that is to be respected wins over all
        # weaker ones wherever it is, so no sentence that fits is cut; then words; then the middle.
        cut = far = 0
        for cuts in strong:
            at = _nearest(cuts, lo, hi, middle, low, high)
            if at > 0:
                cut = at
                break
            far = far or -at
        cut = cut or far
        if not cut:
            found = [_nearest(cuts, lo, hi, middle, low, high) for cuts in weak]
            cut = next((at for at in found if at > 0), 0) or -found[1] or -found[0] or middle
        stack.append((cut, hi))
        stack.append((lo, cut))
    return starts


PIECES = "config_id int, forced int, starts array<int>, ends array<int>, bodies array<int>"


def _settings(configs: DataFrame) -> list[list[tuple]]:
    """The valid configs as (limit, id, overlap, minimum, sentences, paragraphs), smallest limit first, in lists of
    at most about MAX_CONFIGS: a list goes to every task."""
    rows = valid_configs(configs).select(*CONFIG_FIELDS).distinct()
    slices = -(-2 * rows.count() // MAX_CONFIGS)
    cut = F.pmod(F.xxhash64(*CONFIG_FIELDS), F.lit(max(1, slices)))
    return [sorted((r.max_chunk_size, r.config_id, r.overlap, max(0, r.min_chunk_size or 0), bool(r.respect_sentences), bool(r.respect_paragraphs)) for r in rows.where(cut == i).collect()) for i in range(slices)]


def _cut(text: str, settings: list[tuple]):
    """(config_id, forced, starts, ends, bodies) for the configs whose limit the text is over."""
    b, n = Boundaries(text), len(text)
    for limit, cid, overlap, minimum, sentences, paragraphs in settings:
        if n <= limit:
            break
        body = np.array(bisect_text(b, limit, overlap, minimum, sentences, paragraphs), dtype=np.int32)
        yield cid, int(sentences and b.longest > limit), np.maximum(body - overlap, 0), np.append(body[1:], np.int32(n)), body


def _over_limit(df: DataFrame, id_col: str, text_col: str, settings: list[tuple]) -> DataFrame:
    smallest = settings[0][0] if settings else 1 << 30
    return df.select(id_col, text_col).where(F.length(text_col) > smallest).repartition(slots(df.sparkSession, 4))


def _of_every_list(df: DataFrame, configs: DataFrame, run) -> DataFrame:
    out = None
    for settings in _settings(configs) or [[]]:
        part = run(settings)
        out = part if out is None else out.unionByName(part)
    return out


def chunk_texts(df: DataFrame, configs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """A row for every valid config and every text with more code points than its max_chunk_size:
    ``id_col, config_id, forced, starts, ends, bodies`` (0-based offsets of the pieces, and of the body
    of each, that is without its overlap).

    Concatenating text[bodies[i]:ends[i]] gives the text again, whole. ``forced`` is 1 if
    respect_sentences is set and one sentence alone is longer than max_chunk_size. Texts that are null,
    empty or within the limit come out of no config. Configs are a table of settings, read in lists of at
    most about MAX_CONFIGS and the texts once for each list. Repeated rows come out repeatedly.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(settings):
        def cut(batches):
            for batch in batches:
                ids, rows = [], []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for row in _cut(text, settings):
                        ids.append(key)
                        rows.append(row)
                config, forced, *offsets = zip(*rows) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(config, pa.int32()), pa.array(forced, pa.int32()), *(_list_array(x) for x in offsets)], names=[id_col, "config_id", "forced", "starts", "ends", "bodies"])

        return _over_limit(df, id_col, text_col, settings).mapInArrow(cut, f"`{id_col}` {kind}, {PIECES}")

    return _of_every_list(df, configs, run)


def chunk_pieces(df: DataFrame, configs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """One row a piece, with its text: ``id_col, config_id, piece, start, end, body, forced, text``, for the same
    texts and configs as ``chunk_texts``. Pieces are cut where the text is held, so a text travels once and is
    never walked through again for a piece."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "config_id", "piece", "start", "end", "body", "forced", "text"]

    def run(settings):
        def cut(batches):
            for batch in batches:
                ids, columns, held = [], [[] for _ in names[1:]], 0

                def flush():
                    types = [pa.int32()] * 6 + [pa.string()]
                    return pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for config, forced, starts, ends, bodies in _cut(text, settings):
                        for i, (start, end, body) in enumerate(zip(starts.tolist(), ends.tolist(), bodies.tolist())):
                            ids.append(key)
                            for c, v in zip(columns, (config, i, start, end, body, forced, text[start:end])):
                                c.append(v)
                            held += end - start
                            if held > BATCH:
                                yield flush()
                                ids, columns, held = [], [[] for _ in names[1:]], 0
                yield flush()

        return _over_limit(df, id_col, text_col, settings).mapInArrow(cut, f"`{id_col}` {kind}, config_id int, piece int, start int, end int, body int, forced int, text string")

    return _of_every_list(df, configs, run)


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    if parts:
        np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
