"""Document chunkers: fixed windows, semantic grouping, hierarchies; and ingestion of documents as nodes and edges."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions.text import SENTENCE_BREAK, paragraphs, sentences, strip

CHUNK = "idx int, range_start int, range_end int, content string, boundary_score double, chunk_type string, level int, error string"
LEVEL = {"document": 0, "paragraph": 1, "sentence": 2, "custom": 3}


@dataclass(frozen=True)
class FixedConfig:
    size: int = 1000
    overlap: int = 100

    def __post_init__(self):
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise ValueError("size is over 0 and overlap is under size")


@dataclass(frozen=True)
class SemanticConfig:
    min_size: int = 100
    max_size: int = 1000
    threshold: float = 0.3
    first_boundary_only: bool = False

    def __post_init__(self):
        if not 0 <= self.min_size <= self.max_size or self.max_size <= 0 or not 0 <= self.threshold <= 1:
            raise ValueError("sizes or threshold are out of bounds")


@dataclass(frozen=True)
class HierarchicalConfig:
    document: int = 500
    paragraph: int = 1000
    sentence: int = 200
    threshold: float = 0.3


def fixed_windows(text: str, config: FixedConfig) -> list[tuple]:
    """Windows of ``size`` characters: cut behind the first line end in the last 100 characters of the window, else
    before its last blank, else hard; the next window begins ``overlap`` characters before the cut, unless less
    than a step is left. A cut that would not take the next window further is passed over."""
    text = text.strip()
    n, out, start = len(text), [], 0
    while start < n:
        end = min(start + config.size, n)
        if end < n:
            cut = text.find("\n", max(start, end - 100), end) + 1
            if cut <= start + config.overlap:
                cut = text.rfind(" ", start + 1, end)
            if cut > start + config.overlap:
                end = cut
        out.append((len(out), start, end, text[start:end], 1.0, "custom", 3, None))
        start = end - config.overlap if end + config.size - config.overlap < n else end
    return out


_BREAK = re.compile(SENTENCE_BREAK.replace(r"\z", r"\Z"))


def split_sentences(text: str) -> list[str]:
    """As ``functions.text.sentences``, for use inside a task."""
    return [s for s in (x.strip() for x in _BREAK.split(text)) if s]


def cut_bytes(text: str, size: int) -> list[str]:
    """Pieces of at most ``size`` bytes, no character divided (a single larger one stands alone)."""
    raw, out, at = text.encode(), [], 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80 and end > at:
            end -= 1
        if end == at:
            end = next((i for i in range(at + 1, len(raw)) if raw[i] & 0xC0 != 0x80), len(raw))
        out.append(raw[at:end].decode())
        at = end
    return out


def word_jaccard(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def semantic_groups(text: str, config: SemanticConfig) -> list[tuple]:
    """Sentences grouped in order: a group of at least ``min_size`` bytes ends where another sentence would take it
    over ``max_size``, or where the words of the two sentences before and the two after have a similarity
    under the threshold. Sizes are those of the sentences, without the blanks between them."""
    text = text.strip()
    if len(text.encode()) < config.min_size:
        return [(None, None, None, None, None, None, None, f"InputTooShort({config.min_size}, {len(text.encode())})")]
    parts = split_sentences(text)
    bags = [set(s.split()) for s in parts]
    join = lambda lo, hi: set().union(*bags[max(0, lo) : hi])
    cuts = {i for i in range(1, len(parts)) if word_jaccard(join(i - 2, i), join(i, i + 2)) < config.threshold}
    if config.first_boundary_only and cuts:
        cuts = {min(cuts)}
    out, group, size, at = [], [], 0, 0

    def close():
        nonlocal group, size, at
        body = " ".join(group)
        out.append((len(out), at, at + len(body), body, 0.8, "paragraph", 1, None))
        at += len(body) + 1
        group, size = [], 0

    for i, s in enumerate(parts):
        n = len(s.encode())
        if size and size >= config.min_size and (size + n > config.max_size or i in cuts):
            close()
        size += n
        group.append(s)
    if group:
        close()
    return out


def _chunk(df: DataFrame, id_col: str, text_col: str, split) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in CHUNK.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.int32(), pa.string()]

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None or not text.strip():
                    found = [(None, None, None, None, None, None, None, "EmptyInput")]
                else:
                    found = split(text)
                ids += [key] * len(found)
                rows += found
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=[id_col, *names])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {CHUNK}")


def chunk_fixed(df: DataFrame, id_col: str, text_col: str, config: FixedConfig = FixedConfig()) -> DataFrame:
    """A row a chunk; texts that are null or blank have one row with ``error``."""
    return _chunk(df, id_col, text_col, lambda t: fixed_windows(t, config))


def chunk_semantic(df: DataFrame, id_col: str, text_col: str, config: SemanticConfig = SemanticConfig()) -> DataFrame:
    """As chunk_fixed; texts under ``min_size`` bytes have one row with ``error``."""
    return _chunk(df, id_col, text_col, lambda t: semantic_groups(t, config))


def chunk_hierarchical(df: DataFrame, id_col: str, text_col: str, config: HierarchicalConfig = HierarchicalConfig()) -> DataFrame:
    """``chunk_id, parent_id, level`` and the fields of a chunk for a document, its paragraphs and their sentences.

    The document's content is its first ``document`` characters, cut at the last blank. Sentences of more than
    ``sentence`` bytes are cut. Texts under a tenth of ``paragraph`` bytes have one row with ``error``."""

    def prefix(text: str) -> str:
        if len(text) <= config.document:
            return text
        head = text[: config.document]
        return (head.rsplit(None, 1)[0] if " " in head.strip() else head) + "..."

    def split(text: str) -> list[tuple]:
        text = text.strip()
        out = [(0, 0, len(text), prefix(text), 1.0, "document", 0, None)]
        for group in semantic_groups(text, SemanticConfig(config.paragraph // 10, config.paragraph, config.threshold)):
            if group[3] is None:
                return [group]
            out.append(group)
            pieces = [x for s in split_sentences(group[3]) for x in cut_bytes(s, config.sentence)]
            # The error field carries the index of the paragraph until ids are made.
            out += [(i, 0, len(s), s, 0.9, "sentence", 2, str(group[0])) for i, s in enumerate(pieces)]
        return out

    rows = _chunk(df, id_col, text_col, split)
    doc = F.col(id_col).cast("string")
    para = F.concat(doc, F.lit("/p"), F.col("idx").cast("string"))
    sent = F.concat(doc, F.lit("/p"), F.col("error"), F.lit("/s"), F.col("idx").cast("string"))
    return rows.select(
        id_col,
        F.when(F.col("level") == 0, doc).when(F.col("level") == 1, para).when(F.col("level") == 2, sent).alias("chunk_id"),
        F.when(F.col("level") == 1, doc).when(F.col("level") == 2, F.concat(doc, F.lit("/p"), F.col("error"))).alias("parent_id"),
        "idx", "range_start", "range_end", "content", "boundary_score", "chunk_type", "level",
        F.when(F.col("level").isNull(), F.col("error")).alias("error"),
    )


def child_ids(chunks: DataFrame) -> DataFrame:
    """(chunk_id, child_ids) in order of their index."""
    return chunks.where("parent_id is not null").groupBy(F.col("parent_id").alias("chunk_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "chunk_id"))), lambda x: x["chunk_id"]).alias("child_ids"))


def sentence_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(id_col, F.posexplode(sentences(F.col(text_col))).alias("idx", "sentence"))


def paragraph_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(id_col, F.posexplode(paragraphs(F.col(text_col))).alias("idx", "paragraph"))


def ingest_documents(docs: DataFrame, as_of: str, strategy: str = "semantic", config=None, embed=None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents (document_id, title, text): a concept node "title: text" for each and a
    raw chunk for each piece, linked to it by is_part_of. Ids come from the document's id and the index."""
    if strategy == "fixed":
        chunks = chunk_fixed(docs, "document_id", "text", config or FixedConfig())
    elif strategy == "semantic":
        chunks = chunk_semantic(docs, "document_id", "text", config or SemanticConfig(50, 500, 0.5))
    elif strategy == "hierarchical":
        chunks = chunk_hierarchical(docs, "document_id", "text", config or HierarchicalConfig()).where("level = 1")
    else:
        raise ValueError(f"strategy {strategy!r}")
    now = F.lit(as_of).cast("timestamp")
    meta = lambda kind: [F.lit(kind).alias("node_type"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("timestamp").alias("accessed_at"), F.lit(1.0).alias("access_score"), F.lit(1.0).alias("confidence"), F.lit("file_upload").alias("source")]
    whole = docs.select(F.col("document_id").alias("id"), F.concat(F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("text", F.lit(""))).alias("content"), *meta("concept"), F.col("document_id"), F.lit(None).cast("int").alias("chunk_index"))
    good = chunks.where("content is not null")
    cid = F.concat_ws("#", "document_id", F.col("idx").cast("string"))
    parts = good.select(cid.alias("id"), "content", *meta("raw_chunk"), "document_id", F.col("idx").alias("chunk_index"))
    nodes = whole.unionByName(parts)
    if embed is not None:
        nodes = nodes.withColumn("embedding", embed(F.col("content")))
    edges = good.select(cid.alias("source"), F.col("document_id").alias("target"), F.lit("is_part_of").alias("relation"), F.lit(1.0).alias("weight"), now.alias("created_at"), F.lit(False).alias("expired"), F.col("idx").cast("long").alias("seq"))
    return nodes, edges


def chunks_from_ranges(df: DataFrame, id_col: str, text_col: str, ranges_col: str, chunk_type: str = "custom") -> DataFrame:
    """``id_col, idx, range_start, range_end, content, chunk_type`` for an array of (start, end) character offsets:
    the trimmed slices. Offsets beyond the text give what there is; null texts or arrays give no rows."""
    r = df.select(id_col, text_col, F.posexplode(ranges_col).alias("idx", "r"))
    fields = df.schema[ranges_col].dataType.elementType.names
    start, end = (F.col("r")[f] for f in fields[:2])
    return r.where(F.col(text_col).isNotNull()).select(id_col, "idx", start.alias("range_start"), end.alias("range_end"), strip(F.substring(F.col(text_col), start + 1, end - start)).alias("content"), F.lit(chunk_type).alias("chunk_type"))
