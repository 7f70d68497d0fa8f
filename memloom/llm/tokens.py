"""Token counts of texts by a public subword tokenizer.

The vocabulary file is named by a parameter and stays where it is; nothing is trained.
"""

from __future__ import annotations

import base64
import os
import re

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.runtime import materialize, slots

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary (published with it).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"  # what the pattern takes for white space
_CACHE: dict = {}


def encoder(vocabulary: str = VOCABULARY):
    """One tokenizer a worker process."""
    if vocabulary not in _CACHE:
        import tiktoken

        with open(vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CACHE[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CACHE[vocabulary]


def count_tokens(text: str | None, vocabulary: str = VOCABULARY, blanks: int = 10_000) -> int:
    """Null and empty texts have 0 tokens. Counts are those of the text encoded whole.

    Over very long blank runs the matcher of the pattern runs out of stack. They are taken out: the pattern makes
    all of a run, less the blank before the next word, one piece, so the piece and what is around it can be
    encoded apart with the same result.
    """
    if not text:
        return 0
    enc, total, at = encoder(vocabulary), 0, 0
    if len(text) >= blanks:
        for run in re.finditer(f"{BLANK}{{{blanks},}}", text):
            end = run.end() - (run.end() < len(text))
            total += len(enc.encode_ordinary(text[at : run.start()])) + len(enc._encode_single_piece(text[run.start() : end]))
            at = end
    return total + len(enc.encode_ordinary(text[at:] if at else text))


def token_counts(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col, *keep, n_tokens`` of every row, as a table in the shared folder: texts are read and
    encoded once, and later steps read numbers only. The vocabulary goes to the executors with the job."""
    if os.path.exists(vocabulary) and not df.sparkSession.sparkContext.master.startswith("local["):
        df.sparkSession.sparkContext.addFile(vocabulary)
    columns = [id_col, *(keep or [])]
    work = df.select(*columns, F.col(text_col).alias("_text"))

    def count(batches):
        for batch in batches:
            n = batch.num_columns - 1
            counts = [count_tokens(t, vocabulary) for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(counts, pa.int64())], names=[*columns, "n_tokens"])

    fields = ", ".join(f"`{c}` {work.schema[c].dataType.simpleString()}" for c in columns)
    spread = work if work.rdd.getNumPartitions() >= slots(df.sparkSession, 1) else work.repartition(slots(df.sparkSession, 2))
    return materialize(spread.mapInArrow(count, f"{fields}, n_tokens bigint"), "tokens")
