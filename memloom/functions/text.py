"""Scalar text functions: sentences, paragraphs, word sets, previews, size estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The place behind . ! or ? where a blank, a line end or the end of the text follows, for Java and for Python.
SENTENCE_BREAK = r"(?<=[.!?])(?=[ \n]|\z)"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def contains_ci(c: Column, needle: str) -> Column:
    """Case-insensitive substring test; the empty needle is in every text."""
    return F.contains(F.lower(c), F.lower(F.lit(needle)))


def _pieces(c: Column, between: str) -> Column:
    return F.filter(F.transform(F.split(c, between), strip), lambda s: s != "")


def sentences(c: Column) -> Column:
    """Array of sentences: an end is . ! or ? before a blank, a line end or the end of the text."""
    return _pieces(c, SENTENCE_BREAK)


def paragraphs(c: Column) -> Column:
    return _pieces(c, r"\n\n")


def words(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def token_estimate(c: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(c) / 4).cast("long")


def preview(c: Column, longest: int = 100) -> Column:
    """At most ``longest`` characters, the last three being dots where something was left out."""
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest - 3), F.lit("..."))).otherwise(c)


def two_places(c: Column) -> Column:
    return F.format_string("%.2f", c.cast("double"))
