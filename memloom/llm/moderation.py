"""Scores for abusive, hateful and sexual language, by composed weighted finite-state transducers over clauses.

A text is cut into clauses at its sentence ends. ``Disguise`` turns every token into a word of the grammar, a
name or any other word; ``Scope`` (negation, denied opinions, naming) composed with ``Rules`` (insults,
threats, groups degraded, sexual language, each put together from rules for targets and predicates) gives the
rules a clause matches with what is kept of their weights. A clause's score in a category is 1 - the product of
(1 - weight) over its rules; a document's is 1 - the product of (1 - score) over the clauses that reach the
threshold by themselves, or else its best clause. Clauses have no size limit and every one is read whole.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm import lexicon
from memloom.llm.transducers import Composition, Disguise, Rules, Scope
from memloom.runtime import slots
from memloom.sources.tables import norm_name

# Letters that look alike, digits and signs that stand for letters.
LOOK_ALIKE = str.maketrans(
    {
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
        "ԁ": "d", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԛ": "q", "ԝ": "w",
        "ο": "o", "α": "a", "ε": "e", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ı": "i",
    }
)
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "€": "e", "£": "l", "+": "t"}
MASKS = "*#@%$?"
INVISIBLE = re.compile("[­͏᠎​-‏‪-‮⁠-⁤﻿]")
SPACED = re.compile(r"(?<![^\W_])(?<!['’])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])")
SPACED_SHORT = re.compile(r"(?<=  )[^\W\d_](?: [^\W\d_])+(?=  )")  # a short word among spaced ones
HAN = re.compile("[一-鿿]")
END = ".!?。！？…"
PAUSES = {c: "," for c in ",;，；"} | {c: ":" for c in ":："}
QUOTES = "\"'“”‘’«»„"
CLOSING = "\"'”’)»"
EDGE = "\"'“”‘’«»„()[]{}<>,;:.!?。！？…，；：、*_~`|/\\-–—"
OUTER = "\"'“”()[],;:.?…-_/<>"
SPLIT_WORD = re.compile(r"[^\W_](?:[._\-*·][^\W_]){2,}")
MARKUP = re.compile(r"</?[A-Za-z!][^<>]*>")
CATEGORIES = ("abuse", "hate", "sexual")
THRESHOLD = 0.5
ELIDED = ("c", "l", "d", "j", "t", "s", "m", "n", "qu")


def plain(word: str) -> str:
    """Lower case without accents and look-alikes."""
    word = word.lower().translate(LOOK_ALIKE)
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("ß", "ss").replace("’", "'")
    return word


class Grammar:
    """The composed machines with what turns tokens into their words."""

    KNOWN = 400_000  # tokens remembered by a process

    def __init__(self, classes: dict[str, list[str]] = lexicon.CLASSES, called=lexicon.CALLED, rules=lexicon.RULES):
        self.classes: dict[str, set[str]] = {}
        for name, words in classes.items():
            for w in words:
                self.classes.setdefault(plain(w), set()).add(f"<{name}>")
        self.rules = Rules(called, rules, {*classes, "name", "other"}, plain)
        self.words = set(self.classes) | self.rules.words
        self.machine = Composition(Scope({f"<{t}>" for t in lexicon.TERMS}), self.rules)
        self.disguise = Disguise((w for w in self.words if len(w) >= 3), SIGNS, MASKS)
        # A clause is read only if it has a word that light words can't make a rule without.
        self.light = {f"<{c}>" for c in lexicon.LIGHT} | {plain(w) for w in lexicon.LIGHT_WORDS}
        han = sorted((w for w in self.words if HAN.search(w)), key=len, reverse=True)
        self.han = re.compile("|".join(map(re.escape, han))) if han else None
        self._known: dict[str, tuple[int, bool, bool]] = {}

    def canonical(self, token: str) -> str:
        """The word of the grammar behind a token, "" if there is none."""
        raw = token.strip(EDGE) or token.strip(OUTER + "!")
        if not raw:
            return ""
        word = plain(raw)
        if word in self.words:
            return word
        if "'" in word:
            short = word.replace("'", "")
            if short in self.words:
                return short
            head, _, rest = word.partition("'")
            if head in ELIDED:
                return self.canonical(rest)
            if head in self.words:
                return head
        if SPLIT_WORD.fullmatch(word):
            word = re.sub(r"[._\-*·]", "", word)
            if word in self.words:
                return word
        full = plain(token.strip(OUTER))
        for form in dict.fromkeys((word, full)):
            # Figures alone are figures; letters, or a sign among figures, may be a disguise.
            if len(form) > 2 and ("$" in form or any(c.isalpha() for c in form)):
                found = self.disguise.decode(form)
                if found:
                    return found
        return ""

    def _read(self, token: str) -> tuple[int, bool, bool]:
        """(number of the word for the machine, whether a clause ends behind it, whether it makes a clause worth reading)."""
        bare = token.rstrip(CLOSING)
        last = bare[-1:]
        word = self.canonical(token)
        if word:
            symbols = frozenset({word, *self.classes.get(word, ())})
        else:
            raw = token.strip(EDGE)
            symbols = frozenset() if not raw[:1].isalpha() else frozenset({"<other>", "<name>"}) if raw[0].isupper() else frozenset({"<other>"})
        worth = bool(word) and not ((self.classes.get(word) or {word}) <= self.light or word in self.light)
        if len(self._known) > self.KNOWN:
            self._known.clear()
        out = self._known[token] = (self.machine.word(symbols, PAUSES.get(last, "")), last != "" and last in END, worth)
        return out

    def _clause(self, words: list[int]) -> dict[int, float]:
        """Runs the machine; words that are named afterwards are marked first where there are nouns for words."""
        machine = self.machine
        symbols = [machine.words[w][0] for w in words]
        if any("<meta>" in s for s in symbols):
            after = machine.scope.named_after(symbols)
            words = [machine.word(*machine.words[w][:2], a) if a else w for w, a in zip(words, after)]
        return machine.run(words)

    def tokens(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFKC", INVISIBLE.sub("", text))
        if "<" in text:
            text = MARKUP.sub(" ", text)
        if self.han and HAN.search(text):
            text = self.han.sub(lambda m: f" {m.group()} ", text)
            text = re.sub("([。！？])", r"\1 ", text)
        if SPACED.search(text):
            text = SPACED.sub(lambda m: self._joined(m.group()), SPACED_SHORT.sub(lambda m: m.group().replace(" ", ""), text))
        return text.split()

    def _joined(self, spaced: str) -> str:
        """Spaced letters as a word; a word of one letter may stand at either end."""
        word = spaced.replace(" ", "")
        if not self.canonical(word):
            for first, middle, last in (("", word[:-1], word[-1]), (word[0], word[1:], ""), (word[0], word[1:-1], word[-1])):
                if self.canonical(middle):
                    return " ".join(x for x in (first, middle, last) if x)
        return word

    def matches(self, text: str | None) -> list[dict[int, float]]:
        """The rules of every clause with a match, with what is kept of their weights."""
        if not text:
            return []
        known, out, begin, worth = self._known, [], 0, False
        read = [known.get(t) or self._read(t) for t in self.tokens(text)]
        for i, (_, end, worthy) in enumerate(read):
            worth = worth or worthy
            if end or i == len(read) - 1:
                if worth and (found := self._clause([w for w, _, _ in read[begin : i + 1]])):
                    out.append(found)
                begin, worth = i + 1, False
        return out

    def score(self, text: str | None) -> dict[str, float]:
        """Scores by category; empty for texts without a match, also null and empty ones."""
        rest: dict[str, float] = {}
        best: dict[str, float] = {}
        for found in self.matches(text):
            left: dict[str, float] = {}
            for rule, kept in found.items():
                category, weight = self.rules.tags[rule]
                left[category] = left.get(category, 1.0) * (1 - weight * kept)
            for category, r in left.items():
                best[category] = max(best.get(category, 0.0), 1 - r)
                if 1 - r >= THRESHOLD:
                    rest[category] = rest.get(category, 1.0) * r
        return {c: 1 - rest[c] if c in rest else b for c, b in best.items()}


_GRAMMAR: list[Grammar] = []


def grammar() -> Grammar:
    if not _GRAMMAR:
        _GRAMMAR.append(Grammar())
    return _GRAMMAR[0]


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id_col, *keep, abuse, hate, sexual, score`` for every row; whole texts are read.

    The score is that of any of the categories. Null and empty texts score 0. Repeated rows are scored
    each; an empty table gives none; columns named like the results are not passed on.
    """
    columns = [id_col, *(keep or [])]
    work = df.select(*columns, F.col(text_col).alias("_text"))

    def run(batches):
        g = grammar()
        for batch in batches:
            n = len(columns)
            scores = [g.score(t) for t in batch.column(n).to_pylist()]
            each = {c: [s.get(c, 0.0) for s in scores] for c in CATEGORIES}
            total = [1 - (1 - a) * (1 - h) * (1 - x) for a, h, x in zip(*each.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(each[c], pa.float64()) for c in CATEGORIES), pa.array(total, pa.float64())], names=[*columns, *CATEGORIES, "score"])

    fields = ", ".join(f"`{c}` {work.schema[c].dataType.simpleString()}" for c in columns)
    spread = work if work.rdd.getNumPartitions() >= slots(df.sparkSession, 1) else work.repartition(slots(df.sparkSession, 2))
    return spread.mapInArrow(run, f"{fields}, abuse double, hate double, sexual double, score double")


def source_rates(scored: DataFrame, source_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``source, documents, flagged, rate``, and the flagged of each category; sources in normal form."""
    over = lambda c: F.sum((F.col(c) >= threshold).cast("long"))
    return scored.groupBy(norm_name(source_col).alias("source")).agg(F.count("*").alias("documents"), over("score").alias("flagged"), *(over(c).alias(c) for c in CATEGORIES)).withColumn("rate", F.col("flagged") / F.col("documents"))


def label_report(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``category, labelled, flagged, both, precision, recall`` against labels: "any" and every category.

    ``labels`` has ``id_col, category``; "none" is harmless, null labels are left out, a document labelled
    twice counts twice and labels of unknown documents don't count. No weight is fitted on labels, so all
    of them are held out. Shares of nothing are null; the rows are always there.
    """
    kind = norm_name("category")
    rows = labels.where("category is not null").select(id_col, kind.alias("label")).join(scored.select(id_col, *CATEGORIES, "score"), id_col)
    parts = [F.struct(F.lit(c).alias("category"), truth.cast("long").alias("t"), (F.col(column) >= threshold).cast("long").alias("f")) for c, truth, column in (("any", F.col("label") != "none", "score"), *((c, F.col("label") == c, c) for c in CATEGORIES))]
    sums = [F.coalesce(F.sum(x), F.lit(0)).alias(name) for x, name in ((F.col("p.t"), "labelled"), (F.col("p.f"), "flagged"), (F.col("p.t") * F.col("p.f"), "both"))]
    counted = rows.select(F.explode(F.array(*parts)).alias("p")).groupBy("p.category").agg(*sums)
    every = labels.sparkSession.createDataFrame([("any",), *((c,) for c in CATEGORIES)], "category string")
    filled = every.join(counted, "category", "left").select("category", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("labelled", "flagged", "both")))
    share = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d))
    return filled.select("*", share("both", "flagged").alias("precision"), share("both", "labelled").alias("recall"))
