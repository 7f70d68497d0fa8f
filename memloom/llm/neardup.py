"""Near-duplicate texts by the Jaccard similarity of their word sets, with BK-trees over bit sketches.

Sketch: every word flips one of 256 bits, so the Hamming distance of two sketches is at most the size
of the symmetric difference of the sets. Sets with similarity >= t differ in at most
(a + b) * (1 - t) / (1 + t) words: within that radius no pair is lost.

Shards: two such sets share a word among the first n - ceil(t * n) + 1 words of each in any fixed
order (by frequency here, rare words first), so every set goes to one shard for each of these words. A
shard is a BK-tree whose children are keyed by their Hamming distance to the parent; a query follows only
the edges within its radius. Shards are routed to tasks by a shuffle rather than broadcast, since all
trees together grow with the data. A word shared by very many sets gives way to its pairs with the other
words of the prefix and one more, of which such sets share at least one; what is too large even then is
split into blocks of bounded size, each a tree of its own that all later blocks are sent to. Candidates are
checked on their words.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.components import connected_components
from memloom.runtime import materialize, shuffle_partitions, slots

WORD = re.compile(r"[^\W_]+")  # maximal runs of letters or digits
BITS = 256
COMMON = 8192  # the most frequent words, sent to every task; the order of all others is joined
BLOCK = 2048  # sets in one tree
NEAREST = 4  # candidates of a set and shard that a first search for groups gives


class BKTree:
    """Integers under Hamming distance; the children of a node are keyed by their distance to it."""

    __slots__ = ("values", "tags", "children")

    def __init__(self):
        self.values, self.tags, self.children = [], [], []

    def add(self, value: int, tag) -> None:
        at = len(self.values)
        self.values.append(value)
        self.tags.append(tag)
        self.children.append({})
        here = 0
        while here != at:
            d = (self.values[here] ^ value).bit_count()
            here = self.children[here].setdefault(d, at)

    def within(self, value: int, radius: int) -> list[tuple[int, object]]:
        """(distance, tag) of everything at most ``radius`` away."""
        found = []
        stack = [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            here = stack.pop()
            d = (values[here] ^ value).bit_count()
            if d <= radius:
                found.append((d, self.tags[here]))
            kids = children[here]
            if kids:
                low, high = d - radius, d + radius
                stack.extend([k for e, k in kids.items() if low <= e <= high])
        return found


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def word_sets(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Rows (id, set_key, text_key, words) for texts of at least ``min_words`` different words, and rows
    (word, n) with the number of such texts of a task that have the word."""

    def read(batches):
        known: dict[str, int] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            ids, keys, exact, flat, sizes = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if len(words) < min_words:
                    continue
                for w in words:
                    if w not in known:
                        known[w] = xxhash.xxh64_intdigest(w) - (1 << 63)
                hashes = np.sort(np.fromiter((known[w] for w in words), np.int64, len(words)))
                ids.append(key)
                keys.append(xxhash.xxh128_digest(hashes.tobytes()))
                exact.append(xxhash.xxh128_digest(text))
                flat.append(hashes)
                sizes.append(len(hashes))
                if len(known) > 500_000:
                    known = {}
            values = np.concatenate(flat) if flat else np.zeros(0, np.int64)
            for w, n in zip(*(x.tolist() for x in np.unique(values, return_counts=True))):
                counts[w] = counts.get(w, 0) + n
            n = len(ids)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.binary()), pa.array(exact, pa.binary()), lists, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
            if len(counts) > 500_000:
                yield tail(counts)
                counts = {}
        yield tail(counts)

    names = ["id", "set_key", "text_key", "words", "word", "n"]

    def tail(counts):
        n = len(counts)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=names)

    work = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.length("text") >= 2 * min_words - 1)
    return materialize(work.mapInArrow(read, "id string, set_key binary, text_key binary, words array<bigint>, word bigint, n bigint"), "words")


def _prefix_rows(classes: DataFrame, counts: DataFrame, common: np.ndarray, threshold: float) -> DataFrame:
    """(key, cid, n, sketch, extra): one row for each word in the prefix of a set, rare words first, and one
    more, the next word, marked ``extra``.

    The common words come last, in the order of the list. Where a set has no more other words than its
    prefix holds, all of them are in it; only for the rest the order among them matters, and they are joined
    with the table of all counts."""
    place = np.argsort(common)
    by_value = common[place]
    rank = (len(common) - place).astype(np.int64)  # the most frequent word last

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cid = batch.column(0).to_numpy()
            lists = batch.column(1)
            flat = lists.flatten().to_numpy()
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            parity = (np.bincount(owner * BITS + (flat & (BITS - 1)), minlength=len(sizes) * BITS) & 1).astype(np.uint8)
            sketch = np.packbits(parity.reshape(-1, BITS), axis=1, bitorder="little")
            late = np.zeros(len(flat), np.int64)
            if len(by_value):
                at = np.minimum(np.searchsorted(by_value, flat), len(by_value) - 1)
                late = np.where(by_value[at] == flat, rank[at], 0)
            order = np.lexsort((flat, late, owner))
            first = np.append(0, np.cumsum(sizes))[:-1]
            in_set = np.arange(len(flat)) - first[owner]
            length = prefix_length(sizes, threshold)
            others = np.bincount(owner, weights=late == 0, minlength=len(sizes)).astype(np.int64)
            undecided = (others > length + 1)[owner]
            take = np.where(undecided, late[order] == 0, in_set <= length[owner])
            own = owner[take]
            buffers = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), len(own), [None, pa.py_buffer(np.ascontiguousarray(sketch[own]))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[order][take]), pa.array(cid[own]), pa.array(sizes[own].astype(np.int32)), buffers.cast(pa.binary()), pa.array((in_set == length[owner])[take]), pa.array(np.where(undecided[take], length[own], -1).astype(np.int32))],
                names=["key", "cid", "n", "sketch", "extra", "length"],
            )

    schema = "key bigint, cid bigint, n int, sketch binary, extra boolean, length int"
    found = materialize(classes.select("cid", "words").mapInArrow(rows, schema), "ordered")
    fields = ["key", "cid", "n", "sketch"]
    settled = found.where("length < 0").select(*fields, "extra")
    if not found.where("length >= 0").limit(1).count():
        return settled
    often = counts.select(F.col("word").alias("key"), F.col("n").alias("often"))
    in_order = F.row_number().over(Window.partitionBy("cid").orderBy("often", "key"))  # as many rows as a set has words
    ranked = found.where("length >= 0").join(often, "key").withColumn("r", in_order).where(F.col("r") <= F.col("length") + 1)
    return settled.unionByName(ranked.select(*fields, (F.col("r") == F.col("length") + 1).alias("extra")))


def prefix_length(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Words of a set of which two similar sets share at least one; of one word more they share at least two."""
    return sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1


def radius(a: int, b: int, threshold: float) -> int:
    """The largest symmetric difference of sets of these sizes with the similarity."""
    return math.floor((a + b) * (1 - threshold) / (1 + threshold) + 1e-9)


def _search_shards(shards: DataFrame, threshold: float, most: int | None = None, labelled: bool = False) -> DataFrame:
    """Candidate pairs (a, b) from sorted rows (key, block, member, n, cid, sketch): members of a block
    are put into its tree in order of their size and looked up before; guests of it are only looked up.

    With ``most``, only so many of the nearest candidates of a search are given; with ``labelled``, rows have a
    seventh column, and pairs of one label aren't given."""

    def scan(batches):
        seen: set[tuple[int, int]] = set()
        tree, at = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, blocks, member = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = np.append(True, (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1]))
            alone = new & np.append(new[1:], False)
            alone[0] &= (int(keys[0]), int(blocks[0])) != at
            todo = np.flatnonzero(~alone)
            out = []
            sizes = batch.column(3).to_numpy().tolist()
            cids = batch.column(4).to_numpy().tolist()
            labels = batch.column(6).to_numpy().tolist() if labelled else cids
            sketches = batch.column(5).take(pa.array(todo)).to_pylist()
            keys, blocks, member = keys.tolist(), blocks.tolist(), member.tolist()
            for i, raw in zip(todo.tolist(), sketches):
                group = (keys[i], blocks[i])
                if group != at:
                    tree, at = BKTree(), group
                n, cid, value = sizes[i], cids[i], int.from_bytes(raw, "little")
                # Members come by size, so all in the tree are at most as large; guests may be smaller.
                reach = radius(n, n if member[i] else math.floor(n / threshold + 1e-9), threshold)
                near = [(d, other) for d, (other, m, at_label) in tree.within(value, reach) if other != cid and not (labelled and at_label == labels[i]) and min(n, m) >= threshold * max(n, m) - 1e-9 and d <= radius(n, m, threshold)]
                if most is not None and len(near) > most:
                    near = sorted(near)[:most]
                for _, other in near:
                    pair = (cid, other) if cid < other else (other, cid)
                    if pair not in seen:
                        seen.add(pair)
                        out.append(pair)
                if member[i]:
                    tree.add(value, (cid, n, labels[i]))
            if len(seen) > 1_000_000:
                seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return shards.mapInArrow(scan, "a bigint, b bigint")


def _hot(shards: DataFrame, block: int) -> DataFrame:
    """(key, blocks) of the keys of more sets than a tree may hold."""
    return shards.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, min_words: int = 20, block: int = BLOCK, common_words: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``members`` has ``id, cid, text_key`` of every text of at least ``min_words``
    different words (equal word sets share a cid, equal texts also a text_key); ``links`` has ``a, b, similarity`` for every pair of different
    sets with Jaccard similarity >= threshold, each pair once.

    ``df`` has one row an id. Null, empty and short texts are in no class; an empty table gives none;
    other columns aren't read.
    """
    members, classes, shards = _shards(df, id_col, text_col, threshold, min_words, block, common_words)
    return members, _verified(_search_shards(_in_order(shards), threshold).distinct(), classes, threshold)


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, min_words: int = 20, block: int = BLOCK, common_words: int = COMMON) -> DataFrame:
    """(id, group_id) of every text of at least ``min_words`` different words: the smallest id of all texts it is linked
    with, directly or through others.

    A group of M texts that all differ has up to M * M / 2 links, but needs no more than M - 1. So a first search
    gives each set its nearest candidates only, which joins nearly all of a group, and a second one gives
    every candidate of another group. No link between groups is missed: what the second search passes over is
    joined already. Conditions on the input are those of ``near_duplicate_classes``.
    """
    members, classes, shards = _shards(df, id_col, text_col, threshold, min_words, block, common_words)
    shards = materialize(shards, "shards")
    first = _verified(_search_shards(_in_order(shards), threshold, most=NEAREST).distinct(), classes, threshold)
    labels = materialize(connected_components(first, "a", "b").select(F.col("id").cast("long").alias("cid"), F.col("label").cast("long").alias("label")), "labels")
    named = shards.join(labels, "cid", "left").select("key", "block", "member", "n", "cid", "sketch", F.coalesce("label", "cid").alias("label"))
    second = _verified(_search_shards(_in_order(named), threshold, labelled=True).distinct(), classes, threshold)
    between = second.join(labels.withColumnsRenamed({"cid": "a", "label": "x"}), "a", "left").join(labels.withColumnsRenamed({"cid": "b", "label": "y"}), "b", "left")
    merged = connected_components(between.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    merged = merged.select(F.col("id").cast("long").alias("label"), F.col("label").cast("long").alias("last"))
    last = labels.join(merged, "label", "left").select("cid", F.coalesce("last", "label").alias("group"))
    alone = merged.select(F.col("label").alias("cid"), F.col("last").alias("group")).join(labels.select("cid"), "cid", "left_anti")
    grouped = members.join(last.unionByName(alone), "cid", "left").select("id", F.coalesce("group", "cid").alias("group"))
    smallest = grouped.groupBy("group").agg(F.min("id").alias("group_id"))
    return grouped.join(smallest, "group").select("id", "group_id")


def _in_order(shards: DataFrame) -> DataFrame:
    """Members first and by size, so that the tree is whole when the guests come."""
    parts = max(shuffle_partitions(shards.sparkSession), slots(shards.sparkSession, 2))
    return shards.repartition(parts, "key", "block").sortWithinPartitions("key", "block", F.desc("member"), "n", "cid")


def _verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the candidates that are similar enough, by their words."""
    left = classes.select(F.col("cid").alias("a"), F.col("words").alias("wa"))
    right = classes.select(F.col("cid").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("wa").alias("na"), F.size("wb").alias("nb"), F.size(F.array_intersect("wa", "wb")).alias("common"))
    similarity = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return materialize(both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold), "links")


def _shards(df: DataFrame, id_col: str, text_col: str, threshold: float, min_words: int, block: int, common_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes (cid, set_key, words), shards (key, block, member, n, cid, sketch))."""
    raw = word_sets(df, id_col, text_col, min_words)
    texts = raw.where("id is not null")
    firsts = texts.groupBy("set_key").agg(F.min("id").alias("id"))
    classes = materialize(texts.join(firsts.select("id"), "id", "left_semi").select(F.monotonically_increasing_id().alias("cid"), "set_key", "words"), "classes")
    members = materialize(texts.select("id", "set_key", "text_key").join(classes.select("set_key", "cid"), "set_key").select("id", "cid", "text_key"), "members")
    counts = materialize(raw.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    top = counts.orderBy(F.desc("n"), "word").limit(common_words).collect()
    common = np.array([r.word for r in top], dtype=np.int64)
    prefix = materialize(_prefix_rows(classes, counts, common, threshold), "prefix")
    fields = ["key", "n", "cid", "sketch"]
    hot = materialize(_hot(prefix.where("not extra"), block), "hot")
    shards = prefix.where("not extra").select(*fields)
    if 2 * threshold / (1 + threshold) * min_words > 1 and hot.limit(1).count():  # else similar sets might share one word only
        # Sets that meet only in hot words share two words of the prefix and the next one: pairs of words are the keys.
        mine = prefix.join(hot.select("key", F.lit(True).alias("hot")), "key", "left")
        lists = mine.groupBy("cid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.collect_set("key").alias("all"), F.collect_set(F.when(F.col("hot") & ~F.col("extra"), F.col("key"))).alias("few")).where(F.size("few") > 0)
        pair = lambda a, b: F.xxhash64(F.least(a, b), F.greatest(a, b))
        keys = F.array_distinct(F.flatten(F.transform("few", lambda h: F.transform(F.filter("all", lambda o: o != h), lambda o: pair(h, o)))))
        shards = shards.join(hot, "key", "left_anti").unionByName(lists.select(F.explode(keys).alias("key"), "n", "cid", "sketch"))
        shards = materialize(shards, "shards")
        hot = materialize(_hot(shards, block), "hot")
    plain, extra = shards, None
    if hot.limit(1).count():
        # Still more sets than a tree may hold: blocks, each a tree that all later blocks are sent to.
        plain = shards.join(hot, "key", "left_anti")
        cut = shards.join(hot, "key").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        extra = cut.select("key", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("block"), "own", "n", "cid", "sketch").select("key", "block", (F.col("block") == F.col("own")).alias("member"), "n", "cid", "sketch")
    shards = plain.select("key", F.lit(0).alias("block"), F.lit(True).alias("member"), "n", "cid", "sketch")
    shards = shards.unionByName(extra) if extra is not None else shards
    return members, classes, shards


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, min_words: int = 20, expand: int | None = None) -> DataFrame:
    """(node_a, node_b), the smaller id first, of all pairs of ids with similarity >= threshold.

    With ``expand``, a group of more exactly equal texts than that is given as pairs of its smallest id
    with every other member, and its smallest id stands for it in all other pairs. Different texts are
    always paired, also where their word sets are equal.
    """
    members, links = near_duplicate_classes(df, id_col, text_col, threshold, min_words)
    shown = members.select("id", "cid")
    copies = None
    if expand is not None:
        groups = members.groupBy("cid", "text_key").agg(F.count("*").alias("m"), F.min("id").alias("first"))
        known = materialize(members.join(groups, ["cid", "text_key"]), "members")
        shown = known.where((F.col("m") <= expand) | (F.col("id") == F.col("first"))).select("id", "cid")
        copies = known.where((F.col("m") > expand) & (F.col("id") != F.col("first"))).select(F.col("first").alias("x"), F.col("id").alias("y"))
    inside = shown.join(shown.withColumnRenamed("id", "other"), "cid").where("id < other").select(F.col("id").alias("x"), F.col("other").alias("y"))
    across = links.join(shown.select(F.col("cid").alias("a"), F.col("id").alias("x")), "a").join(shown.select(F.col("cid").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    found = inside.unionByName(across)
    found = found.unionByName(copies) if copies is not None else found
    return found.select(F.least("x", "y").alias("node_a"), F.greatest("x", "y").alias("node_b"))
