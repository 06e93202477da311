"""Spelling variants: a self-join of the vocabulary's trie with active-node sets.

The active nodes of a trie node are those whose strings are at most one edit
away from its own.  They follow from the active nodes of its parent, so one walk
down the trie finds all near words: the words that end at active nodes.

The trie is partitioned by what near words share.  Two words of which the longer
has L code points share L - 1 of them, those before and those after the edit.  A
cell holds the words that agree in their first ``low`` and their last ``L - high``
code points; an edit at place p is found in the cell with low <= p < high, in the
trie of what lies between.  Each length starts with two cells a word, by its
first and by its second half; a cell with too many words is split into two
narrower ranges of places, which have longer prefixes and endings, until it is
small or has a single place, where the alphabet bounds it.  So every pair of
near words meets in one cell, and no cell grows with the data.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words that a task counts before it passes them on, and words of a cell that are split if they can be.
HELD_WORDS, CELL_WORDS = 300_000, 2_000
_KEY = ["longest", "low", "high", "stem"]


def _counts(least_length: int, every: int):
    """(word, n) of a task's texts: runs with A-Z lower-cased, one of ``every`` (by hash) without one code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if (t := text.as_py()) is None:
                    continue
                start = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
                # bytes.lower() changes A-Z only
                for word, n in Counter(RUN.findall(t.encode().lower().decode())).items():
                    if len(word) < least_length:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield flush()
                    held.clear()
        yield flush()

    return run


def vocabulary(docs: DataFrame, least_length: int = 5, least_n: int = 3, every: int = 97) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text): runs of ``[A-Za-zÀ-ÿ]`` with A-Z
    lower-cased.  Where ``every`` divides the crc32 of "doc_id:run", the run loses the
    code point at that number modulo its length.  Words have ``least_length`` code
    points and occur ``least_n`` times.

    Null texts have no runs; a null doc_id is written as nothing; repeated rows count
    each.  Other columns are ignored; no rows give no words."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_counts(least_length, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


class Node:
    """A trie node: children by code point, and the number of the word that ends here (-1: none)."""

    __slots__ = ("next", "word")

    def __init__(self) -> None:
        self.next: dict[str, Node] = {}
        self.word = -1


def trie(strings: list[str]) -> Node:
    root = Node()
    for i, s in enumerate(strings):
        node = root
        for c in s:
            child = node.next.get(c)
            if child is None:
                child = node.next[c] = Node()
            node = child
        node.word = i
    return root


def near_terminals(root: Node) -> Iterator[tuple[int, int]]:
    """Pairs of words of the trie at distance one, each in both orders.

    Walks down with the active nodes of each node: ``same`` has the node's own
    string, ``near`` holds those at distance one."""
    stack = [(root, list(root.next.values()))]
    while stack:
        same, near = stack.pop()
        if same.word >= 0:
            for v in near:
                if v.word >= 0:
                    yield same.word, v.word
        for c, child in same.next.items():
            # the code point is missing there; another stands in its place; one more follows it
            active = {id(same): same}
            for other in same.next.values():
                if other is not child:
                    active[id(other)] = other
            for more in child.next.values():
                active[id(more)] = more
            for v in near:
                if (w := v.next.get(c)) is not None:
                    active[id(w)] = w
            active.pop(id(child), None)
            stack.append((child, list(active.values())))


def _common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _cell_pairs(key: tuple, words: list[str], ns: list[int]) -> Iterator[tuple[str, str, int, int]]:
    """Near words of a cell, in both orders, whose edit has its place there."""
    longest, low, high, _ = key
    for i, j in near_terminals(trie([w[low : len(w) - (longest - high)] for w in words])):
        a, b = words[i], words[j]
        if max(len(a), len(b)) == longest and _common_start(a, b) < high:
            yield a, b, ns[i], ns[j]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted cells."""
    key, words, ns, out = None, [], [], []
    names = ["word", "near", "n", "near_n"]

    def written() -> pa.RecordBatch:
        a, b, na, nb = zip(*out) if out else ((), (), (), ())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(na, pa.int64()), pa.array(nb, pa.int64())], names)

    for batch in batches:
        for *at, word, n in zip(*(batch.column(c).to_pylist() for c in [*_KEY, "word", "n"])):
            if at != key:
                if len(words) > 1:
                    out.extend(_cell_pairs(key, words, ns))
                    if len(out) > 20_000:
                        yield written()
                key, words, ns = at, [], []
            words.append(word)
            ns.append(n)
    if len(words) > 1:
        out.extend(_cell_pairs(key, words, ns))
    yield written()


def _cells(rows: DataFrame, ranges) -> DataFrame:
    """``rows`` (word, n, longest) in the cells of ``ranges``, an array of (low, high) structs."""
    rows = rows.withColumn("_r", F.explode(ranges)).select("word", "n", "longest", F.col("_r.low").alias("low"), F.col("_r.high").alias("high"))
    ending = F.col("longest") - F.col("high")
    # a word keeps to its cell with what it shares: its start, a mark, its end
    stem = F.concat(F.substring("word", F.lit(1), F.col("low")), F.lit("|"), F.substring("word", F.char_length("word") - ending + 1, ending))
    return rows.withColumn("stem", stem)


def _range(low, high):
    return F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, n, near_n): all pairs of ``words`` (word, n; distinct) that differ by
    one inserted, deleted or replaced code point, in both orders.

    Null and empty words take no part, as they share nothing that could be hashed;
    words of one code point meet the others of one or two.  No words give no pairs."""
    rows = words.where(F.char_length("word") > 0).select("word", "n", F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)).alias("longest"))
    half = F.floor(F.col("longest") / 2)
    open_cells = materialise(_cells(rows, F.array(_range(F.lit(0), half), _range(half, F.col("longest")))), "cells")
    settled = None
    while True:
        counts = open_cells.groupBy(*_KEY).agg(F.count("*").alias("words"))
        large = materialise(counts.where((F.col("words") > CELL_WORDS) & (F.col("high") - F.col("low") > 1)).select(*_KEY), "large")
        if large.isEmpty():
            settled = open_cells if settled is None else settled.unionByName(open_cells)
            break
        # a cell is one row of the smaller side, so that a large one can be split by adaptive execution
        small = open_cells.join(large, _KEY, "left_anti")
        settled = small if settled is None else settled.unionByName(small)
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        split = open_cells.join(large, _KEY, "left_semi").withColumn("_ranges", F.array(_range(F.col("low"), middle), _range(middle, F.col("high"))))
        open_cells = materialise(_cells(split.select("word", "n", "longest", "_ranges"), F.col("_ranges")), "cells")
    dealt = settled.repartition(*_KEY).sortWithinPartitions(*_KEY).select(*_KEY, "word", "n")
    return dealt.mapInArrow(_joined, "word string, near string, n long, near_n long")


def spelling_groups(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n; distinct).

    A word's form is its near word of largest n (ties: the smallest in code-point
    order), if that n is at least ``times`` the word's; its root is where its forms
    lead.  As n grows from form to form by that factor, there are few steps and no
    rings.  A word without near words, or without a frequent one, is its own root
    and has null form and form_n.  No words give no rows."""
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words).unionByName(words.withColumns({"near": F.lit(None).cast("string"), "near_n": F.lit(None).cast("long")}))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("n"), "near")))
    summed = near.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("_b"))
    formed = -F.col("_b.n") >= times * F.col("n")
    rows = summed.select("word", "n", "n_near", F.when(formed, F.col("_b.near")).alias("form"), F.when(formed, -F.col("_b.n")).alias("form_n"))
    rows = materialise(rows, "forms")
    steps = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps taken
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        steps = materialise(steps.select("word", "root").join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if steps.where("moved").isEmpty():
            break
    out = rows.join(steps.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
