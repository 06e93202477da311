"""Benchmark decontamination: a BM25 index of test items, searched by every
passage of the corpus with block-max WAND, then a check of shingle overlap.

Impacts of an item's postings are its BM25 term weights divided by the item's
score against itself, so that one threshold (the share of an item's weight
that a passage covers) suits short and long items alike.  Postings are cut in
blocks of ``BLOCK_ITEMS`` neighbouring items, the same cut for every term, each
with its largest impact: a passage skips a block in which its terms' largest
impacts cannot sum to the threshold, and walks the rest by WAND's pivots.

Postings and largest impacts are flat arrays, a run for each term, so an index
takes some 30 bytes a posting besides its words, and none for blocks in which a
term does not occur.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shingle_set

K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def plain_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased and ASCII punctuation taken out."""
    return text.encode().lower().translate(None, PUNCTUATION).split() if text else []


#: Sums of largest impacts that are held at once.
BOUNDS = 2_000_000


def halves(words: list[bytes]) -> tuple[set, set, set]:
    """Shingles of an item, of its question (first half) and of its answer."""
    middle = (len(words) + 1) // 2
    return shingle_set(words), shingle_set(words[:middle]), shingle_set(words[middle:])


class Index:
    """Postings of a bounded block of items, all of one length class.

    Run t of ``item`` and ``impact``, from ``first[t]`` on, are term t's postings by item;
    run t of ``block`` and ``top``, from ``blocks_of[t]`` on, its blocks and largest impacts, and
    ``at`` is where each block's postings begin."""

    def __init__(self, items: list[int], words: list[list[bytes]]) -> None:
        self.items, self.texts = items, [b" ".join(w) for w in words]
        self.passage = max(128, 2 * max(map(len, words), default=0))

    def weigh(self, n_items: int, mean_words: float, df: dict[bytes, int]) -> Index:
        """Fill the postings; the counts are those of all items, not of this block."""
        self.vocabulary: dict[bytes, int] = {}
        terms, items, impacts = array("i"), array("i"), array("d")
        for i, text in enumerate(self.texts):
            words = text.split()
            norm = K1 * (1 - B + B * len(words) / mean_words)
            score = {w: np.log1p((n_items - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in Counter(words).items()}
            whole = sum(score.values())
            for w, x in score.items():
                terms.append(self.vocabulary.setdefault(w, len(self.vocabulary)))
                items.append(i)
                impacts.append(float(x / whole))
        term = np.frombuffer(terms, np.int32) if len(terms) else np.empty(0, np.int32)
        order = np.argsort(term, kind="stable")  # items are ascending in each term
        term = term[order]
        self.item = np.array(items, np.int32)[order]
        self.impact = np.array(impacts, np.float64)[order]
        n, self.blocks = len(self.vocabulary), -(-max(1, len(self.texts)) // BLOCK_ITEMS)
        key = term.astype(np.int64) * self.blocks + self.item // BLOCK_ITEMS
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        self.at = np.append(starts, len(key)).astype(np.int64)
        self.key = key[starts]
        self.block = (self.key % self.blocks).astype(np.int32)
        self.top = np.maximum.reduceat(self.impact, starts).astype(np.float32) if len(starts) else np.empty(0, np.float32)
        self.blocks_of = np.searchsorted(term[starts], np.arange(n + 1))
        return self

    def _bounds(self, row: np.ndarray, terms: np.ndarray, rows: int) -> np.ndarray:
        """Sums of the largest impacts of ``terms``, by ``row`` and block."""
        counts = self.blocks_of[terms + 1] - self.blocks_of[terms]
        ends = np.cumsum(counts)
        run = np.repeat(self.blocks_of[terms] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        keys = np.repeat(row, counts) * self.blocks + self.block[run]
        return np.bincount(keys, self.top[run], rows * self.blocks).reshape(rows, self.blocks)

    def wand(self, terms: list[int] | np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
        """Items of one block that score at least ``threshold``, by pivoting."""
        want = np.asarray(terms, np.int64) * self.blocks + block
        j = np.searchsorted(self.key, want)
        j = j[self.key[np.minimum(j, len(self.key) - 1)] == want] if len(self.key) else j[:0]
        # [item, place, end, largest impact in this block]
        found, cursors = [], [list(c) for c in zip(self.item[self.at[j]].tolist(), self.at[j].tolist(), self.at[j + 1].tolist(), self.top[j].tolist())]
        item, impact = self.item, self.impact
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= threshold - 1e-6:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                score = sum(float(impact[c[1]]) for c in cursors if c[0] == pivot)
                if score >= threshold - 1e-9:
                    found.append((pivot, score))
                pivot += 1
            for c in cursors:
                while c[0] < pivot:
                    c[1] += 1
                    c[0] = int(item[c[1]]) if c[1] < c[2] else len(self.texts)
            cursors = [c for c in cursors if c[1] < c[2]]
        return found

    def search(self, words: list[bytes], threshold: float) -> Iterator[tuple[int, float, int]]:
        """(item, score, passage start) of every passage that retrieves an item."""
        get, none = self.vocabulary.get, len(self.vocabulary)
        ids = np.array([get(w, none) for w in words], np.int64)
        step = self.passage // 2
        # Bounds of half passages, each term once a half; two of them bound a passage.
        n_halves, held = -(-len(ids) // step), max(2, BOUNDS // self.blocks)
        pairs = np.unique(np.arange(len(ids)) // step * (none + 1) + ids)
        half, term = pairs // (none + 1), pairs % (none + 1)
        half, term = half[term < none], term[term < none]
        for first in range(0, n_halves, held - 1):
            rows = min(held, n_halves - first)
            if first and rows < 2:
                break  # the last half was the second one of the passage before
            own = slice(*np.searchsorted(half, [first, first + rows]))
            bounds = self._bounds(half[own] - first, term[own], rows)
            if rows > 1:
                bounds = bounds[:-1] + bounds[1:]
            for k in np.flatnonzero((bounds >= threshold - 1e-5).any(1)):
                start = (first + int(k)) * step
                terms = np.unique(ids[start : start + self.passage])
                terms = terms[terms < none]
                tight = self._bounds(np.zeros(len(terms), np.int64), terms, 1)[0]
                for block in np.flatnonzero(tight >= threshold - 1e-5):
                    for i, s in self.wand(terms, int(block), threshold):
                        yield i, s, start

    def confirmed(self, words: list[bytes], threshold: float, percent: int, part_percent: int) -> dict[int, tuple[float, ...]]:
        """For each item in the text: the best of score, item, question and answer
        overlap over the passages that retrieve it and pass the overlap check.

        A score says nothing of word order, so no passage stands for another."""
        best: dict[int, tuple[float, ...]] = {}
        at, have, parts = -1, {}, {}
        for i, score, start in self.search(words, threshold):
            if start != at:
                at, have = start, {}
            if i not in parts:
                parts[i] = halves(self.texts[i].split())
            size = shingle_size(parts[i])
            if size not in have:
                have[size] = shingles_of(words[start : start + self.passage], size)
            whole, question, answer = shares(have[size], parts[i])
            if 100 * whole >= percent and 100 * min(question, answer) >= part_percent:
                figures = (score, whole, question, answer)
                best[i] = tuple(map(max, figures, best.get(i, figures)))
        return best


def length_class(words: list[bytes]) -> int:
    """Items of one class differ in length by a factor of two at most, or have up to 64 words."""
    return max(6, (max(1, len(words)) - 1).bit_length())


def shingle_size(parts: tuple[set, set, set]) -> int:
    return min(len(next(iter(parts[0]))), 5)


def shingles_of(words: list[bytes], size: int) -> set:
    return set(zip(*(words[i:] for i in range(size)))) if len(words) >= size else set()


def shares(have: set, parts: tuple[set, set, set]) -> tuple[float, ...]:
    """Shares of the item's, question's and answer's shingles among a text's."""
    size = shingle_size(parts)

    def share(part: set) -> float:
        part = {s for s in part if len(s) == size}  # halves under five words: the whole decides
        return len(part & have) / len(part) if part else 1.0

    return tuple(map(share, parts))


_HITS = "doc_id long, item_id long, bm25 double, item_overlap double, question_overlap double, answer_overlap double"


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [list(dict.fromkeys(plain_words(t.as_py()))) for t in batch.column(0)]
        flat = pa.array([w for row in words for w in row], pa.binary())
        block = np.repeat(np.array(batch.column(1).to_pylist(), np.int32), [len(row) for row in words])
        yield pa.RecordBatch.from_arrays([flat, pa.array(block, pa.int32())], ["term", "block"])


def indexes(items: DataFrame, block_bytes: int = 8 << 20) -> Iterator[list[Index]]:
    """One block after another, each of items of about ``block_bytes`` of text, with
    an index for each length class, so that passages fit their items.

    Items are dealt by hash until no block of more than one item exceeds twice
    that size, so what reaches the driver and is broadcast is bounded however
    large the benchmark is.  Item counts, mean length and document frequencies
    are those of all items."""
    items = items.where("item_id is not null and trim(text) != ''").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    while True:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int").alias("block")
        largest = items.groupBy(block).agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("c")).where(f"c > 1 and b > {2 * block_bytes}").limit(1).count()
        if not largest:
            break
        n *= 2
    dealt = items.select("item_id", "text", block)
    terms = materialise(dealt.select("text", "block").mapInArrow(_terms, "term binary, block int").groupBy("term", "block").agg(F.count("*").alias("n")), "term")
    frequent = materialise(terms.groupBy("term").agg(F.sum("n").alias("df")), "df")
    n_items = items.count()
    mean = items.agg(F.avg(F.size(F.split(F.trim("text"), "[ \\t\\n\\x0B\\f\\r]+")))).first()[0] or 1.0
    for k in range(n):
        rows = dealt.where(F.col("block") == k).select("item_id", "text").toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        classes: dict[int, tuple[list, list]] = {}
        for item_id, text in zip(rows["item_id"].to_pylist(), rows["text"]):
            words = plain_words(text.as_py())
            ids, texts = classes.setdefault(length_class(words), ([], []))
            ids.append(item_id)
            texts.append(words)
        df = terms.where(F.col("block") == k).join(frequent, "term").select("term", "df").toArrow()
        counts = dict(zip(df["term"].to_pylist(), df["df"].to_pylist()))
        yield [Index(*classes[c]).weigh(n_items, mean, counts) for c in sorted(classes)]


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.6, percent: int = 75, part_percent: int = 50) -> DataFrame:
    """(doc_id, item_id, bm25, item_overlap, question_overlap, answer_overlap) of
    every document that contains a benchmark item.

    Every overlapping passage (twice the longest item of a length class, at least
    128 words, half of it shared with the next) of every document is a query; an
    item it retrieves is confirmed, passage by passage, if at least ``percent`` hundredths of the item's
    five-word shingles, and ``part_percent`` of those of its question (first
    half) and of its answer (second half), are in the passage.

    Null and empty texts, and items without words, match nothing; an item under
    five words is one shingle.  Rows that share a doc_id or item_id add up, one
    row a pair, with the best of each figure.  Rows without a doc_id are not
    reported.  Other columns are ignored; no items give an empty result."""
    spark = docs.sparkSession
    texts, found = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for block in indexes(items):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    words = plain_words(text.as_py())
                    for index in shared.value:
                        pairs = index.confirmed(words, threshold, percent, part_percent)
                        rows += [(doc_id, index.items[i], *figures) for i, figures in pairs.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[c.split()[0] for c in _HITS.split(", ")])

        hits = texts.mapInArrow(scan, _HITS)
        found = hits if found is None else found.union(hits)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("bm25", "item_overlap", "question_overlap", "answer_overlap")))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, all columns kept."""
    dirty = contaminated(docs, items).select("doc_id").distinct()
    return docs.join(dirty, docs["doc_id"].cast("long") == dirty["doc_id"], "left_anti")
