"""Hard negatives by blocked dense products of anchors with all rows.

Anchors are cut into blocks of bounded bytes.  A block is broadcast; every task
multiplies it with batches of its candidates, in doubles, where integer products
below 2^53 are exact (numbers beyond are multiplied as integers).  Two passes:
the first keeps each anchor's best rows of its own label, the second, when those
are known, the best rows of other labels whose score lies in the window of each
positive.  A task keeps a few rows an anchor however many candidates it reads,
and what tasks keep is merged by anchor.

The work is anchors times rows by its nature; no pair of them becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Bytes of a broadcast block of anchors, and entries of a product that is held at once.
BLOCK_BYTES, PRODUCT = 8 << 20, 2_000_000
EXACT = float(2**53)
LONG = np.iinfo(np.int64)
_NONE = LONG.min  # no row; scores end one above it


class Anchors:
    """A block of anchors of one dimension: ids (ascending), label codes and vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.labels, self.x = ids, labels, x

    def scores(self, y: np.ndarray) -> np.ndarray:
        """Integer inner products with the rows of ``y``; beyond a long they are its ends."""
        with np.errstate(over="ignore", invalid="ignore"):
            wide = ~(np.abs(y).max(1, initial=0) * np.abs(self.x).sum(1).max(initial=0) < EXACT)
            out = np.empty((len(self.x), len(y)), np.int64)
            out[:, ~wide] = (self.x @ y[~wide].T).astype(np.int64)
        for j in np.flatnonzero(wide):
            own = [int(v) for v in y[j]]
            for i, a in enumerate(self.x):
                out[i, j] = min(max(sum(int(v) * w for v, w in zip(a, own)), LONG.min + 1), LONG.max)
        return out


class Best:
    """The first k of what was seen for each of n lists: higher scores first, ties to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.id = np.full((n, k), _NONE), np.full((n, k), LONG.max)

    def offer(self, s: np.ndarray, ids: np.ndarray, at: np.ndarray | None = None) -> None:
        """Columns of ``s`` (changed) are rows of ascending ``ids``; its rows are the lists ``at``, or all."""
        at = np.arange(len(s)) if at is None else at
        k = self.score.shape[1]
        top = s.max(1, initial=_NONE)
        live = np.flatnonzero((top > _NONE) & (top >= self.score[at, -1]))
        if not len(live):
            return
        s, at = s[live], at[live]
        rows, score, who = np.arange(len(at)), np.full((len(at), k), _NONE), np.full((len(at), k), LONG.max)
        for i in range(min(k, s.shape[1])):
            j = s.argmax(1)  # the first of equal scores has the smallest id
            score[:, i] = s[rows, j]
            who[:, i] = np.where(score[:, i] > _NONE, ids[j], LONG.max)
            s[rows, j] = _NONE
        score, who = np.hstack([self.score[at], score]), np.hstack([self.id[at], who])
        # ~score turns the order round without leaving the range of a long
        order = np.lexsort((who, ~score), axis=1)[:, :k]
        self.score[at], self.id[at] = np.take_along_axis(score, order, 1), np.take_along_axis(who, order, 1)


def _batches(batches: Iterator[pa.RecordBatch], dim: int, n_anchors: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, label codes, vectors) of rows of the dimension, by ascending id, in products of bounded size."""
    most = max(1, PRODUCT // max(1, n_anchors))
    for batch in batches:
        keep = np.flatnonzero(batch.column(3).to_numpy() == dim)
        ids, labels, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        for i in range(0, len(keep), most):
            part = keep[i : i + most]
            part = part[np.argsort(ids[part], kind="stable")]
            flat = vectors.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False)
            yield ids[part], labels[part], flat.reshape(len(part), dim)


def _positives(block, dim: int, k: int):
    """Each anchor's first k rows of its label among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Anchors = block.value[0]
        best = Best(len(a.ids), k)
        for ids, labels, y in _batches(batches, dim, len(a.ids)):
            for label in np.intersect1d(a.labels, labels):
                mine, its = np.flatnonzero(a.labels == label), np.flatnonzero(labels == label)
                s = Anchors(a.ids[mine], a.labels[mine], a.x[mine]).scores(y[its])
                s[a.ids[mine][:, None] == ids[its][None, :]] = _NONE
                best.offer(s, ids[its], mine)
        i, j = np.nonzero(best.score > _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(a.ids[i]), pa.array(best.id[i, j]), pa.array(best.score[i, j])], ["anchor_id", "row_id", "score"])

    return run


def _negatives(block, dim: int, k: int):
    """For each pair of an anchor and a positive the first k rows of other labels in its window among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, of, positive, low, high = block.value
        best = Best(len(of), k)
        # the pairs of the anchors, one of each anchor at a time
        nth = np.arange(len(of)) - np.searchsorted(of, of) if len(of) else of
        layers = [np.flatnonzero(nth == i) for i in range(int(nth.max(initial=-1)) + 1)]
        for ids, labels, y in _batches(batches, dim, len(a.ids)):
            s = a.scores(y)
            s[(a.labels[:, None] == labels[None, :]) | (a.ids[:, None] == ids[None, :])] = _NONE
            for pairs in layers:
                w = s[of[pairs]]
                w[(w < low[pairs, None]) | (w > high[pairs, None])] = _NONE
                best.offer(w, ids, pairs)
        i, j = np.nonzero(best.score > _NONE)
        columns = [a.ids[of[i]], positive[i], best.id[i, j], high[i], best.score[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return run


def finite(vector: Column | str) -> Column:
    """Not null and without null or non-finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(vector: Column | str, scale: float = 256) -> Column:
    """Each component x as floor(scale * x), a double."""
    v = F.col(vector) if isinstance(vector, str) else vector
    # beyond 2^53 a double is whole, and a long could not hold it
    return F.transform(v.cast("array<double>"), lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale))


def hard_negatives(vectors: DataFrame, k: int = 5, positives: int = 5, every: int = 100, low: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for
    ``vectors`` (vec_id, label, embedding), whose components are whole numbers.

    Anchors are the rows whose vec_id is divisible by ``every``; a score is the inner
    product with the anchor, and higher scores come first, ties by smaller vec_id.
    Positives are an anchor's first ``positives`` other rows of its label; each has
    as negatives the first ``k`` rows of other labels with ``low[0]/low[1] *
    positive_score <= negative_score <= positive_score``.

    Rows without vec_id, label or vector, or with null or non-finite components, take
    no part; vectors of different lengths are not compared; empty vectors score 0.
    Rows that repeat an anchor's vec_id are its own and no rows for it, the anchor
    is one of them, the same at each run; other repeated rows count each.
    Scores beyond a long are its ends.  Other columns are ignored; no rows, or no
    anchors, give an empty result."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumns({"dim": F.size("embedding"), "code": F.xxhash64("label")}).select("vec_id", "code", "embedding", "dim")
    cores = spark.sparkContext.defaultParallelism
    # every task has much to do with few rows
    rows = materialise(rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows, "rows")
    anchors = rows.where(F.col("vec_id") % every == 0)
    anchors = anchors.groupBy("dim", "vec_id").agg(F.min(F.struct("code", "embedding")).alias("_a")).select("dim", "vec_id", "_a.*")
    anchors = materialise(anchors.withColumn("h", F.xxhash64("vec_id")), "anchors")
    found = None
    for dim, n in sorted(anchors.groupBy("dim").count().collect()):  # a row a length of vectors
        blocks = max(1, -(-n * 8 * (dim + 4) // BLOCK_BYTES))
        for b in range(blocks):
            part = anchors.where((F.col("dim") == dim) & (F.pmod("h", F.lit(blocks)) == b))
            kept = _mined(spark, rows.where(F.col("dim") == dim), part, dim, k, positives, low)
            found = kept if found is None else found.union(kept)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return found


def _mined(spark, rows: DataFrame, part: DataFrame, dim: int, k: int, positives: int, low: tuple[int, int]) -> DataFrame:
    """Both passes for one block of anchors; the result is written, and the block let go."""
    block = part.orderBy("vec_id").toArrow()
    ids = block.column("vec_id").to_numpy()
    x = block.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
    a = Anchors(ids, block.column("code").to_numpy(), x)
    first_block = spark.sparkContext.broadcast((a,))
    near = rows.mapInArrow(_positives(first_block, dim, positives), "anchor_id long, row_id long, score long")
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "row_id"))
    chosen = near.withColumn("_n", first).where(F.col("_n") <= positives).select("anchor_id", "row_id", "score").toArrow()  # a few rows an anchor of the block
    # a row that repeats as a positive of an anchor is one pair
    pair = sorted(set(zip(*(chosen.column(c).to_pylist() for c in ("anchor_id", "score", "row_id")))))
    at, high, positive = (np.array([p[i] for p in pair], np.int64) for i in range(3))
    bounds = np.array([-(-low[0] * p[1] // low[1]) for p in pair], object)
    second_block = spark.sparkContext.broadcast((a, np.searchsorted(ids, at), positive, np.clip(bounds, LONG.min + 1, LONG.max).astype(np.int64), high))
    near = rows.mapInArrow(_negatives(second_block, dim, k), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    first = F.row_number().over(Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    out = near.withColumn("rank", first).where(F.col("rank") <= k)
    kept = materialise(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    first_block.destroy()
    second_block.destroy()
    return kept
