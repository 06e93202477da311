"""Nearest neighbours by collision counting over query-centred hash windows.

Vectors are dealt into blocks.  In a block each random projection is one
sorted array; a query's window on every array is centred on its own
projection and grows by virtual rehashing, radius after radius.  A vector that
lies in enough windows is verified by its exact distance, and a query is done
at the radius that holds its k nearest verified vectors.

Vectors are shuffled once, each to its block; queries go to all blocks.  A
task reads a block's vectors, sorts their projections once and then lets the
queries stream past, so it holds one block and one batch of queries.  Blocks
answer on their own and their answers are merged: k rows a block and query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

PROJECTIONS = 32
#: Half a window's width in units of the radius, and the number of windows that makes a candidate.
HALF_WIDTH, COLLISIONS = 1.35, 20
GROWTH = 1.15
#: The first radius is this share of the distance to the nearest of some vectors of the block.
START, START_VECTORS = 0.6, 256
#: A block's vectors, as doubles, and the least number of them for which a core is worth a block of its own.
BLOCK_BYTES, LEAST_VECTORS = 32 << 20, 4096
#: Beyond this, and below its inverse, squares lose their digits and are taken of scaled numbers.
LARGE = 1e140


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` from ``q``; also of very large and very small numbers."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        d = x - q
        out = np.sqrt((d * d).sum(1))
        odd = np.flatnonzero(~((out < LARGE) & (out > 1 / LARGE)))
        if len(odd):
            most = np.maximum(np.abs(x[odd]).max(1), np.abs(q).max())
            d = x[odd] / most[:, None] - q / most[:, None]
            far = np.abs(d).max(1)
            out[odd] = np.where(far > 0, most * (far * np.sqrt(((d / np.where(far > 0, far, 1)[:, None]) ** 2).sum(1))), 0.0)
    return out


class Block:
    """Sorted projections of a block of vectors (rows of ``x``)."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, seed: int = 5) -> None:
        self.x, self.ids = x, ids
        draw = np.random.default_rng(seed)
        self.axes = draw.standard_normal((x.shape[1], PROJECTIONS))
        most = float(np.abs(x).max())
        self.scale = most if not 1 / LARGE < most < LARGE else 1.0
        at = ((x / self.scale) @ self.axes).T
        self.order = np.argsort(at, axis=1, kind="stable").astype(np.int32)
        self.at = np.take_along_axis(at, self.order, axis=1)
        self.some = x[draw.integers(0, len(ids), START_VECTORS)]

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, nearest first, ties to the smaller id."""
        n, centre = len(self.ids), np.clip(q / self.scale, -LARGE, LARGE) @ self.axes
        collisions, verified = np.zeros(n, np.int64), self.ids == own
        want = min(k, n - int(verified.sum()))
        found, gap = np.empty(0, np.int64), np.empty(0)
        low = np.array([np.searchsorted(a, c) for a, c in zip(self.at, centre)])
        high = low.copy()
        near = distances(self.some, q)
        radius = START * float(near[near > 0].min(initial=np.inf))
        while want:
            half = radius / self.scale * HALF_WIDTH
            wider = [(int(np.searchsorted(a, c - half, "left")), int(np.searchsorted(a, c + half, "right"))) for a, c in zip(self.at, centre)]
            fresh = [part for j, (lo, hi) in enumerate(wider) for part in (self.order[j, min(lo, low[j]) : low[j]], self.order[j, high[j] : max(hi, high[j])])]
            collisions += np.bincount(np.concatenate(fresh), minlength=n)
            low, high = np.minimum(low, [lo for lo, _ in wider]), np.maximum(high, [hi for _, hi in wider])
            new = np.flatnonzero((collisions >= COLLISIONS) & ~verified)
            if len(new):
                verified[new] = True
                found, gap = np.concatenate([found, new]), np.concatenate([gap, distances(self.x[new], q)])
            if len(gap) >= want and np.partition(gap, want - 1)[want - 1] <= radius or (low == 0).all() and (high == n).all():
                break
            radius *= GROWTH
        best = np.lexsort((self.ids[found], gap))[:k]
        return self.ids[found[best]], gap[best]


_FOUND = "query_id long, vec_id long, score double"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, np.ndarray, np.ndarray]]:
    """((dim, block), whether queries, ids, vectors) of sorted rows, a run of equal keys after another."""
    for batch in batches:
        dim, block, query, ids, vectors = (batch.column(i) for i in range(5))
        keys = np.stack([dim.to_numpy(), block.to_numpy(), query.to_numpy()])
        ends = [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1), len(ids)]
        ids, first = ids.to_numpy(), 0
        for end in ends if len(ids) else []:
            part = vectors.slice(first, end - first).flatten().to_numpy().reshape(end - first, -1)
            yield (int(keys[0, first]), int(keys[1, first])), bool(keys[2, first]), ids[first:end], part
            first = end


def _search(k: int):
    """Reads each block's vectors and then answers the queries that follow them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for key, query, ids, vectors in _runs(batches):
            if key != at:
                at, parts, block = key, [], None
            if not query:
                parts.append((ids, vectors))
                continue
            if block is None and parts:
                every = np.concatenate([i for i, _ in parts])
                order = np.argsort(every, kind="stable")
                block, parts = Block(np.concatenate([v for _, v in parts])[order], every[order]), []
            answers = [(own, *block.search(v, own, k)) for own, v in zip(ids, vectors)] if block is not None else []
            if answers:
                owners = np.repeat([own for own, _, _ in answers], [len(i) for _, i, _ in answers]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(owners), pa.array(np.concatenate([i for _, i, _ in answers])), pa.array(np.concatenate([g for _, _, g in answers]))], ["query_id", "vec_id", "score"])

    return run


def usable(vector: Column | str) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by
    ``every`` the ``k`` nearest other rows found, by Euclidean distance in double
    precision, ties to the smaller vec_id; all of them, if there are fewer.

    Every usable row is indexed.  Vectors that are null, zero, or hold null or
    non-finite components, and rows without a vec_id, take no part; vectors of
    different lengths are not compared.  Rows that repeat a query's vec_id are
    its own and no candidates, and what is near to any of its vectors is found;
    other repeated rows are candidates each.  Other columns are ignored; an empty
    table gives an empty result."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable("embedding"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialise(rows.withColumn("dim", F.size("embedding")), "vector")
    n, numbers = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("dim").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-8 * numbers // BLOCK_BYTES), min(spark.sparkContext.defaultParallelism, n // LEAST_VECTORS))
    # Dealt by place and content, so that neither equal vectors nor equal ids meet in one block.
    deal = F.pmod(F.xxhash64("vec_id", "embedding", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    left = rows.select("dim", deal.alias("block"), F.lit(0).alias("query"), "vec_id", "embedding")
    right = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "embedding"])
    right = right.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("query"), "vec_id", "embedding")
    dealt = left.union(right).repartition(2 * blocks, "dim", "block").sortWithinPartitions("dim", "block", "query")
    near = dealt.mapInArrow(_search(k), _FOUND)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
