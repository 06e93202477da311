"""Quality classifier: naive Bayes support vectors over hashed n-grams.

Indicators of byte 2-grams (exact), byte 3-grams and words (hashed), and of the
share of word 2-grams that repeat one word, are scaled
by the log-count ratio of the two classes, and dual coordinate descent fits a
linear hinge-loss model on them; a logistic curve over margins of rows that
neither the ratios nor the fit saw gives the score.  The fit is on a bounded
number of labelled rows, half of them of each class, chosen by hash:
``max_count_rows`` for the class counts, ``max_fit_rows`` of them, with
``max_fit_bytes`` of text, for the linear model and the curve.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 18
#: Shares of word 2-grams "w w" from which an indicator is set.
REPEATS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
FEATURES = (1 << 16) + (1 << BITS) + len(REPEATS)


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a whole text; none for a null or empty one."""
    if not text:
        return np.empty(0, np.int32)
    raw = np.frombuffer(f" {text} ".encode(), np.uint8).astype(np.uint32)
    pair = raw[:-1] << np.uint32(8) | raw[1:]
    triple = pair[:-1] << np.uint32(8) | raw[2:]
    shift = np.uint32(32 - BITS)
    # A word's number: sum of its bytes' powers between two spaces, from one running sum.
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    ends = np.flatnonzero(space)
    terms = (raw + np.uint32(1)) * np.uint32(2654435761) ^ (np.arange(len(raw), dtype=np.uint32) - ends[np.cumsum(space) - 1].astype(np.uint32)) * np.uint32(40503)
    total = np.concatenate([np.zeros(1, np.uint32), np.cumsum((terms ^ terms >> np.uint32(15)) * np.uint32(2246822519), dtype=np.uint32)])
    word = (total[ends[1:]] - total[ends[:-1] + 1])[np.diff(ends) > 1]
    hashed = np.concatenate([triple * np.uint32(2654435761), (word ^ np.uint32(0x5BD1E995)) * np.uint32(3266489917)]) >> shift
    repeat = (word[1:] == word[:-1]).mean() if len(word) > 1 else 0.0
    shares = np.arange(sum(repeat >= r for r in REPEATS), dtype=np.uint32) + np.uint32(FEATURES - len(REPEATS))
    return np.unique(np.concatenate([pair, hashed + np.uint32(1 << 16), shares])).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Weights (a float for each feature, 1.3 MB whatever the corpus) and the curve."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, at: np.ndarray) -> float:
        margin = (float(self.weights[at].sum()) / len(at) ** 0.5 if len(at) else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def dual_coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """w times ratio, and the bias, that minimise |w|^2/2 + sum cost * max(0, 1 - y (w x + b)).

    x is a row's log-count ratios over the root of their number, with a
    constant 1 for the bias; each step solves one row's dual variable."""
    # v is w times ratio, so that a row's margin is a sum of v; only v is kept.
    v, b, squares = np.zeros(FEATURES), 0.0, ratio * ratio
    root = np.array([max(1, len(r)) ** 0.5 for r in rows])
    alpha, norm = np.zeros(len(rows)), np.array([squares[r].sum() / n**2 + 1 for r, n in zip(rows, root)])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            slope = y[i] * (v[rows[i]].sum() / root[i] + b) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                v[rows[i]] += step / root[i] * squares[rows[i]]
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return v, b


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps on smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    at = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (p - target))
        at -= step
        if abs(step).max() < 1e-7:
            break
    return float(at[0]), float(at[1])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's rows of each class that hold a feature; feature -1 counts rows."""
    seen = np.zeros((2, FEATURES), np.int64)
    rows = [0, 0]
    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
            seen[y, features(text.as_py())] += 1
            rows[y] += 1
    at = np.flatnonzero(seen.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[0, at], rows[0])), pa.array(np.append(seen[1, at], rows[1]))], ["f", "n0", "n1"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([features(t.as_py()).tobytes() for t in batch.column(0)], pa.binary())
        yield pa.RecordBatch.from_arrays([found, batch.column(1), batch.column(2)], ["at", "y", "k"])


def _held(k: str = "k") -> Callable:
    """A quarter of the fit's rows, by hash, on which only the curve is fitted."""
    return F.pmod(F.shiftright(k, 8), F.lit(4)) == 3


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 4000, max_count_rows: int = 20_000, max_fit_bytes: int = 64 << 20, rounds: int = 12, cost: float = 2.0) -> Model:
    """Fit on ``docs`` (doc_id, text) that ``labels`` (doc_id, label 0 or 1) marks.

    Rows with a null doc_id, or a label that is neither 0 nor 1, teach nothing;
    of several labels for one doc_id the smallest holds.  Half of each bound is
    for either class, so a rare one is there in full strength; the score is set
    back to the classes' shares of all labels.  Without any text of one of the
    classes every text scores the classes' smoothed share.  The ids that are
    picked are bounded, so they are broadcast and no text is shuffled; what
    reaches the driver is the feature numbers of at most ``max_fit_rows`` rows
    with ``max_fit_bytes`` of text (and a text more a class), besides one pair of
    counts a feature."""
    marked = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("y"))
    keyed = marked.select("doc_id", "y", F.xxhash64("doc_id", F.lit(7)).alias("k"))
    totals = {r.y: r.n for r in keyed.groupBy("y").agg(F.count("*").alias("n")).collect()}
    texts = docs.where("doc_id is not null").select("doc_id", "text")

    def first(rows: int) -> DataFrame:
        """The first rows of each class, by hash."""
        each = [keyed.where(F.col("y") == y).orderBy("k", "doc_id").limit(rows // 2) for y in (0, 1)]
        return each[0].union(each[1])

    chosen, size = first(max_fit_rows), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    # Windows over max_fit_rows rows: the bounds also hold where rows repeat a doc_id, or texts are very long.
    by_class = Window.partitionBy("y").orderBy("k", "size")
    sized = texts.select("doc_id", size).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y", "k").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    fitted = sized.withColumns({"before": F.sum("size").over(by_class) - F.col("size"), "row": F.sum("n").over(by_class)})
    fitted = fitted.where((F.col("before") < max_fit_bytes // 2) & ((F.col("row") <= max_fit_rows // 2) | (F.col("before") == 0))).select("doc_id", "y", "k")
    counted = first(max_count_rows).join(F.broadcast(fitted.where(_held()).select("doc_id")), "doc_id", "left_anti")
    count = texts.join(F.broadcast(counted), "doc_id").select("text", "y").mapInArrow(_counts, "f int, n0 long, n1 long")
    f, *n = (c.to_numpy() for c in count.groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow().columns)
    rows = np.array([c[f == -1].sum() for c in n])
    sample = texts.join(F.broadcast(fitted), "doc_id").select("text", "y", "k").mapInArrow(_features, "at binary, y int, k long").toArrow().sort_by([("k", "ascending"), ("at", "ascending")])
    at, y = [np.frombuffer(a.as_py(), np.int32) for a in sample["at"]], np.where(sample["y"].to_numpy() == 1, 1.0, -1.0)
    held = (sample["k"].to_numpy() >> 8) % 4 == 3
    if not rows.all() or len(set(y[~held])) < 2:
        share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
        return Model(np.zeros(FEATURES, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    p = np.ones((2, FEATURES))
    p[:, f[f >= 0]] += [c[f >= 0] for c in n]
    ratio = np.log(p[1] / p[1].sum()) - np.log(p[0] / p[0].sum())

    weights, b = dual_coordinate_descent([a for a, h in zip(at, held) if not h], ratio, y[~held], np.full((~held).sum(), cost), rounds)
    margin = np.array([weights[a].sum() / max(1, len(a)) ** 0.5 + b for a in at])
    # with too few unseen rows of a class the curve has to make do with the seen ones
    on = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
    slope, offset = platt(margin[on], y[on])
    # The curve is set back to the classes' shares of all labels through its offset.
    drawn = (y[on] > 0).sum() / (y[on] <= 0).sum()
    return Model(weights.astype(np.float32), b, slope, offset + float(np.log(totals[1] / totals[0] / drawn)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a ``quality_score`` column (0 to 1) from each whole text.

    Null and empty texts score like a text without features.  A narrow map:
    no shuffle.  Columns keep their names; one named quality_score is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for part in texts:
            yield pd.Series([m.score(features(t)) for t in part], dtype="float64")

    return docs.withColumn("quality_score", of("text"))


def is_held_out(doc_id: str = "doc_id", folds: int = 5) -> Callable:
    """Rows whose crc32 of the id as text leaves no remainder; null ids do not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))
