"""Packing token sequences: a configuration linear program over the length histogram.

Documents become pieces of at most a sequence's capacity.  What matters of the
pieces is how many there are of each length, a table of at most ``capacity``
rows at any size of the input.  A configuration is a set of lengths that fits a
sequence; the linear program asks for the fewest configurations that hold all
lengths.  Multiplicative weights solve it: a length has a price that rises
while it lags behind the others and falls while it leads, and a knapsack over
the prices (dynamic programming by capacity) says which configurations to use
next.  Rounding takes whole copies of the configurations, most used first, and
fills what is left: the longest piece with the set of others that fills its
sequence best, as often as there are pieces for it.

The plan is as small as the histogram.  Each piece has a rank among those of
its length (its place in its task behind the tasks before), and the plan says
which ranks of a length go to which sequence and place, so no piece meets
another one in a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .tokens import slices, tokens

CAPACITY, END_ID = 4096, 1
#: Rounds of price changes, configurations added in each, and how fast prices follow the lag.
ROUNDS, PRICED, RATE = 100, 512, 4.0
#: Rounds that a length may be ahead of the others.
LEAD = 2

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, task int, nth long"


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, end, seen = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for first, last in slices(texts):
                ids, starts = tokens(path).encode(texts.slice(first, last - first))
                flat, rows, kept = memoryview(ids).cast("B"), [], []
                for d, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
                    n = b - a + 1
                    for piece, at in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - at)
                        own = flat[4 * (a + at) : 4 * min(a + at + size, b)]
                        whole = at + size < n
                        rows.append((first + d, piece, at, size, zlib.crc32(own) if whole else zlib.crc32(end, zlib.crc32(own))))
                        if with_ids:
                            kept.append(np.frombuffer(bytes(own) if whole else bytes(own) + end, "<i4"))
                doc, piece, start, length, crc = np.array(rows, np.int64).reshape(-1, 5).T
                # the rank of each piece among those of its length in this task
                order = np.argsort(length, kind="stable")
                lengths, begin, counts = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(begin - seen[lengths], counts)
                seen[lengths] += counts
                lists = pa.array(kept, pa.list_(pa.int32())) if with_ids else pa.nulls(len(length), pa.list_(pa.int32()))
                columns = [doc_ids.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), lists, pa.array(np.full(len(length), task, np.int32)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "nth"])
                pa.default_memory_pool().release_unused()

    return run


def knapsack(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity the most that lengths of it are worth, and the length to take
    next (0: leave a place free).  ``value[l]`` is that of a piece of length l."""
    capacity = len(value) - 1
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        worth = best[c - 1 :: -1] + value[1 : c + 1] if c > 1 else best[:1] + value[1:2]
        j = int(worth.argmax())
        best[c], take[c] = (worth[j], j + 1) if worth[j] > best[c - 1] else (best[c - 1], 0)
    return best, take


def _configuration(length: int, take: np.ndarray) -> dict[int, int]:
    """The best configuration that holds ``length``: counts by length."""
    config, left = {length: 1}, len(take) - 1 - length
    while left:
        if (t := int(take[left])) > 0:
            config[t] = config.get(t, 0) + 1
        left -= max(t, 1)
    return config


def linear_program(counts: np.ndarray) -> tuple[dict[tuple, float], float]:
    """(how often each configuration is used, a lower bound of the number of
    sequences) for ``counts[l]`` pieces of length l; no length is used more often
    than there are pieces of it.  A configuration is its sorted (length, count) pairs."""
    capacity = len(counts) - 1
    lengths = np.flatnonzero(counts)
    n, used, bound = counts.astype(float), {}, 0.0
    share = np.zeros(capacity + 1)
    for r in range(1, ROUNDS + 1):
        lag, most = r / ROUNDS - share, min(1.0, (r + LEAD) / ROUNDS)
        live = lengths[share[lengths] < 1]
        if not len(live):
            break
        value = np.full(capacity + 1, -np.inf)
        value[live] = live * np.exp(RATE * lag[live])
        best, take = knapsack(value)
        # prices that no sequence can exceed 1 in bound the number of sequences from below
        bound = max(bound, float((n[live] * value[live]).sum() / best[-1]))
        behind = live[lag[live] > 0]
        behind = behind[np.argsort(-(lag * n)[behind] * behind, kind="stable")[:PRICED]]
        for length in np.sort(behind)[::-1].tolist():
            want = (r / ROUNDS - share[length]) * n[length]
            if want <= 0:
                continue
            config = _configuration(length, take)
            x = min(want / config[length], *((most - share[c]) * n[c] / k for c, k in config.items()))
            if x > 0:
                key = tuple(sorted(config.items(), reverse=True))
                used[key] = used.get(key, 0.0) + x
                for c, k in config.items():
                    share[c] = min(most, share[c] + x * k / n[c])
    return used, bound


def _best_fill(counts: list[int], room: int) -> dict[int, int]:
    """Counts by length, at most ``counts``, that fill ``room`` best; of equal fills that with the longest pieces."""
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length in range(1, min(room, len(counts) - 1) + 1):
        if k := min(counts[length], room // length):
            before, part = reach, 1
            steps.append((length, k, before))
            while k:  # any number up to k as a sum of parts
                part = min(part, k)
                reach |= reach << (part * length) & full
                k, part = k - part, 2 * part
    target, fill = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        while k and target >= length and before >> (target - min(k, target // length) * length) & 1 == 0:
            # fewer of this length, until the shorter ones reach the rest
            k = min(k, target // length) - 1
        k = min(k, target // length)
        if k and before >> (target - k * length) & 1:
            fill[length] = k
            target -= k * length
    return fill


@dataclass
class Plan:
    """Which ranks of each length go where.  Entry i: pieces of ``length[i]`` from rank
    ``first[i]`` on; ``each[i]`` of them go to every sequence from ``sequence[i]`` on,
    from place ``offset[i]`` on."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    bound: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        most = int(max(self.first.max(initial=0), rank.max(initial=0))) + 1
        at = np.searchsorted(self.length * most + self.first, length * most + rank, "right") - 1
        i = rank - self.first[at]
        return self.sequence[at] + i // self.each[at], self.offset[at] + i % self.each[at] * length


def plan_sequences(counts: np.ndarray) -> Plan:
    """The plan for ``counts[l]`` pieces of length l (``counts[0]`` is 0)."""
    capacity = len(counts) - 1
    left, chosen, bound = counts.astype(np.int64).tolist(), [], 0.0
    if any(left):
        used, bound = linear_program(counts)
        for config, x in sorted(used.items(), key=lambda c: (-c[1], c[0])):
            copies = min(-int(-x // 1), *(left[c] // k for c, k in config))
            if copies:
                chosen.append((config, copies))
                for c, k in config:
                    left[c] -= copies * k
    for length in range(capacity, 0, -1):
        while left[length]:
            left[length] -= 1
            fill = _best_fill(left, capacity - length)
            left[length] += 1
            fill[length] = fill.get(length, 0) + 1
            copies = min(left[c] // k for c, k in fill.items())
            chosen.append((tuple(sorted(fill.items(), reverse=True)), copies))
            for c, k in fill.items():
                left[c] -= copies * k
    rows, ranks, sequence = [], [0] * (capacity + 1), 0
    for config, copies in chosen:
        offset = 0
        for c, k in config:
            rows.append((c, ranks[c], k, sequence, offset))
            ranks[c] += k * copies
            offset += c * k
        sequence += copies
    table = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    total = sum(c * int(n) for c, n in enumerate(counts.tolist()))
    return Plan(*table, sequences=sequence, bound=max(-(-total // capacity), int(np.ceil(bound - 1e-6))))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text), written: doc_id, piece (from 0), start
    (the document's ids before it), length, ids_crc32 (of its ids as little-endian
    unsigned 32-bit numbers), ids (null unless asked for), task and nth (its rank
    among the pieces of its length in its task)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), _PIECE), "pieces")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset): the tokens of
    all documents, ``end_id`` behind each, in few sequences of ``capacity`` tokens.

    Only documents that are longer than a sequence are cut, into full sequences
    and a rest.  ``tokenizer`` is a file of the tokenizers library, there on all
    machines.  A null text is empty, so it is the end id alone; rows are packed
    one by one, also where doc_id repeats or is null.  Other columns are ignored;
    no rows give no pieces.  Places in a sequence have no gaps."""
    parts = pieces(docs, tokenizer, capacity, end_id, with_ids)
    held = materialise(parts.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in held.groupBy("length").agg(F.sum("n")).collect():  # a row a length
        counts[length] = n
    plan = docs.sparkSession.sparkContext.broadcast(plan_sequences(counts))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.schema.names[:-1]
            sequence, offset = plan.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(sequence), pa.array(offset)], [*own, "sequence_id", "offset"])

    ranked = parts.join(starts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, documents): the token ids of each sequence of ``pack(..., with_ids=True)``
    in order, and which documents they are of ((doc_id, piece, offset, length) structs);
    a sequence is bounded by its capacity.  No rows give no sequences."""
    one = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(one.alias("_p"))
    return rows.select("sequence_id", F.flatten("_p.ids").alias("ids"), F.transform("_p", lambda p: F.struct(p.doc_id.alias("doc_id"), p.piece.alias("piece"), p.offset.alias("offset"), p.length.alias("length"))).alias("documents"))
