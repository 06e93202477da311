"""Tables out of recognised parts: orders with a tolerance, parts without doubles,
cells with their row, column, header and span, and the grid that they make.

Boxes meet parts by the coordinate buckets of geometry.overlapping().  What is a
walk over one table, whose later steps read what earlier ones moved, is a small
fold over that table's own rows; tables are dealt over the tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter, deque
from collections.abc import Callable, Iterator
from functools import cmp_to_key, lru_cache, reduce
from itertools import groupby, pairwise
from operator import and_, itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructType

from ..functions import text as t
from .geometry import SIDES, cell_type, overlap_area, overlapping, shapes

#: Labels of table parts by what they are, the tolerance of their first order, how much of a double is covered.
PART_LABELS = {"row": ("^.* (row|header)", 0.6), "header": ("^.*header$", 0.6), "span": ("^.*spanning", 0.6), "column": ("^table column$", 0.5)}
PART_TOLERANCE, LOOK_AHEAD, LEAST_OVERLAP = 10.0, 5, 0.3
#: Fixed value: what a caption of a table or figure starts with.
CAPTION = r"^[图表]+[ 0-9:：]{2,}"
#: Rows (columns) from which a column (row) of one cell is merged with a neighbour.
LEAST_LINES = 4


#: Pages or tables that are plain Python rows at once, and their bytes in Arrow.
FOLDED, FOLDED_BYTES = 256, 1 << 20


def plain(values: pa.Array) -> list:
    """``values`` as Python's, nested ones too: column by column, much faster than to_pylist()."""
    if pa.types.is_struct(values.type):
        names = [f.name for f in values.type]
        rows = [dict(zip(names, v)) for v in zip(*(plain(x) for x in values.flatten()))]
        return [r if known else None for r, known in zip(rows, values.is_valid().to_pylist())] if values.null_count else rows
    if pa.types.is_list(values.type):
        items, ends = plain(values.flatten()), np.cumsum(pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)).tolist()
        lists = [items[a:b] for a, b in zip([0, *ends], ends)]
        return [x if known else None for x, known in zip(lists, values.is_valid().to_pylist())] if values.null_count else lists
    fast = pa.types.is_string(values.type) or (values.null_count == 0 and (pa.types.is_floating(values.type) or pa.types.is_integer(values.type)))
    return values.to_numpy(zero_copy_only=False).tolist() if fast else values.to_pylist()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that they may be plain Python at once."""
    for batch in batches:
        step = max(1, min(FOLDED, batch.num_rows * FOLDED_BYTES // max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def folded(pages: DataFrame, fold: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``schema`` that ``fold`` makes of each row, which holds a page or a table as arrays."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            out = [x for row in plain(piece.to_struct_array()) for x in fold(row)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    return pages.mapInArrow(run, schema)


def _listed(rows: DataFrame, name: str, *columns: str | Column) -> DataFrame:
    """One row a page: an array ``name`` of its rows."""
    return rows.select("page", F.struct(*columns).alias("_row")).groupBy("page").agg(F.collect_list("_row").alias(name))


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` of few, large pages dealt over all tasks, however small their bytes are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page")


def tolerant(items: list[dict], first: str, then: str, within: float) -> list[dict]:
    """``items`` by ``first``, or by ``then`` where ``first`` differs by less than ``within``.

    Being near is not transitive, so the result also hangs on the order in which items
    come; sorting is stable."""
    return sorted(items, key=cmp_to_key(lambda a, b: a[then] - b[then] if abs(a[first] - b[first]) < within else a[first] - b[first]))


def settle(items: list[dict], number: str, then: str) -> list[dict]:
    """Each item in turn moves forward past every one before it that has a larger
    ``number``, or the same and a larger ``then``; those without a number neither
    move nor are passed.  So what stands between two of these is sorted."""
    out: list[dict] = []
    for numbered, run in groupby(items, key=lambda r: r[number] is not None):
        out += sorted(run, key=lambda r: (r[number], r[then])) if numbered else run
    return out


def scan_order(boxes: DataFrame, near: float = 10.0) -> DataFrame:
    """``boxes`` (page, box_id, x0, top, ...) with ``position`` on their page, from 1.

    They come by (top, x0, box_id); then each moves forward past those right of it
    whose top is nearer than ``near``, until one is not.  Null sides come first and
    pass nothing.  A page's boxes are one array; no boxes give no rows."""
    kinds = dict(boxes.dtypes)
    sides = [F.col(c).cast("double").alias(c) for c in ("top", "x0")]
    placed = folded(_listed(_dealt(boxes), "boxes", *sides, "box_id"), lambda page: [(page["page"], i, k) for k, i in enumerate(scanned(page["boxes"], near), 1)], f"page {kinds['page']}, box_id {kinds['box_id']}, position int")
    return boxes.join(placed, ["page", "box_id"])


def scanned(boxes: list[dict], near: float) -> list:
    """box_ids of ``boxes`` (top, x0, box_id) as scan_order() places them.

    Tops only grow, so behind the last box whose top is no longer near all stand from
    left to right: a box finds its place among those by halving, and what stands
    before the last far one is done."""
    done, tail, waiting, open_ = [], [], deque(), set()
    low = lambda v: (v is not None, v if v is not None else 0.0)

    def close(n: int) -> None:
        done.extend(i for _, _, i in tail[:n])
        open_.difference_update(k for _, k, _ in tail[:n])
        del tail[:n]

    for k, b in enumerate(sorted(boxes, key=lambda r: (low(r["top"]), low(r["x0"]), r["box_id"]))):
        top, x0 = b["top"], b["x0"]
        if top is None or x0 is None:
            close(len(tail))
            done.append(b["box_id"])
            continue
        while waiting and not abs(top - waiting[0][0]) < near:
            _, far, at = waiting.popleft()
            if far in open_:
                close(bisect_left(tail, (at, far)) + 1)
        insort(tail, (x0, k, b["box_id"]))
        open_.add(k)
        waiting.append((top, k, x0))
    close(len(tail))
    return done


def tolerant_order(boxes: DataFrame, within: float, first: str = "top", then: str = "x0", number: str | None = None, out: str = "position") -> DataFrame:
    """``boxes`` (page, box_id, ...) with ``out``, their place on the page from 1, as
    tolerant() orders them from box_id on, and settle() by ``number`` if it is given.

    Boxes without ``first`` or ``then`` come last, by box_id.  No boxes give no rows."""
    used = list(dict.fromkeys([first, then, *([number] if number else [])]))

    def order(page: dict) -> list[tuple]:
        items = sorted(page["boxes"], key=lambda r: r["box_id"])
        known = tolerant([r for r in items if r[first] is not None and r[then] is not None], first, then, within)
        known = settle(known, number, then if number != first else first) if number else known
        done = [*known, *(r for r in items if r[first] is None or r[then] is None)]
        return [(page["page"], r["box_id"], i) for i, r in enumerate(done, 1)]

    kinds = dict(boxes.dtypes)
    placed = folded(_listed(_dealt(boxes), "boxes", "box_id", *used), order, f"page {kinds['page']}, box_id {kinds['box_id']}, {out} int")
    return boxes.drop(out).join(placed, ["page", "box_id"])


def _area(a: dict, b: dict) -> float:
    """What two boxes share."""
    w, h = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]), min(a["bottom"], b["bottom"]) - max(a["top"], b["top"])
    return w * h if w > 0 and h > 0 else 0.0


def _touch(a: dict, b: dict) -> bool:
    # the next ones lie below, mostly
    return a["bottom"] >= b["top"] and b["bottom"] >= a["top"] and a["x1"] >= b["x0"] and b["x1"] >= a["x0"] and a["x1"] >= a["x0"] and b["x1"] >= b["x0"] and a["bottom"] >= a["top"] and b["bottom"] >= b["top"]


def without_doubles(parts: list[dict], shared: Callable[[dict], float], ahead: int, least: float) -> list[dict]:
    """``parts`` in their order, of doubles the better one.

    A part is compared with the first of the next ``ahead - 1`` that has its type and
    touches it.  If one covers ``least`` of the other, the one of lower score goes, the
    earlier of equals; where a score is missing or 0, the one that has less ``shared`` with boxes."""
    kept, i = list(parts), 0
    while i + 1 < len(kept):
        a = kept[i]
        j = None
        for k in range(i + 1, min(i + ahead, len(kept))):
            if _touch(a, kept[k]) and kept[k].get("type") == a.get("type"):
                j = k
                break
        own = lambda x: (x["x1"] - x["x0"]) * (x["bottom"] - x["top"]) or float("inf")
        if j is None or _area(a, kept[j]) / min(own(a), own(kept[j])) < least:
            i += 1
            continue
        b = kept[j]
        weight = (lambda x: x["score"]) if a.get("score") and b.get("score") else shared
        kept.pop(j if weight(a) > weight(b) else i)
    return kept


def clean_ahead(layouts: DataFrame, boxes: DataFrame, ahead: int = 2, least: float = 0.7) -> DataFrame:
    """``layouts`` (page, box_id, type, score, sides, ...) without doubles, as
    without_doubles() finds them by box_id against the page's ``boxes``.

    Rows with a null side stay as they are.  No layouts give no rows."""
    used = ["page", "box_id", "type", "score", *SIDES]
    whole = F.lit(True)
    for s in SIDES:
        whole = whole & F.col(s).isNotNull()

    def kept(page: dict) -> list[tuple]:
        done = without_doubles(sorted(page["parts"], key=lambda r: r["box_id"]), lambda r: r["_shared"], ahead, least)
        return [(page["page"], r["box_id"]) for r in done]

    # what a layout shares with boxes is a join, each shape once; the walk only compares it
    counted = boxes.where(whole).groupBy("page", *SIDES).agg(F.count("*").alias("n"))
    met = overlapping(shapes(layouts.where(whole)), counted).groupBy("page", *SIDES).agg(F.sum(overlap_area(ratio=False) * F.col("b_n")).alias("_shared"))
    weighed = layouts.where(whole).join(met, ["page", *SIDES], "left").withColumn("_shared", F.coalesce("_shared", F.lit(0.0)))
    kinds = dict(layouts.dtypes)
    clean = folded(_listed(_dealt(weighed), "parts", *used[1:], "_shared"), kept, f"page {kinds['page']}, box_id {kinds['box_id']}").withColumn("_kept", F.lit(True))
    joined = layouts.join(clean, ["page", "box_id"], "left")
    return joined.where(F.col("_kept") | ~whole).drop("_kept")


@lru_cache(maxsize=4096)
def _kinds(label: str) -> tuple[str, ...]:
    """What a part with this label is."""
    return tuple(kind for kind, (pattern, _) in PART_LABELS.items() if re.search(pattern, label))


def numbered(parts: list[dict], texts: list[dict]) -> list[tuple]:
    """(kind, number, *sides) of a table's ``parts``, as table_parts() tells."""
    mine: dict[str, list[dict]] = {kind: [] for kind in PART_LABELS}
    for r in sorted(parts, key=itemgetter("part_id")):
        for kind in _kinds(r["label"]):
            mine[kind].append(r)
    shared = lambda x: sum(_area(x, box) for box in texts)
    out = []
    for kind, items in mine.items():
        items = sorted(items, key=itemgetter("x0")) if kind == "column" else tolerant(items, "top", "x0", PART_TOLERANCE)
        items = without_doubles(items, shared, LOOK_AHEAD, PART_LABELS[kind][1])
        items = items if kind == "column" else sorted(items, key=itemgetter("top"))
        out += [(kind, i, *(r[s] for s in SIDES)) for i, r in enumerate(items)]
    return out


def _doubles(*more: str | Column) -> list[str | Column]:
    return [*more, *(F.col(s).cast("double").alias(s) for s in SIDES)]


def _listed_parts(parts: DataFrame) -> DataFrame:
    return _listed(parts.dropna(subset=["label", *SIDES]), "parts", *_doubles("part_id", "label", F.col("score").cast("double").alias("score")))


def table_parts(parts: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page, kind, number, x0, x1, top, bottom): rows (with headers), headers, spans and
    columns of each table among its ``parts`` (page, part_id, label, score, sides),
    without doubles, numbered from 0: columns from left to right, others downwards.

    ``page`` is the table's key.  A part may be a row and a header.  Parts with a null
    side or label take no part; a table without parts gives no rows."""
    # texts decide between doubles without a score only
    unscored = parts.where("coalesce(score, 0) = 0").select("page").distinct()
    tables_ = _listed_parts(parts).join(_listed(boxes.dropna(subset=list(SIDES)).join(unscored, "page", "left_semi"), "boxes", *_doubles()), "page", "left")
    sides = ", ".join(f"{s} double" for s in SIDES)
    return folded(tables_, lambda t: [(t["page"], *r) for r in numbered(t["parts"], t["boxes"] or [])], f"page {dict(parts.dtypes)['page']}, kind string, number int, {sides}")


#: Pairs of boxes and parts that are looked at at once.
PAIRS = 1 << 19
KINDS = {kind: i for i, kind in enumerate(PART_LABELS)}


def meet(boxes: dict[str, np.ndarray], of: np.ndarray, parts: dict[str, np.ndarray], counts: np.ndarray) -> dict[str, np.ndarray]:
    """For each kind of part the place among ``parts`` of the one that each of the ``boxes``
    lies in, or -1: of columns the nearest, else the one that covers most, 0.3 at least.

    Both are sides by name, parts also kind (as KINDS has it) and number, table by table;
    box i is of table ``of[i]``, which has ``counts[of[i]]`` parts.  An unknown side is NaN."""
    starts, n = np.cumsum(counts) - counts, counts[of]
    ends, found, i = np.cumsum(n), {kind: np.full(len(of), -1) for kind in PART_LABELS}, 0
    area = lambda r: (r["x1"] - r["x0"]) * (r["bottom"] - r["top"])
    real = lambda r: (r["x0"] < r["x1"]) & (r["top"] < r["bottom"])
    own, others, real_box, real_part = area(boxes), area(parts), real(boxes), real(parts)
    while i < len(of):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        m = n[i:j]
        b = np.repeat(np.arange(i, j), m)
        p = np.arange(len(b)) - np.repeat(np.cumsum(m) - m - starts[of[i:j]], m)
        is_column = parts["kind"][p] == KINDS["column"]
        cb, cp = b[is_column], p[is_column]
        middle = (boxes["x0"][cb] + boxes["x1"][cb] - parts["x1"][cp] - parts["x0"][cp]) / 2
        gap = np.fmin(np.fmin(np.abs(boxes["x0"][cb] - parts["x0"][cp]), np.abs(boxes["x1"][cb] - parts["x1"][cp])), np.abs(middle))
        # the last of a box stays; one that knows no gap takes the first column
        order = np.lexsort((parts["number"][cp], np.where(np.isnan(gap), -1.0, gap), cb))[::-1]
        found["column"][cb[order]] = cp[order]
        kept = ~is_column & real_box[b] & real_part[p]
        b, p = b[kept], p[kept]
        side = lambda s, pick: pick(boxes[s][b], parts[s][p])  # noqa: E731, B023
        shared = np.maximum(side("x1", np.minimum) - side("x0", np.maximum), 0.0) * np.maximum(side("bottom", np.minimum) - side("top", np.maximum), 0.0)
        covered = shared >= LEAST_OVERLAP * own[b] * 0.99
        b, p, shared = b[covered], p[covered], shared[covered]
        share = shared / own[b]
        order = np.lexsort((parts["number"][p], shared / others[p], share, b))
        order = order[share[order] >= LEAST_OVERLAP]
        for kind in ("row", "header", "span"):
            mine = order[parts["kind"][p[order]] == KINDS[kind]]
            found[kind][b[mine]] = p[mine]
        i = j
    return found


class Places:
    """What the boxes of some tables lie in.  ``piece`` has the page, boxes and parts of each;
    ``number`` gives (kind, number, *sides) of a table's parts, which the texts decide
    where a score is missing."""

    def __init__(self, piece: pa.RecordBatch, number: Callable[[list[dict], list[dict]], list[tuple]]) -> None:
        lists, parts = piece.column("boxes"), [p or [] for p in plain(piece.column("parts"))]
        self.flat = lists.flatten()
        self.of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        sides = dict(zip((f.name for f in self.flat.type), self.flat.flatten()))
        boxes = {s: sides[s].cast(pa.float64()).to_numpy(zero_copy_only=False) for s in SIDES}
        texts: list[list[dict]] = [[] for _ in parts]
        if not all(r.get("score", True) for p in parts for r in p):
            for t_, *box in zip(self.of.tolist(), *(boxes[s].tolist() for s in SIDES)):
                if not any(x != x for x in box):
                    texts[t_].append(dict(zip(SIDES, box)))
        own = [number(p, x) for p, x in zip(parts, texts)]
        self.parts = [r for rows in own for r in rows]
        kinds, numbers, *around = zip(*self.parts) if self.parts else [()] * (2 + len(SIDES))
        arrays = {"kind": np.array([KINDS.get(k, -1) for k in kinds], int), "number": np.array(numbers, int)} | {s: np.array(x, float) for s, x in zip(SIDES, around)}
        self.found = meet(boxes, self.of, arrays, np.array([len(rows) for rows in own]))


def _with_parts(boxes: DataFrame, parts: DataFrame, *columns: str | Column) -> DataFrame:
    """One row a table: its boxes and its ``parts``, an array.  All of a table meets by its key alone."""
    # what comes out of arrays is more than a plan can tell, so neither side is sent whole to every task
    return _listed(boxes, "boxes", *columns).join(parts.hint("merge"), "page", "left")


def _placed(boxes: DataFrame, parts: DataFrame, number: Callable[[list[dict], list[dict]], list[tuple]]) -> DataFrame:
    rest = [f for f in boxes.schema if f.name != "page"]
    sides = StructType.fromDDL(", ".join(f"{s} double" for s in SIDES))
    added = [(k, IntegerType()) for k in PART_LABELS] + [(f"{k}_sides", sides) for k in PART_LABELS]
    schema = StructType([boxes.schema["page"], *rest])
    for name, kind in added:
        schema = schema.add(name, kind)
    kinds = to_arrow_schema(schema)
    kinds_of_sides = pa.struct([(s, pa.float64()) for s in SIDES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            at = Places(piece, number)
            numbers = pa.array([r[1] for r in at.parts], pa.int32())
            around = pa.array([dict(zip(SIDES, r[2:])) for r in at.parts], kinds_of_sides)
            index = {k: pa.array(x, mask=x < 0) for k, x in at.found.items()}
            sides_of = index | {"header": pc.coalesce(index["span"], index["header"])}
            boxes_ = dict(zip((f.name for f in at.flat.type), at.flat.flatten())) | {"page": piece.column("page").take(pa.array(at.of))}
            out = boxes_ | {k: numbers.take(x) for k, x in index.items()} | {f"{k}_sides": around.take(x) for k, x in sides_of.items()}
            yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in kinds], schema=kinds)

    placed = _with_parts(boxes, parts, *(f.name for f in rest)).mapInArrow(run, schema)
    return placed.select(*boxes.columns, *(name for name, _ in added))


def placed_cells(boxes: DataFrame, parts: DataFrame) -> DataFrame:
    """``boxes`` (page, box_id, sides, text, ...) with what they lie in among table_parts():
    row, header, span (the part that covers most, 0.3 at least) and column (the
    nearest), their numbers and sides; null where there is none.  Sides of a span
    stand in for those of a header."""
    return _placed(boxes, _listed(parts, "parts", *_doubles("kind", "number")), lambda own, _: [tuple(r.values()) for r in own])


def recognised_cells(boxes: DataFrame, parts: DataFrame) -> DataFrame:
    """placed_cells() among the table_parts() of ``parts``, in one step."""
    return _placed(boxes, _listed_parts(parts), numbered)


def _mean(values: list[float]) -> float:
    return sum(values) / len(values)


def _ordered(boxes: list[dict], first: str, then: str, within: float, number: str) -> list[dict]:
    """tolerant(), then settle() by ``number``, which alone decides if all have one and no two are equal."""
    keys = [(b[number], b[then]) for b in boxes]
    if all(n is not None for n, _ in keys) and len(set(keys)) == len(keys):
        return [b for _, b in sorted(zip(keys, boxes), key=itemgetter(0))]
    return settle(tolerant(boxes, first, then, within), number, then)


class Grid:
    """A table in the making: lines of cells, each a list of boxes."""

    def __init__(self, boxes: list[dict]) -> None:
        self.seen = boxes
        height = min((b["row_sides"]["bottom"] - b["row_sides"]["top"] for b in boxes if b["row"] is not None), default=0)
        width = min((b["column_sides"]["x1"] - b["column_sides"]["x0"] for b in boxes if b["column"] is not None), default=0)
        boxes = _ordered(boxes, "top", "x0", height / 2, "row")
        self.rows = self._lines(boxes, "row", "top", "bottom", 3)
        boxes = _ordered(boxes, "x0", "top", width / 2, "column")
        self.columns = self._lines(boxes, "column", "x0", "x1", 0)
        row_of = {id(b): i for i, line in enumerate(self.rows) for b in line}
        self.cells = [[[] for _ in self.columns] for _ in self.rows]
        for j, line in enumerate(self.columns):
            for b in line:
                self.cells[row_of[id(b)]][j].append(b)

    @staticmethod
    def _lines(boxes: list[dict], number: str, near: str, far: str, slack: float) -> list[list[dict]]:
        """Runs of boxes: a row ends where the number changes, a column where it goes on by
        one; boxes without one, and columns at other steps, end where they clear the line."""
        lines, edge = [[boxes[0]]], boxes[0][far]
        for a, b in pairwise(boxes):
            new = b[near] >= edge - slack and (a[number] is None or a[number] != b[number])
            if number == "row":
                new = new or a[number] != b[number]
            else:
                known = [1 if x[number] is None else x[number] for x in (a, b)]
                new = new or known[1] - known[0] == 1
            if new:
                lines.append([b])
                edge = b[far]
            else:
                lines[-1].append(b)
                edge = (edge + b[far]) / 2
        return lines

    def _filled(self, i: int, j: int) -> bool:
        cells = self.cells
        return 0 <= i < len(cells) and 0 <= j < len(cells[0]) and bool(cells[i][j]) and bool(cells[i][j][0]["text"])

    def merge_lone_columns(self) -> None:
        """A column of one cell joins a neighbour in whose cell there is no text, the nearer
        of two; if both have text, or the table ends there, it stays."""
        j = 0
        while j < len(self.columns):
            used = [i for i, row in enumerate(self.cells) if row[j]]
            i = used[-1] if used else 0
            left = j > 0 and not self._filled(i, j - 1)
            right = j + 1 < len(self.columns) and not self._filled(i, j + 1)
            if len(used) > 1 or not used or not (left or right):
                j += 1
                continue
            box, gaps = self.cells[i][j][0], {}
            if left:
                gaps[j - 1] = min((box["x0"] - a["x1"] for row in self.cells for a in row[j - 1]), default=float("inf"))
            if right:
                gaps[j + 1] = min((a["x0"] - box["x1"] for row in self.cells for a in row[j + 1]), default=float("inf"))
            to = j - 1 if left and gaps[j - 1] < gaps.get(j + 1, float("inf")) else j + 1 if right else j - 1
            self.cells[i][to].extend(self.cells[i][j])
            for row in self.cells:
                row.pop(j)
            self.columns.pop(j)

    def merge_lone_rows(self) -> None:
        """The same for rows of one cell."""
        i = 0
        while i < len(self.rows):
            used = [j for j, cell in enumerate(self.cells[i]) if cell]
            j = used[-1] if used else 0
            up = i > 0 and not self._filled(i - 1, j)
            down = i + 1 < len(self.rows) and not self._filled(i + 1, j)
            if len(used) > 1 or not used or not (up or down):
                i += 1
                continue
            box, gaps = self.cells[i][j][0], {}
            if up:
                gaps[i - 1] = min((box["top"] - a["bottom"] for cell in self.cells[i - 1] for a in cell), default=float("inf"))
            if down:
                gaps[i + 1] = min((a["top"] - box["bottom"] for cell in self.cells[i + 1] for a in cell), default=float("inf"))
            to = i - 1 if up and gaps[i - 1] < gaps.get(i + 1, float("inf")) else i + 1 if down else i - 1
            self.cells[to][j].extend(self.cells[i][j])
            self.cells.pop(i)
            self.rows.pop(i)

    def headers(self) -> set[int]:
        """Rows of which more than half the cells lie in a header, or are no numbers in a table of numbers."""
        found = set()
        numbers = Counter(b["cell_type"] for b in self.seen).most_common(1)[0][0] == "Nu"
        for i, row in enumerate(self.cells):
            cells = [c for c in row if c]
            heads = [any(b["header"] for b in c) or numbers for c in cells if not (numbers and c[0]["cell_type"] == "Nu")]
            if cells and sum(heads) / len(cells) > 0.5:
                found.add(i)
        return found

    def spans(self) -> dict[tuple[int, int], tuple[int, int, int, int]]:
        """(first row, last row, first column, last column) of the cells whose boxes lie in a
        spanning part: lines whose middle lies between its sides belong to it."""
        if all(b["span"] is None for b in self.seen):
            return {}
        side = lambda b, part, s: b[f"{part}_sides"][s] if b[part] is not None else b[s]
        across = [(_mean([side(b, "column", "x0") for b in line]), _mean([side(b, "column", "x1") for b in line])) for line in self.columns]
        down = [(_mean([side(b, "row", "top") for b in line]), _mean([b["bottom"] for b in line])) for line in self.rows]
        out = {}
        for i, row in enumerate(self.cells):
            for j, cell in enumerate(row):
                rows, columns = set(), set()
                for b in cell:
                    if b["span"] is not None:
                        s = b["header_sides"]
                        rows |= {i} | {k for k, (a, z) in enumerate(down) if (a + z) / 2 >= s["top"] and (a + z) / 2 <= s["bottom"]}
                        columns |= {j} | {k for k, (a, z) in enumerate(across) if (a + z) / 2 >= s["x0"] and (a + z) / 2 <= s["x1"]}
                if len(rows) > 1 or len(columns) > 1:
                    out[i, j] = (min(rows), max(rows), min(columns), max(columns))
        return out

    def fill_spans(self) -> dict[tuple[int, int], tuple[int, int]]:
        """All cells of a span get the boxes of all of them; (rows, columns) of each span by its first cell."""
        sizes, done = {}, set()
        for (i, j), (r0, r1, c0, c1) in self.spans().items():
            places = [(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)]
            if (i, j) in done:
                continue
            whole: list[dict] = []
            for r, c in places:
                text = "".join(b["text"] for b in self.cells[r][c])
                if text and text != "".join(b["text"] for b in whole):
                    whole.extend(self.cells[r][c])
                self.cells[r][c] = whole
            done.update(places)
            sizes[r0, c0] = (r1 - r0 + 1, c1 - c0 + 1)
        return sizes


def is_caption(text: Column, layout_type: Column) -> Column:
    return t.strip(text).rlike(CAPTION) | F.coalesce(F.contains(layout_type, F.lit("caption")), F.lit(False))


def _built(boxes: list[dict]) -> list[tuple]:
    """(row_no, col_no, text, is_header, row_span, col_span) of the grid that a table's boxes make."""
    if not boxes:
        return []
    items = sorted(boxes, key=itemgetter("box_id"))
    items = tolerant(items, "top", "x0", _mean([r["bottom"] - r["top"] for r in items]) / 3)
    items = [r for r in items if r["x0"] <= r["x1"] and r["top"] <= r["bottom"]]
    if not items:
        return []
    grid = Grid(items)
    if len(grid.rows) >= LEAST_LINES:
        grid.merge_lone_columns()
    if len(grid.columns) >= LEAST_LINES:
        grid.merge_lone_rows()
    heads, spans = grid.headers(), grid.fill_spans()
    return [(i, j, " ".join([b["text"] for b in cell]), i in heads, *spans.get((i, j), (1, 1))) for i, row in enumerate(grid.cells) for j, cell in enumerate(row)]


GRID = "row_no int, col_no int, text string, is_header boolean, row_span int, col_span int"


def built_tables(cells: DataFrame) -> DataFrame:
    """(page, row_no, col_no, text, is_header, row_span, col_span): the grid of each table
    from placed_cells(), rows and columns from 0.

    Rows and columns follow the numbers of the parts, or the boxes' sides where there
    are none.  From four rows on a lone cell of a column moves to the neighbour, from
    four columns on that of a row.  A span's text stands in all its places, its size
    (else 1) at the first one.  Boxes with null sides or text take no part; a table
    without boxes gives no rows."""
    columns = [
        *_doubles("box_id", "text"), cell_type(F.col("text")).alias("cell_type"), *(F.col(k).cast("int").alias(k) for k in ("row", "column", "span")),
        # the first header part counts as none
        (F.coalesce(F.col("header"), F.lit(0)) > 0).alias("header"), *(f"{k}_sides" for k in ("row", "column", "header")),
    ]
    used = _listed(cells.dropna(subset=[*SIDES, "text"]), "boxes", *columns)
    return folded(used, lambda t: [(t["page"], *cell) for cell in _built(t["boxes"])], f"page {dict(cells.dtypes)['page']}, {GRID}")


def _from_parts(boxes: DataFrame, parts: DataFrame, caption: Column, make: Callable[[list[tuple], list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Rows of page and ``schema`` that ``make`` gives of each table's grid and captions:
    parts, places and grid in one step, so that a table is sent once."""
    kinds = to_arrow_schema(StructType.fromDDL(f"page {dict(boxes.dtypes)['page']}, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            at = Places(piece, numbered)
            # an index of -1 is the None at the end
            numbers, around = [*(r[1] for r in at.parts), None], [*(dict(zip(SIDES, r[2:])) for r in at.parts), None]
            tables_: list[tuple[list, list]] = [([], []) for _ in range(piece.num_rows)]
            for t_, r, row, header, span, column in zip(at.of.tolist(), plain(at.flat), *(at.found[k].tolist() for k in PART_LABELS)):
                body, heads = tables_[t_]
                if r["caption"]:
                    heads.append(r)
                elif r["known"]:
                    r.update(row=numbers[row], column=numbers[column], span=numbers[span], header=(numbers[header] or 0) > 0, row_sides=around[row], column_sides=around[column], header_sides=around[span] or around[header])
                    body.append(r)
            out = [(page, *x) for page, (body, heads) in zip(piece.column("page").to_pylist(), tables_) for x in make(_built(body), heads)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    known = reduce(and_, (F.col(c).isNotNull() for c in (*SIDES, "text")))
    columns = _doubles("box_id", "text", cell_type(F.col("text")).alias("cell_type"), F.coalesce(caption, F.lit(False)).alias("caption"), known.alias("known"))
    return _with_parts(boxes, _listed_parts(parts), *columns).mapInArrow(run, f"page {dict(boxes.dtypes)['page']}, {schema}")


def recognised_tables(boxes: DataFrame, parts: DataFrame) -> DataFrame:
    """built_tables() of recognised_cells(), in one step."""
    return _from_parts(boxes, parts, F.lit(False), lambda grid, _: grid, GRID)


def grid_markdown(grid: list[tuple], captions: list[dict]) -> list[tuple]:
    """A table's markdown: a rule under the first row, the captions' texts in a row, in bold, above."""
    if not grid:
        return []
    lines = []
    for row_no, cells in groupby(grid, key=itemgetter(0)):
        texts = [c[2] for c in cells]
        lines.append(f"| {' | '.join(texts)} |\n")
        if row_no == 0:
            lines.append(f"| {' | '.join(['---'] * len(texts))} |\n")
    low = lambda v: (v is not None, v if v is not None else 0)
    caption = "".join(r["text"] for r in sorted(captions, key=lambda r: (low(r["box_id"]), r["text"] or "")) if r["text"] is not None)
    return [((f"**{caption}**\n\n" if caption else "") + "".join(lines),)]


def tables_as_markdown(boxes: DataFrame, parts: DataFrame) -> DataFrame:
    """(page, markdown): each table from its recognised texts ``boxes`` (page, box_id, sides,
    text, layout_type) and ``parts`` (page, part_id, label, score, sides)."""
    return _from_parts(boxes, parts, is_caption(F.col("text"), F.col("layout_type")), grid_markdown, "markdown string")
