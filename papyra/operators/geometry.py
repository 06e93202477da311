"""Boxes of recognised pages: overlaps, layout tags, suppression, tables.

A box is (page, box_id, x0, x1, top, bottom, ...).  Boxes that overlap meet in the
buckets of a page's coordinates that both cover, so the work grows with a page's
boxes and what they share, not with the square of the page.  Boxes of one page with the
same four sides meet once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .lines import ordered_text

# Cell types by pattern, first match wins.
CELL_TYPES = [
    ("^(20|19)[0-9]{2}[年/-][0-9]{1,2}[月/-][0-9]{1,2}日*$", "Dt"), (r"^(20|19)[0-9]{2}年$", "Dt"), (r"^(20|19)[0-9]{2}[年-][0-9]{1,2}月*$", "Dt"), ("^[0-9]{1,2}[月-][0-9]{1,2}日*$", "Dt"),
    (r"^第*[一二三四1-4]季度$", "Dt"), (r"^(20|19)[0-9]{2}年*[一二三四1-4]季度$", "Dt"), (r"^(20|19)[0-9]{2}[ABCDE]$", "Dt"), ("^[0-9.,+%/ -]+$", "Nu"), (r"^[0-9A-Z/\._~-]+$", "Ca"),
    (r"^[A-Z]*[a-z' -]+$", "En"), (r"^[0-9.,+-]+[0-9A-Za-z/$￥%<>（）()' -]+$", "NE"), (r"^.{1}$", "Sg"),
]
#: Fixed value: layout kinds in the order in which they claim a box.
LAYOUT_PRIORITY = ["footer", "header", "reference", "figure caption", "table caption", "title", "table", "text", "figure", "equation"]
GARBAGE_LAYOUTS = ["footer", "header", "reference"]
SIDES = ("x0", "x1", "top", "bottom")


def overlap_area(a: str = "", b: str = "b_", ratio: bool = True) -> Column:
    """Area that boxes with column prefixes ``a`` and ``b`` share, as a share of ``a``'s with ``ratio``."""
    c = {k: (F.col(f"{a}{k}"), F.col(f"{b}{k}")) for k in SIDES}
    width = F.least(*c["x1"]) - F.greatest(*c["x0"])
    height = F.least(*c["bottom"]) - F.greatest(*c["top"])
    own = (c["x1"][0] - c["x0"][0]) * (c["bottom"][0] - c["top"][0])
    shared = F.when((width < 0) | (height < 0) | (own == 0), 0.0).otherwise(width * height)
    return F.when(shared > 0, shared / own).otherwise(0.0) if ratio else shared


def _other(boxes: DataFrame, prefix: str = "b_") -> DataFrame:
    return boxes.select("page", *(F.col(c).alias(f"{prefix}{c}") for c in boxes.columns if c != "page"))


#: Side of a bucket; a page-sized region covers some hundred of them.
BUCKET = 64.0


def overlapping(boxes: DataFrame, regions: DataFrame, size: float = BUCKET) -> DataFrame:
    """``boxes`` with the columns of each of the ``regions`` (prefix b_) of their page that
    they share an area with, a pair once.

    Either side is dealt into the buckets that it covers; a pair counts in the bucket
    that holds the first corner of what it shares.  Boxes without an area or with a
    null side share none."""

    def bucketed(rows: DataFrame, prefix: str) -> DataFrame:
        span = lambda low, high: F.sequence(F.floor(F.col(f"{prefix}{low}") / size), F.floor(F.col(f"{prefix}{high}") / size))
        real = rows.where((F.col(f"{prefix}x0") < F.col(f"{prefix}x1")) & (F.col(f"{prefix}top") < F.col(f"{prefix}bottom")))
        return real.withColumn("_bx", F.explode(span("x0", "x1"))).withColumn("_by", F.explode(span("top", "bottom")))

    # what comes out of arrays is more than a plan can tell, so neither side is sent whole to every task
    pairs = bucketed(boxes, "").join(bucketed(_other(regions), "b_").hint("merge"), ["page", "_bx", "_by"])
    left, top = F.greatest("x0", "b_x0"), F.greatest("top", "b_top")
    shared = (left < F.least("x1", "b_x1")) & (top < F.least("bottom", "b_bottom"))
    return pairs.where(shared & (F.floor(left / size) == F.col("_bx")) & (F.floor(top / size) == F.col("_by"))).drop("_bx", "_by")


def shapes(boxes: DataFrame, *more: str, keep: Callable[[str], Column] | None = None) -> DataFrame:
    """(page, more, sides) of ``boxes``, each once; with ``keep`` the box_id that it picks of equals."""
    keys = ["page", *more, *SIDES]
    return boxes.groupBy(*keys).agg(keep("box_id").alias("box_id")) if keep else boxes.select(*keys).distinct()


def _with_best(boxes: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """``boxes`` with the columns that ``best`` has for their ``keys``."""
    found = [c for c in best.columns if c not in keys]
    return boxes.join(best, keys, "left").select(*boxes.columns, *found)


def best_overlap(boxes: DataFrame, regions: DataFrame, least: float = 0.3) -> DataFrame:
    """``boxes`` with ``region_id``: the region that covers the largest share of each, at
    least ``least``; of equal shares the region of which the box takes more, then the later."""
    pairs = overlapping(shapes(boxes), shapes(regions, keep=F.max)).withColumn("_ov", overlap_area()).withColumn("_vo", overlap_area("b_", "")).where(F.col("_ov") >= least)
    best = pairs.groupBy("page", *SIDES).agg(F.max(F.struct("_ov", "_vo", "b_box_id"))["b_box_id"].alias("region_id"))
    return _with_best(boxes, best, ["page", *SIDES])


def first_overlap(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """``boxes`` with ``region_id``: the region with the largest share of its own area in
    each box, the earlier of equals."""
    pairs = overlapping(shapes(boxes), shapes(regions, keep=F.min)).withColumn("_ov", overlap_area("b_", "")).where("_ov > 0")
    best = pairs.groupBy("page", *SIDES).agg(F.max_by("b_box_id", F.struct(F.col("_ov"), -F.col("b_box_id"))).alias("region_id"))
    return _with_best(boxes, best, ["page", *SIDES])


def tightest_fit(boxes: DataFrame, columns: DataFrame) -> DataFrame:
    """``boxes`` with ``column_id``: the horizontally nearest column of the same layoutno, by
    left sides, right sides or middles, the earlier of equals.

    Of each measure only the next column before and after a box can be nearest, so
    both stand in one order and a running value tells them: no box meets every
    column.  A null side is no measure; columns and boxes without any take no part."""
    measures = {0: F.col("x0"), 1: F.col("x1"), 2: F.col("x0") + F.col("x1")}

    def places(rows: DataFrame, *more: str | Column) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("_k"), c.cast("double").alias("_v")) for k, c in measures.items()))).alias("_m")
        return rows.select("page", F.coalesce("layoutno", F.lit("0")).alias("_layout"), *more, each).select("page", "_layout", *more, "_m.*").where("_v is not null")

    axis, none = ["page", "_layout", "_k"], F.lit(None).cast(dict(columns.dtypes)["box_id"])
    asked = places(boxes.select("page", "layoutno", "x0", "x1").distinct(), "x0", "x1")
    points = places(columns, "box_id").unionByName(asked.select(*axis, "_v", none.alias("box_id")).distinct()).groupBy(*axis, "_v").agg(F.min("box_id").alias("box_id"))
    here = F.when(F.col("box_id").isNotNull(), F.struct("_v", "box_id"))
    for name, order in (("_before", F.asc("_v")), ("_after", F.desc("_v"))):
        points = points.withColumn(name, F.last(here, ignorenulls=True).over(Window.partitionBy(*axis).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    near = [F.when(F.col(n).isNotNull(), F.struct((F.abs(F.col("_v") - F.col(n)["_v"]) / F.when(F.col("_k") == 2, 2).otherwise(1)).alias("d"), F.col(n)["box_id"].alias("column_id"))) for n in ("_before", "_after")]
    nearest = points.select(*axis, "_v", F.least(*near).alias("_near")).where("_near is not null")
    best = asked.join(nearest, [*axis, "_v"]).groupBy("page", "_layout", "x0", "x1").agg(F.min("_near")["column_id"].alias("column_id"))
    keys = ["page", "_layout", "x0", "x1"]
    placed = boxes.withColumn("_layout", F.coalesce("layoutno", F.lit("0")))
    same = reduce(lambda a, b: a & b, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    return placed.alias("a").join(best.alias("b"), same, "left").select(*(F.col(f"a.{c}") for c in boxes.columns), "b.column_id")


def tag_layouts(boxes: DataFrame, layouts: DataFrame, least: float = 0.4, keep_garbage: bool = False) -> DataFrame:
    """``boxes`` with layout_type and layoutno of the region that claims each, kinds taken
    in their fixed order; boxes of headers, footers and references go."""
    order = F.array_position(F.array(*(F.lit(x) for x in LAYOUT_PRIORITY)), F.col("b_type"))
    pairs = overlapping(shapes(boxes), shapes(layouts, "type", keep=F.max)).withColumn("_ov", overlap_area()).withColumn("_vo", overlap_area("b_", "")).where((F.col("_ov") >= least) & (order > 0))
    best = pairs.groupBy("page", *SIDES).agg(F.max_by(F.struct("b_type", "b_box_id"), F.struct(-order, F.col("_ov"), F.col("_vo"), F.col("b_box_id"))).alias("_l"))
    out = _with_best(boxes, best, ["page", *SIDES]).withColumn("layout_type", F.coalesce("_l.b_type", F.lit("")))
    out = out.withColumn("layoutno", F.when(F.col("_l").isNotNull(), F.concat_ws("-", F.col("_l.b_type"), F.col("_l.b_box_id").cast("string"))).otherwise("")).drop("_l")
    return out if keep_garbage else out.where(~F.col("layout_type").isin(GARBAGE_LAYOUTS))


def without_repeated_garbage(boxes: DataFrame, garbage: DataFrame) -> DataFrame:
    """``boxes`` without texts that occur more than once among header and footer texts."""
    often = garbage.groupBy(t.strip("text").alias("_text")).agg(F.count("*").alias("n")).where("n > 1").select("_text")
    return boxes.withColumn("_text", t.strip("text")).join(often, "_text", "left_anti").drop("_text")


def suppress(boxes: DataFrame, most_iou: float = 0.45, edge: float = 1.0) -> DataFrame:
    """Boxes (page, kind, box_id, score, ...) that greedy suppression keeps on each page and
    kind: by falling score, what overlaps a kept box above ``most_iou`` goes."""

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["score", "box_id"], ascending=[False, True], ignore_index=True)
        area = (part.x1 - part.x0) * (part.bottom - part.top)
        alive, kept = pd.Series(True, index=part.index), []
        for i in part.index:
            if not alive[i]:
                continue
            kept.append(i)
            w = (part.x1.clip(upper=part.x1[i]) - part.x0.clip(lower=part.x0[i]) + edge).clip(lower=0)
            h = (part.bottom.clip(upper=part.bottom[i]) - part.top.clip(lower=part.top[i]) + edge).clip(lower=0)
            iou = w * h / (area + area[i] - w * h)
            alive &= (iou <= most_iou) | (part.index <= i)
        return part.loc[kept]

    return boxes.groupBy("page", "kind").applyInPandas(keep, boxes.schema)


def clean_layouts(layouts: DataFrame, least: float = 0.7) -> DataFrame:
    """Layouts (page, box_id, type, score, ...) without those that a better one of the same
    type and page covers, or is covered by, to ``least`` or more; ties keep the earlier.  All doubles go, wherever they come in the page's
    order; tables.clean_ahead() looks at the next few only."""
    pairs = overlapping(layouts, layouts).where("b_type = type and b_box_id != box_id")
    better = (F.col("b_score") > F.col("score")) | ((F.col("b_score") == F.col("score")) & (F.col("b_box_id") < F.col("box_id")))
    worse = pairs.where(better & (F.greatest(overlap_area(), overlap_area("b_", "")) >= least)).select("page", "box_id").distinct()
    return layouts.join(worse, ["page", "box_id"], "left_anti")


def compose_pages(texts: DataFrame, tables: DataFrame, least: float = 0.5) -> DataFrame:
    """(page, text): recognised boxes outside tables, and the tables (page, box_id, sides,
    markdown), from top to bottom with blank lines between."""
    covered = overlapping(texts, tables).where(overlap_area() >= least).select("page", "box_id").distinct()
    free = texts.join(covered, ["page", "box_id"], "left_anti").select("page", "top", "x0", F.col("text").alias("t"))
    parts = free.unionByName(tables.select("page", "top", "x0", F.col("markdown").alias("t")))
    return parts.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "t"))), lambda r: r["t"]), "\n\n").alias("text"))


def cell_type(text: Column) -> Column:
    s, out = t.strip(text), None
    for pattern, kind in CELL_TYPES:
        out = F.when(s.rlike(pattern), kind) if out is None else out.when(s.rlike(pattern), kind)
    words = F.filter(F.split(s, r"(?U)\s+"), lambda w: F.length(w) > 1)
    return out.otherwise(F.when(F.size(words) > 12, "Lx").when(F.size(words) > 3, "Tx").otherwise("Ot"))


def most_common_type(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, cell_type): the most frequent type, of equals the one seen first (box_id)."""
    counts = cells.withColumn("cell_type", cell_type(F.col("text"))).groupBy(*by, "cell_type").agg(F.count("*").alias("n"), F.min("box_id").alias("first"))
    return counts.groupBy(*by).agg(F.max_by("cell_type", F.struct(F.col("n"), -F.col("first"))).alias("cell_type"))


def header_rows(cells: DataFrame) -> DataFrame:
    """(table_id, row_no, is_header): rows most of whose cells lie in a header region."""
    return cells.groupBy("table_id", "row_no").agg((F.avg(F.col("in_header").cast("int")) > 0.5).alias("is_header"))


def align_rows(parts: DataFrame) -> DataFrame:
    """Table parts (table_id, label, x0, x1, top, bottom) with rows and headers widened to
    common sides, and columns stretched to common ends: a mean or median of more than
    four, else the extreme."""
    wide = F.col("label").contains("row") | F.col("label").contains("header")
    tall = F.col("label") == "table column"

    def common(test: Column, c: str, middle, extreme) -> Column:
        own = F.when(test, F.col(c))
        return F.when(F.count(own) > 4, middle(own)).otherwise(extreme(own))

    sides = parts.groupBy("table_id").agg(
        common(wide, "x0", F.avg, F.min).alias("_l"), common(wide, "x1", F.avg, F.max).alias("_r"), common(tall, "top", F.median, F.min).alias("_t"), common(tall, "bottom", F.median, F.max).alias("_b"),
    )
    fixed = {"x0": (wide, F.least, "_l"), "x1": (wide, F.greatest, "_r"), "top": (tall, F.least, "_t"), "bottom": (tall, F.greatest, "_b")}
    return parts.join(sides, "table_id").withColumns({c: F.when(test, pick(c, to)).otherwise(F.col(c)) for c, (test, pick, to) in fixed.items()}).drop("_l", "_r", "_t", "_b")


def bands(boxes: DataFrame, by: str = "top", gap: float = 10.0, out: str = "band") -> DataFrame:
    """``boxes`` with ``out``: rows of boxes whose ``by`` follow within ``gap`` of each other."""
    w = Window.partitionBy("page").orderBy(by, "box_id")
    opens = F.coalesce(F.col(by) - F.lag(by).over(w) > gap, F.lit(True)).cast("int")
    return boxes.withColumn("_o", opens).withColumn(out, F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_o")


def reading_order(boxes: DataFrame, gap: float = 10.0) -> DataFrame:
    """``boxes`` with ``position`` on their page: band by band, from left to right."""
    return bands(boxes, gap=gap).withColumn("position", F.row_number().over(Window.partitionBy("page").orderBy("band", "x0", "box_id")))


def table_grid(cells: DataFrame) -> DataFrame:
    """(table_id, row_no, col_no, text): cells (table_id, box_id, R, C, x0, top, text) on a
    dense grid, several in a place joined from left to right."""
    rows = cells.withColumn("row_no", F.dense_rank().over(Window.partitionBy("table_id").orderBy("R"))).withColumn("col_no", F.dense_rank().over(Window.partitionBy("table_id").orderBy("C")))
    listed = F.array_sort(F.collect_list(F.struct("top", "x0", "box_id", "text")))
    return rows.groupBy("table_id", "row_no", "col_no").agg(F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("text"))


def table_markdown(cells: DataFrame, headers: int = 1) -> DataFrame:
    """(table_id, markdown) of table_grid(): a rule under the first ``headers`` rows."""
    grid = table_grid(cells)
    width = grid.groupBy("table_id").agg(F.max("col_no").alias("width"))
    row = grid.groupBy("table_id", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "text"))).alias("m")).join(width, "table_id")
    cell = F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.replace(F.coalesce(F.col("m")[i], F.lit("")), F.lit("|"), F.lit("\\|")))
    line = F.concat(F.lit("| "), F.array_join(cell, " | "), F.lit(" |"))
    ruled = F.when(F.col("row_no") == headers, F.concat(line, F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("width")))).otherwise(line)
    return row.select("table_id", "row_no", ruled.alias("line")).groupBy("table_id").agg(ordered_text(F.col("line"), F.col("row_no")).alias("markdown"))


def table_sentences(cells: DataFrame) -> DataFrame:
    """(table_id, row_no, text): each row after the first as ``header: cell`` pairs."""
    grid = table_grid(cells)
    heads = grid.where("row_no = 1").select("table_id", "col_no", F.col("text").alias("head"))
    body = grid.where("row_no > 1").join(heads, ["table_id", "col_no"], "left")
    pair = F.when(F.coalesce("head", F.lit("")) == "", F.col("text")).otherwise(F.concat_ws(": ", "head", "text"))
    return body.where("text != ''").groupBy("table_id", "row_no").agg(ordered_text(pair, F.col("col_no"), "; ").alias("text"))


def ctc_text(labels: Column, alphabet: Column, blank: int = 0) -> Column:
    """Greedy decoding of label numbers: repeats and blanks go, the rest are letters."""
    kept = F.filter(labels, lambda x, i: (x != blank) & ((i == 0) | (x != F.get(labels, i - 1))))
    return F.array_join(F.transform(kept, lambda x: F.get(alphabet, x)), "")


def resized_shape(height: Column, width: Column, limit: int = 960, multiple: int = 32) -> Column:
    """Struct (height, width): the longer side at most ``limit``, both multiples of ``multiple``."""
    ratio = F.least(F.lit(1.0), limit / F.greatest(height, width))
    sides = {n: F.greatest(F.bround(c * ratio / multiple) * multiple, F.lit(float(multiple))).cast("int").alias(n) for n, c in (("height", height), ("width", width))}
    return F.struct(*sides.values())


def confident(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    return boxes.where(F.col("score") >= least)
