"""Queries of steps with a text model, which a small stub stands in for, and of tables
from recognised parts; each with the SQL that states the same."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contents, navigate, spell, tables, tree
from ..operators.lines import in_order
from . import derived
from .derived import BOXES_SQL, ITEMS_SQL, OUTLINE_SQL, outline_lines, table

#: Entries that the stub gives in one reply before it breaks off.
A_REPLY = 4


def _breaking_off():
    """A model that turns contents into JSON, some entries a reply, and stops in the middle of the next one."""

    def ask(prompt: str, before: list[dict]) -> tuple[str, bool]:
        source, _, so_far = prompt.partition("JSON so far:\n")
        entries = [json.dumps({"structure": s, "title": x, "page": int(p)}) for s, x, p in re.findall(r"^(\S+) (.+?): +([0-9]+)$", source, re.M)]
        at = so_far.count("}")
        rest = entries[at + A_REPLY :]
        text = ("" if so_far else '{"table_of_contents": [') + ", ".join(entries[at : at + A_REPLY]) + (f", {rest[0][:9]}" if rest else "]}")
        return (f"```json\n{text}\n```" if so_far else text), not rest

    return ask


def _all_entries():
    return lambda source, reply: reply.count("}") > len(re.findall(r"^\S+ .+?: +[0-9]+$", source, re.M))


def contents_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as the lines of contents pages, ten a page; a model that breaks off makes entries of them."""
    k = F.row_number().over(in_order("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderpriority").withColumn("k", k)
    line = F.format_string("1.%d %s.......... %d\n", "k", "o_orderpriority", F.col("o_orderkey") % 300)
    pages = rows.groupBy("doc_id", F.floor((F.col("k") - 1) / 10).cast("int").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "").alias("text"))
    told = contents.transformed_contents(contents.raw_contents(pages), _breaking_off, _all_entries)
    kept = told.select("doc_id", "turns", "complete")
    return contents.contents_items(told).join(kept, "doc_id")


def scanned_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_order(derived.boxes(spark, sf_dir)[0]).select("page", "box_id", "position")


def tolerant_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by top and by left side with a tolerance, the second by a number as well; the tests restate it."""
    boxes = derived.boxes(spark, sf_dir)[0].withColumn("number", F.when(F.col("box_id") % 3 > 0, F.floor(F.col("x0") / 100)))
    placed = tables.tolerant_order(boxes, 6.0, out="by_top")
    return tables.tolerant_order(placed, 20.0, "x0", "top", number="number", out="by_column").select("page", "box_id", "by_top", "by_column")


def layouts_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions without those that one of the next in their order doubles; the tests restate it."""
    small, wide = derived.boxes(spark, sf_dir)
    scored = wide.withColumns({"type": F.when(F.col("box_id") % 5 == 0, "table").otherwise("text"), "score": F.when(F.col("box_id") % 4 > 0, F.col("box_id") % 10 / 10)})
    return tables.clean_ahead(scored, small, ahead=5, least=0.3).select("page", "box_id")


#: The columns of the tables that orders make.
HEADS = ["quantity", "price", "flag"]


def _order_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(boxes, parts): each order as a recognised table, its line items as rows, with a
    doubled row part in some and a spanning head in others.

    An order's items are one array, of which both are made, so that only items are shuffled."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    tasks = max(spark.sparkContext.defaultParallelism, -(-item.count() // derived.ROWS_A_TASK))
    items = item.repartition(tasks, "l_orderkey").groupBy(F.col("l_orderkey").alias("page")).agg(F.array_sort(F.collect_list(F.struct(*item.columns[1:]))).alias("items"))
    # as unique_items(): of a number that comes twice the largest, which is the last
    last = F.filter("items", lambda x, k: ~F.coalesce(F.get("items", k + 1)["l_linenumber"].eqNullSafe(x["l_linenumber"]) & (k + 1 < F.size("items")), F.lit(False)))
    rows = items.select("page", F.transform(last, lambda x: F.struct(x["l_quantity"].cast("int").cast("string").alias("a"), x["l_linestatus"].alias("b"), x["l_returnflag"].alias("c"))).alias("rows"))
    spanned, heads = F.col("page") % 5 == 0, F.struct(*(F.lit(h).alias(c) for h, c in zip(HEADS, "abc")))
    lines = rows.select("page", F.posexplode(F.concat(F.array(heads), "rows")).alias("i", "x"))
    cells = lines.select("page", "i", F.posexplode(F.array("x.a", "x.b", "x.c")).alias("j", "text")).where(~(spanned & (F.col("i") == 0) & (F.col("j") == 1)))
    x, y = 100.0 * F.col("j") + 5 + (F.col("page") + F.col("i")) % 4, 20.0 * F.col("i") + 2 + (F.col("page") + F.col("j")) % 3
    boxes = cells.select("page", (F.col("i") * 10 + F.col("j")).cast("int").alias("box_id"), x.alias("x0"), (x + 60).alias("x1"), y.alias("top"), (y + 13).alias("bottom"), "text", F.lit("table").alias("layout_type"))

    # a header, n rows, columns, a double of the first row, a span
    n, k = F.col("n"), F.col("k")
    j = (k - n - 1).cast("double")
    each = rows.select("page", F.size("rows").alias("n")).select("page", "n", F.explode(F.sequence(F.lit(0), n + len(HEADS) + 2)).alias("k"))
    low, high = 20.0 * k, 20.0 * n + 20
    kinds = [
        (k == 0, (0, "table column header", 0.9, 0.0, 300.0, 0.0, 18.0), None), (k <= n, (k, "table row", 0.9, 0.0, 300.0, low, low + 18), None),
        (k <= n + len(HEADS), (k - n + 69, "table column", 0.8, 100.0 * j, 100.0 * j + 95, 0.0, high), None),
        (k == n + len(HEADS) + 1, (90, "table row", 0.4, 0.0, 300.0, 21.0, 37.0), F.col("page") % 3 == 0), (F.lit(True), (80, "table spanning cell", 0.7, 0.0, 198.0, 0.0, 18.0), spanned),
    ]

    def chosen(make) -> F.Column:
        found = F.when(kinds[0][0], make(kinds[0]))
        for kind in kinds[1:]:
            found = found.when(kind[0], make(kind))
        return found

    value = lambda at, of: chosen(lambda kind: F.lit(kind[1][at]).cast(of))
    names = {"part_id": "int", "label": "string", "score": "double", "x0": "double", "x1": "double", "top": "double", "bottom": "double"}
    there = chosen(lambda kind: F.lit(True) if kind[2] is None else kind[2])
    return boxes, each.where(there).select("page", *(value(at, of).alias(name) for at, (name, of) in enumerate(names.items())))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.recognised_cells(*_order_tables(spark, sf_dir)).select("page", "box_id", "row", "column", "header", "span")


def table_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.recognised_tables(*_order_tables(spark, sf_dir)).select("page", "row_no", "col_no", "text", "row_span", "col_span")


def region_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tables_as_markdown(*_order_tables(spark, sf_dir))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _by_title():
    """A model that opens a chapter, then the articles that name the target, then their second points; and an id that is none."""

    def ask(prompt: str) -> str:
        target = re.search(r"^Question: find (.*)$", prompt, re.M)[1]
        shown = re.findall(r"^- \[([0-9]+)\] (.*)$", prompt, re.M)
        return json.dumps({"node_list": [i for i, title in shown if title.startswith(("CHƯƠNG", "2. ")) or target in title] + ["no id"]})

    return ask


def navigated_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each customer, answered from the outline of its orders and line items."""
    lines = outline_lines(spark, sf_dir).select("doc_id", "line_num", "level", "line")
    nodes = lines.select("doc_id", "line_num", F.col("line_num").alias("ord"), "level", F.regexp_replace("line", "^#+ ", "").alias("title"), F.lit(None).cast("string").alias("summary"))
    nodes = tree.with_node_ids(tree.with_parents(nodes))
    customers = table(spark, sf_dir, "customer")
    target = F.element_at(F.array(*(F.lit(p) for p in PRIORITIES)), (F.col("c_custkey") % 5 + 1).cast("int"))
    questions = customers.select(F.col("c_custkey").alias("question_id"), F.col("c_custkey").alias("doc_id"), F.concat(F.lit("find "), target).alias("question"))
    names = customers.select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("filename"))
    return navigate.navigate(questions, nodes, lines.select("doc_id", "line_num", "line"), names, _by_title)


def compound_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of texts that with a neighbour are a pair which texts of the same language have with accents; the tests restate it."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    split = F.split(F.lower("text"), " ")
    pair = F.explode(F.zip_with(split, F.slice(split, F.lit(2), F.size(split)), lambda a, b: F.concat_ws(" ", a, b)))
    terms = texts.where("lang in ('es', 'fr')").select(pair.alias("term")).where(F.col("term").rlike(r"^\p{L}+ \p{L}+$") & F.col("term").rlike("[à-ÿ]"))
    counted = terms.groupBy("term").agg(F.count("*").alias("freq")).where("freq >= 3")
    words = spell.once(counted, "term", F.max("freq").alias("freq"))
    found = spell.compound_fixes_of(derived.spread(texts.select("doc_id", "text")), "[a-z]{4,}", words)
    return found.select("doc_id", "token", "position", "compound_with", "start", "end", F.array_join("compound_candidates", ",").alias("compound_candidates"))


QUERIES = [navigated_contexts, compound_tokens, contents_turns, scanned_positions, tolerant_positions, layouts_ahead, table_cells, table_spans, region_markdown]

_GRID_SQL = f"""{ITEMS_SQL},
it AS (SELECT l_orderkey AS page, l_quantity, l_linestatus, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM items),
cells AS (
  SELECT page, i AS row_no, unnest([0, 1, 2]) AS col_no, unnest([l_quantity::INTEGER::VARCHAR, l_linestatus, l_returnflag]) AS text FROM it
  UNION ALL SELECT DISTINCT page, 0, j, CASE WHEN j = 1 AND page % 5 = 0 THEN 'quantity' ELSE (['quantity', 'price', 'flag'])[j + 1] END FROM it, (SELECT unnest([0, 1, 2]) AS j))"""

SQL = {
    "navigated_contexts": f"""
WITH {OUTLINE_SQL},
q AS (SELECT c_custkey AS doc_id, c_name, ({PRIORITIES})[(c_custkey % 5 + 1)::INTEGER] AS target FROM customer),
o AS (SELECT outline.* FROM outline JOIN q USING (doc_id) WHERE level = 2 AND contains(line, target)),
i AS (SELECT outline.* FROM outline JOIN o ON outline.doc_id = o.doc_id AND outline.up = o.own WHERE outline.level = 3 AND outline.line LIKE '### 2. %'),
p AS (
  SELECT doc_id, line_num, line FROM i
  UNION ALL SELECT doc_id, line_num, line FROM o WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.doc_id = o.doc_id AND i.up = o.own)
  UNION ALL SELECT doc_id, line_num, line FROM outline WHERE level = 1 AND doc_id NOT IN (SELECT doc_id FROM o)),
m AS (SELECT doc_id, max(line_num) AS last_line FROM outline GROUP BY doc_id)
SELECT doc_id AS question_id, doc_id, string_agg('[Nguồn: ' || c_name || ', Dòng: ' || line_num || '-' || CASE WHEN line_num = last_line THEN '...' ELSE line_num::VARCHAR END || ']' || chr(10) || line,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY line_num) AS context
FROM p JOIN q USING (doc_id) JOIN m USING (doc_id) GROUP BY doc_id""",
    "contents_turns": f"""
WITH k AS (
  SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderpriority AS title, o_orderkey % 300 AS page FROM orders)
SELECT doc_id, ord::INTEGER AS ord, '1.' || ord AS structure, title, page::INTEGER AS page, least(ceil(n / {A_REPLY}.0), 6)::INTEGER AS turns, n <= {6 * A_REPLY} AS complete
FROM k WHERE ord <= {6 * A_REPLY}""",
    "scanned_positions": f"""
WITH {BOXES_SQL},
p AS (SELECT page, list([struct_pack(top := top, x0 := x0, box_id := box_id)] ORDER BY top, x0, box_id) AS l FROM boxes GROUP BY page),
s AS (
  SELECT page, list_reduce(l, lambda a, b: a[1 : coalesce(list_max(list_filter(range(1, len(a) + 1), lambda i: NOT (abs(b[1].top - a[i].top) < 10 AND b[1].x0 < a[i].x0))), 0)] || b
    || a[coalesce(list_max(list_filter(range(1, len(a) + 1), lambda i: NOT (abs(b[1].top - a[i].top) < 10 AND b[1].x0 < a[i].x0))), 0) + 1 :]) AS l FROM p)
SELECT page, l[i].box_id AS box_id, i::INTEGER AS position FROM s, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)""",
    "table_cells": f"""
WITH {_GRID_SQL}
SELECT page, (row_no * 10 + col_no)::INTEGER AS box_id, row_no::INTEGER AS row, col_no::INTEGER AS "column", CASE WHEN row_no = 0 THEN 0 END AS header,
  CASE WHEN row_no = 0 AND col_no = 0 AND page % 5 = 0 THEN 0 END AS span
FROM cells WHERE NOT (row_no = 0 AND col_no = 1 AND page % 5 = 0)""",
    "table_spans": f"""
WITH {_GRID_SQL}
SELECT page, row_no::INTEGER AS row_no, col_no::INTEGER AS col_no, text, 1 AS row_span, CASE WHEN row_no = 0 AND col_no = 0 AND page % 5 = 0 THEN 2 ELSE 1 END AS col_span FROM cells""",
    "region_markdown": f"""
WITH {_GRID_SQL},
r AS (SELECT page, row_no, '| ' || string_agg(text, ' | ' ORDER BY col_no) || ' |' || chr(10) || CASE WHEN row_no = 0 THEN '| --- | --- | --- |' || chr(10) ELSE '' END AS line FROM cells GROUP BY page, row_no)
SELECT page, string_agg(line, '' ORDER BY row_no) AS markdown FROM r GROUP BY page""",
}
