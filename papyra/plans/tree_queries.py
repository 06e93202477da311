"""Queries of heading trees, tables of contents and packing, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lines as ln
from ..operators import packing, recognition, rules, toc, tree
from . import text_queries
from .derived import ITEMS_SQL, OUTLINE_SQL, outline_lines, spread, table, unique_items


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline as heading nodes; own and up stay for comparison."""
    return outline_lines(spark, sf_dir).select("doc_id", F.col("line_num").alias("ord"), "line_num", "level", F.regexp_replace("line", "^#+ ", "").alias("title"), "own")


def _shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline lines in which points are body text and every eleventh line is a fence."""
    line = F.when(F.col("line_num") % 11 == 0, "```").when(F.col("level") == 3, F.regexp_replace("line", "^#+ ", "")).otherwise(F.col("line"))
    return outline_lines(spark, sf_dir).select("doc_id", "line_num", line.alias("line"))


def heading_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.headings(_shallow(spark, sf_dir))


def node_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.node_texts(_shallow(spark, sf_dir)).select("doc_id", "ord", "line_num", "text")


def tree_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree.with_parents(_nodes(spark, sf_dir))
    up = nodes.select("doc_id", F.col("ord").alias("parent_ord"), F.col("own").alias("up"))
    return nodes.join(up, ["doc_id", "parent_ord"], "left").select("doc_id", "own", "up")


def tree_node_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.with_depth(tree.with_node_ids(_nodes(spark, sf_dir))).select("doc_id", "own", "node_id", "depth")


def subtree_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir).withColumn("chars", F.length("title").cast("long"))
    return tree.with_subtree_sum(nodes, "chars", "subtree_chars").select("doc_id", "own", (F.col("last_ord") - F.col("ord") + 1).alias("nodes"), "subtree_chars")


def leaf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.leaves(tree.with_parents(_nodes(spark, sf_dir))).select("doc_id", "own")


def dotted_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes 1, 1.<order>, 1.<order>.<line>; every fifth order's own row is missing."""
    code = F.when(F.col("level") == 1, "1").when(F.col("level") == 2, F.regexp_replace("own", "^o", "1.")).otherwise(F.regexp_replace("own", "^i", "1."))
    items = outline_lines(spark, sf_dir).select("doc_id", F.col("line_num").alias("ord"), code.alias("code"))
    items = items.where(~(F.col("code").rlike(r"^1\.\d+$") & (F.substring("code", 3, 20).cast("long") % 5 == 0)))
    return tree.dotted_parents(items).select("doc_id", "ord", "code", "parent_ord")


def node_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.line_bounds(tree.headings(_shallow(spark, sf_dir))).select("doc_id", "ord", "start_line", "end_line")


def node_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the contexts of its third and its second node, in that order."""
    lines = _shallow(spark, sf_dir)
    nodes = tree.headings(lines)
    docs = nodes.select("doc_id").distinct()
    asked = docs.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("pick"), F.lit("0002").alias("node_id")), F.struct(F.lit(2).alias("pick"), F.lit("0001").alias("node_id")))).alias("a"), F.lit("c.md").alias("filename"))
    return tree.context_of_nodes(asked.select("doc_id", "a.*", "filename"), nodes, lines)


def outline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree.with_depth(tree.with_node_ids(_nodes(spark, sf_dir))).withColumn("summary", F.when(F.col("level") == 2, "two  words"))
    return tree.outlines(nodes)


def top_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without chapters the articles are the roots."""
    return tree.top_headings(tree.with_parents(_nodes(spark, sf_dir).where("level > 1")))


def sibling_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree.with_parents(_nodes(spark, sf_dir))
    return tree.sibling_levels(nodes).select("doc_id", "own", "fixed_level")


def nodes_in_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("3,9-12").alias("pages"))
    return tree.nodes_in_pages(_nodes(spark, sf_dir), asked).select("doc_id", "line_num", "title")


def pages_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as pages 1 to n; the first, third to fifth and hundredth are asked for."""
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"), F.col("o_orderpriority").alias("text"))
    return tree.pages_asked(pages, pages.select("doc_id").distinct().withColumn("pages", F.lit("3-5,1,100")))


def _toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as entries on every third page, every fourth entry's page unknown."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey")
    items = orders.withColumn("ord", F.row_number().over(ln.in_order("o_orderkey")))
    page = F.col("ord") * 3 - F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)
    return items.select("doc_id", "ord", F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"), F.col("ord").alias("page"), F.when(F.col("ord") % 4 != 0, page).alias("physical_index"), F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("no").alias("appear_start"))


def _toc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page for each page number, titles on every third one and nothing on the others."""
    items = _toc(spark, sf_dir).select("doc_id", "ord", "title")
    spread = items.select("doc_id", "title", F.posexplode(F.array(F.lit(-2), F.lit(-1), F.lit(0))).alias("k", "d"), "ord")
    text = F.when(F.col("d") == 0, F.concat(F.lit("... "), F.upper("title"))).otherwise("blank")
    return spread.select("doc_id", (F.col("ord") * 3 + F.col("d")).alias("page"), text.alias("text"), F.lit(100).alias("token_len"))


_TOC_SQL = """
items AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord FROM orders),
toc AS (SELECT doc_id, ord, 'Order ' || o_orderkey AS title, ord AS page, CASE WHEN ord % 4 <> 0 THEN ord * 3 - CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END END AS physical_index,
  CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS appear_start FROM items)"""


def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _toc(spark, sf_dir).where("physical_index is not null")
    return tree.page_spans(items, F.lit(400)).select("doc_id", "ord", "start_index", "end_index")


def preface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.with_preface(_toc(spark, sf_dir).withColumn("structure", F.col("ord").cast("string"))).select("doc_id", "ord", "structure", "title", "physical_index")


def toc_page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as pages, contents where the quantity is above 20; the scan stops at page 3."""
    pages = unique_items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") > 20).alias("is_toc"))
    return toc.toc_pages(pages, scan=3)


def toc_offset_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _toc(spark, sf_dir)
    return toc.page_offsets(toc.page_pairs(items, items.select("doc_id", "ord", "title", "physical_index"), 3))


def toc_fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.fill_missing(_toc(spark, sf_dir), _toc_pages(spark, sf_dir)).select("doc_id", "ord", "physical_index")


def toc_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.known_neighbours(_toc(spark, sf_dir)).select("doc_id", "ord", "prev_index", "next_index")


def toc_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.truncate_indices(_toc(spark, sf_dir), F.lit(20)).select("doc_id", "ord", "physical_index")


def toc_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toc.toc_accuracy(_toc(spark, sf_dir), _toc_pages(spark, sf_dir))
    return found.select("doc_id", F.round("accuracy", 6).alias("accuracy"))


def toc_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.repair_entries(_toc(spark, sf_dir), _toc_pages(spark, sf_dir)).select("doc_id", "ord", "physical_index")


def large_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _toc(spark, sf_dir).where("physical_index is not null").withColumn("end_index", F.col("physical_index") + F.col("ord") * 2)
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(120))).alias("page")).withColumn("token_len", (F.col("page") * 7 + F.col("doc_id")) % 200)
    return toc.large_sections(spans.select("doc_id", "ord", F.col("physical_index").alias("start_index"), "end_index"), pages).select("doc_id", "ord", "tokens")


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.chunk_lines(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.prepare_lines(ln.explode_lines(spread(table(spark, sf_dir, "documents"))))


def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sentence_segments(_clean(spark, sf_dir))


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.blocks(_clean(spark, sf_dir))


def _outline_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shallow(spark, sf_dir).select("doc_id", F.col("line_num").alias("line_id"), F.regexp_replace("line", "^#+ ", "").alias("text"))
    return packing.blocks(rows)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sections(_outline_blocks(spark, sf_dir)).groupBy("doc_id", "section_id").agg(F.min("block_id").alias("first_block"), F.count("*").alias("n_blocks"), F.min_by("anchor", "block_id").alias("anchor"))


def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.chunk_signals(packing.semantic_chunks(_outline_blocks(spark, sf_dir)))


def block_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = rules.block_roles(packing.with_position(_outline_blocks(spark, sf_dir)))
    return rules.node_candidates(roles).select("doc_id", "block_id", "role", "rough_level", "level")


def outline_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _outline_blocks(spark, sf_dir)
    nodes = rules.node_candidates(rules.block_roles(packing.with_position(blocks)))
    return rules.outline_parents(rules.with_missing_headings(nodes.where("role != 'MAIN_CONTENT_UNIT'"), blocks)).select("doc_id", "block_id", "level", "parent_block_id")


def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source, the null one among them, as its pages, four characters a token."""
    pages = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.coalesce("source", F.lit("?")), F.lit("/"), F.floor(F.col("doc_id") / 50)).alias("doc_id"), F.col("doc_id").cast("int").alias("page"), "text", toc.approximate_tokens(F.col("text")).alias("token_len"))
    return packing.pack_pages(pages, most=2000).select("doc_id", "part", "first_page", "last_page", F.length("text").alias("chars"))


def tree_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir).withColumn("text", F.col("title")).withColumn("tokens", F.length("title").cast("long"))
    return packing.thin_tree(tree.with_subtree_sum(nodes, "tokens", "subtree_tokens"), 60).select("doc_id", "own", "text")


def trust_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chunks with signals by their figures, and a model's answers for most."""
    item = unique_items(spark, sf_dir)
    number = F.col("l_quantity").cast("int")
    chunks = item.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_id"), F.array(F.col("l_linenumber")).alias("source_block_ids"), F.lit("this header of a chunk has more than twelve words so it is no heading").alias("candidate_header"),
        (number % 3 == 0).alias("has_numbering"), F.when(number % 3 == 0, number % 4 + 1).otherwise(0).alias("numbering_level"), (number % 5 == 0).alias("is_all_caps"), F.lit(False).alias("has_article"), F.lit(False).alias("has_chapter"), F.lit(True).alias("ends_period"),
    )
    said = F.element_at(F.array(*(F.lit(x) for x in ("keep", "merge", "noise", "Review ", "stay", "what"))), number % 6 + 1)
    role = F.element_at(F.array(*(F.lit(x) for x in ("header", "body", "title", "footer"))), number % 4 + 1)
    model = item.where("l_linenumber < 6").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_id"), role.alias("role"), said.alias("decision"), F.col("l_linenumber").cast("string").alias("level"), F.array(F.lit("possible_body"), F.lit("odd")).alias("risk_flags"), F.lit(None).cast("boolean").alias("is_node"))
    out = rules.validate_decisions(chunks, rules.normalise_model_rows(model))
    return out.select("doc_id", "chunk_id", "role", "trust", "final_decision", "final_level", "applied", "is_node")


def recognition_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.recognition_prompts(packing.chunk_signals(packing.semantic_chunks(_outline_blocks(spark, sf_dir)))).select("doc_id", "batch", F.size("chunk_ids").alias("n"), F.length("prompt").alias("chars"))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree.with_depth(tree.with_node_ids(_nodes(spark, sf_dir))).withColumn("summary", F.lit("s"))
    return recognition.descriptions(nodes)


QUERIES = [
    recognition_prompts, descriptions, pages_asked, heading_extract, node_text, tree_parent, tree_node_id, subtree_size, leaf_nodes, dotted_tree, node_bounds, node_context, outline_text, top_headings, sibling_levels, nodes_in_pages, page_spans, preface, toc_page_runs,
    toc_offset_mode, toc_fill_missing, toc_neighbours, toc_truncate, toc_accuracy, toc_repair, large_sections, chunk_lines, sentence_segments, text_blocks, sections, semantic_chunks, block_roles, outline_nodes, page_parts,
    tree_thinning, trust_decisions,
]

_SHALLOW_SQL = OUTLINE_SQL + """,
shallow AS (SELECT doc_id, line_num, CASE WHEN line_num % 11 = 0 THEN '```' WHEN level = 3 THEN regexp_replace(line, '^#+ ', '') ELSE line END AS line FROM outline),
fenced AS (SELECT *, count(*) FILTER (WHERE line = '```') OVER (PARTITION BY doc_id ORDER BY line_num) % 2 = 1 AS inside FROM shallow),
heads AS (SELECT doc_id, line_num, length(regexp_extract(line, '^#+')) AS level, regexp_replace(line, '^#+ ', '') AS title, row_number() OVER (PARTITION BY doc_id ORDER BY line_num) AS ord FROM fenced WHERE line LIKE '#%' AND NOT inside),
bounds AS (SELECT *, lead(line_num) OVER (PARTITION BY doc_id ORDER BY line_num) - 1 AS end_line FROM heads)"""

_TREE_SQL = OUTLINE_SQL + ", nodes AS (SELECT doc_id, line_num AS ord, level, own, up, regexp_replace(line, '^#+ ', '') AS title FROM outline)"

_KEPT_TREE_SQL = _TREE_SQL.replace("nodes AS (", "nodes AS MATERIALIZED (")

SQL = {
    "descriptions": f"""WITH {_TREE_SQL}, n AS (SELECT doc_id, ord, level, '{{"title":"' || title || '","node_id":"' || printf('%04d', ord - 1) || '","depth":' || (level - 1) || CASE WHEN level = 1 THEN ',"summary":"s"}}' ELSE '}}' END AS j FROM nodes),
l AS (SELECT doc_id, d, '[' || string_agg(j, ',' ORDER BY ord) || ']' AS s FROM n, (SELECT unnest([0, 1, 2]) AS d) WHERE level - 1 <= d GROUP BY doc_id, d)
SELECT doc_id, coalesce(arg_max(s, d) FILTER (WHERE length(s) <= 8000), max(s[1:8000] || '...') FILTER (WHERE d = 0)) AS structure FROM l GROUP BY doc_id""",
    "heading_extract": f"WITH {_SHALLOW_SQL} SELECT doc_id, ord, level, title, line_num FROM heads",
    "node_text": rf"WITH {_SHALLOW_SQL} SELECT b.doc_id, b.ord, b.line_num, regexp_replace(string_agg(s.line, chr(10) ORDER BY s.line_num), '\s+$', '') AS text FROM bounds b JOIN shallow s ON s.doc_id = b.doc_id AND s.line_num >= b.line_num AND (b.end_line IS NULL OR s.line_num <= b.end_line) GROUP BY ALL",
    "tree_parent": f"WITH {_TREE_SQL} SELECT doc_id, own, up FROM nodes",
    "tree_node_id": f"WITH {_TREE_SQL} SELECT doc_id, own, printf('%04d', ord - 1) AS node_id, level - 1 AS depth FROM nodes",
    "subtree_size": f"""WITH {_TREE_SQL}, own_and_below AS (SELECT doc_id, own AS top, title FROM nodes UNION ALL SELECT doc_id, up, title FROM nodes WHERE up IS NOT NULL UNION ALL SELECT doc_id, 'c', title FROM nodes WHERE level = 3)
SELECT doc_id, top AS own, count(*) AS nodes, sum(length(title)) AS subtree_chars FROM own_and_below GROUP BY doc_id, top""",
    "leaf_nodes": f"WITH {_KEPT_TREE_SQL}, above AS MATERIALIZED (SELECT DISTINCT doc_id, up FROM nodes WHERE up IS NOT NULL) SELECT n.doc_id, n.own FROM nodes n LEFT JOIN above a ON a.doc_id = n.doc_id AND a.up = n.own WHERE a.up IS NULL",
    "dotted_tree": f"""WITH {_KEPT_TREE_SQL}, c AS (SELECT doc_id, ord, level, CASE level WHEN 1 THEN '1' ELSE '1.' || own[2:] END AS code, CASE WHEN level > 1 THEN regexp_extract(own, '[0-9]+')::BIGINT END AS o FROM nodes),
k AS MATERIALIZED (SELECT * FROM c WHERE NOT (level = 2 AND o % 5 = 0))
SELECT doc_id, ord, code, CASE level WHEN 2 THEN min(ord) FILTER (WHERE level = 1) OVER (PARTITION BY doc_id) WHEN 3 THEN max(ord) FILTER (WHERE level = 2) OVER (PARTITION BY doc_id, o) END AS parent_ord FROM k""",
    "node_bounds": f"WITH {_SHALLOW_SQL} SELECT doc_id, ord, line_num AS start_line, end_line FROM bounds",
    "node_context": rf"""WITH {_SHALLOW_SQL}, n AS (SELECT *, CASE ord WHEN 3 THEN 1 ELSE 2 END AS pick FROM bounds WHERE ord IN (2, 3)),
x AS (SELECT n.doc_id, pick, n.line_num, end_line, regexp_replace(string_agg(s.line, chr(10) ORDER BY s.line_num), '\s+$', '') AS body FROM n JOIN shallow s ON s.doc_id = n.doc_id AND s.line_num BETWEEN n.line_num AND coalesce(end_line, n.line_num + 19) GROUP BY ALL)
SELECT doc_id, string_agg('[Nguồn: c.md, Dòng: ' || line_num || '-' || coalesce(end_line::VARCHAR, '...') || ']' || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pick) AS context FROM x GROUP BY doc_id""",
    "outline_text": f"WITH {_TREE_SQL} SELECT doc_id, string_agg(repeat('  ', level - 1) || '- [' || printf('%04d', ord - 1) || '] ' || title || CASE WHEN level = 2 THEN ': two words' ELSE '' END, chr(10) ORDER BY ord) AS outline FROM nodes GROUP BY doc_id",
    "top_headings": f"""WITH {_TREE_SQL}, r AS (SELECT doc_id, title, level, ord, row_number() OVER (PARTITION BY doc_id, level ORDER BY ord) AS k FROM nodes WHERE level > 1)
SELECT doc_id, count(*) AS node_count, string_agg(title, ', ' ORDER BY ord) FILTER (WHERE level = 2 AND k <= 8) AS top_headings FROM r GROUP BY doc_id""",
    "sibling_levels": f"""WITH {_TREE_SQL}, k AS (SELECT *, CASE WHEN level = 2 THEN 'ARTICLE' WHEN level = 3 AND title LIKE '%. %' THEN 'NUMBER' WHEN level = 3 THEN 'LETTER' END AS kind FROM nodes), n AS (SELECT *, count(kind) OVER (PARTITION BY doc_id, up, kind) AS c FROM k)
SELECT doc_id, own, CASE WHEN c < 2 THEN level WHEN kind = 'ARTICLE' THEN 2 WHEN kind = 'NUMBER' THEN 3 WHEN kind = 'LETTER' THEN 4 ELSE level END AS fixed_level FROM n""",
    "nodes_in_pages": f"WITH {_TREE_SQL} SELECT doc_id, ord AS line_num, title FROM nodes WHERE ord BETWEEN 3 AND 12",
    "pages_asked": "SELECT * FROM (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderpriority AS text FROM orders) WHERE page IN (1, 3, 4, 5, 100)",
    "page_spans": f"""WITH {_TOC_SQL}, k AS (SELECT *, lead(physical_index) OVER w AS n, lead(appear_start) OVER w AS s FROM toc WHERE physical_index IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, ord, physical_index AS start_index, CASE WHEN n IS NULL THEN 400 WHEN s = 'yes' THEN n - 1 ELSE n END AS end_index FROM k""",
    "preface": f"WITH {_TOC_SQL} SELECT doc_id, ord, ord::VARCHAR AS structure, title, physical_index FROM toc UNION ALL SELECT doc_id, 0, '0', 'Preface', 1 FROM toc WHERE ord = 1 AND physical_index > 1",
    "toc_page_runs": f"""WITH {ITEMS_SQL}, p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, l_quantity > 20 AS yes FROM items), r AS (SELECT *, count(*) FILTER (WHERE NOT yes) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM p),
s AS (SELECT doc_id, page, min(page) OVER (PARTITION BY doc_id, run) AS start FROM r WHERE yes), f AS (SELECT *, min(start) OVER (PARTITION BY doc_id) AS first FROM s WHERE start < 3) SELECT doc_id, page FROM f WHERE start = first""",
    "toc_offset_mode": f"""WITH {_TOC_SQL}, d AS (SELECT doc_id, physical_index - page AS offset_, count(*) AS n, min(ord) AS first FROM toc WHERE physical_index >= 3 GROUP BY ALL)
SELECT doc_id, arg_max(offset_, n * 1000000 - first) AS "offset" FROM d GROUP BY doc_id""",
    "toc_fill_missing": f"WITH {_TOC_SQL} SELECT doc_id, ord, coalesce(physical_index, ord * 3) AS physical_index FROM toc",
    "toc_neighbours": f"""WITH {_TOC_SQL} SELECT doc_id, ord, last_value(physical_index IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_index,
  first_value(physical_index IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_index FROM toc""",
    "toc_truncate": f"WITH {_TOC_SQL} SELECT doc_id, ord, CASE WHEN physical_index <= 20 THEN physical_index END AS physical_index FROM toc",
    "toc_accuracy": f"""WITH {_TOC_SQL}, s AS (SELECT doc_id, max(ord) * 3 AS n, arg_max(physical_index, ord) FILTER (WHERE physical_index IS NOT NULL) AS last, avg(CASE WHEN physical_index % 3 = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE physical_index IS NOT NULL) AS share FROM toc GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN last >= n / 2.0 THEN share ELSE 0 END, 6) AS accuracy FROM s""",
    "toc_repair": f"""WITH {_TOC_SQL}, k AS (SELECT doc_id, ord, physical_index AS was, CASE WHEN physical_index % 3 = 0 THEN physical_index END AS physical_index FROM toc)
SELECT doc_id, ord, coalesce(physical_index, ord * 3) AS physical_index FROM k""",
    "large_sections": f"""WITH {_TOC_SQL}, p AS (SELECT c_custkey AS doc_id, page, (page * 7 + c_custkey) % 200 AS n FROM customer, (SELECT unnest(range(1, 121)) AS page)),
s AS (SELECT toc.doc_id, ord, sum(n) AS tokens FROM toc JOIN p ON p.doc_id = toc.doc_id AND p.page BETWEEN physical_index AND physical_index + ord * 2 WHERE ord * 2 > 10 AND physical_index + ord * 2 <= 120 GROUP BY ALL) SELECT * FROM s WHERE tokens >= 1024""",
    "chunk_lines": """WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
f(doc_id, i, first, size, done) AS (
  SELECT doc_id, 0, 0, 0, NULL::INTEGER[] FROM d UNION ALL
  SELECT f.doc_id, i + 1, CASE WHEN over THEN i - kept ELSE first END, CASE WHEN over THEN coalesce(list_sum(list_transform(ls[i - kept + 1 : i], lambda x: length(x) + 1)), 0) + own ELSE size + own + 1 END, CASE WHEN over THEN [first, i - 1] END
  FROM (SELECT f.*, d.ls, length(d.ls[i + 1]) AS own, i > first AND size + length(d.ls[i + 1]) > 1000 AS over,
      (SELECT coalesce(max(k), 0) FROM (SELECT unnest(range(1, least(i - first, 150) + 1)) AS k) WHERE list_sum(list_transform(d.ls[i - k + 1 : i], lambda x: length(x) + 1)) - 1 < 150) AS kept
    FROM f JOIN d ON d.doc_id = f.doc_id WHERE i < len(d.ls)) f),
c AS (SELECT doc_id, done[1] AS a, done[2] AS b FROM f WHERE done IS NOT NULL UNION ALL SELECT f.doc_id, first, i - 1 FROM f JOIN d ON d.doc_id = f.doc_id WHERE i = len(ls))
SELECT c.doc_id, (row_number() OVER (PARTITION BY c.doc_id ORDER BY b) - 1)::INTEGER AS chunk, array_to_string(ls[a + 1 : b + 1], chr(10)) AS text, a + 1 AS line_num, b + 1 AS end_line_num FROM c JOIN d ON d.doc_id = c.doc_id""",
    "trust_decisions": f"""WITH {ITEMS_SQL}, c AS (SELECT l_orderkey AS doc_id, l_linenumber AS chunk_id, trunc(l_quantity)::INTEGER AS q FROM items),
m AS (SELECT *, chunk_id < 6 AS told, (['KEEP', 'MERGE_PREVIOUS', 'MARK_NOISE', 'REVIEW', 'KEEP', 'REVIEW'])[q % 6 + 1] AS d, (['HEADING', 'BODY', 'TITLE', 'NOISE'])[q % 4 + 1] AS r FROM c),
n AS (SELECT doc_id, chunk_id, q, CASE WHEN told THEN d ELSE 'REVIEW' END AS d, CASE WHEN told THEN r ELSE 'REVIEW' END AS role, CASE WHEN NOT told THEN 3 WHEN r = 'TITLE' THEN 1 WHEN r = 'NOISE' THEN 0 ELSE greatest(1, least(4, chunk_id)) END AS level, told AND r IN ('HEADING', 'TITLE') AS is_node FROM m),
v AS (SELECT *, CASE WHEN d = 'KEEP' THEN 'accept' WHEN d = 'MERGE_PREVIOUS' THEN CASE WHEN q % 3 = 0 OR q % 5 = 0 THEN 'reject' ELSE 'accept' END ELSE 'flag_review' END AS trust FROM n)
SELECT doc_id, chunk_id, role, trust, CASE trust WHEN 'accept' THEN d WHEN 'reject' THEN 'KEEP' ELSE 'REVIEW' END AS final_decision, CASE WHEN role = 'HEADING' AND q % 3 = 0 THEN q % 4 + 1 ELSE level END AS final_level, trust <> 'flag_review' AS applied, is_node FROM v""",
}

_HARD = f"({text_queries._GARBAGE} OR {text_queries._MARKED} OR {text_queries._SPACED_TITLE})"
SQL |= {
    "tree_thinning": f"""WITH {_KEPT_TREE_SQL}, o AS (SELECT *, CASE level WHEN 1 THEN NULL WHEN 2 THEN own ELSE up END AS article FROM nodes),
z AS (SELECT *, sum(length(title)) OVER (PARTITION BY doc_id) AS whole, sum(length(title)) OVER (PARTITION BY doc_id, article) AS part FROM o),
h AS (SELECT *, CASE WHEN whole < 60 THEN 'c' WHEN level > 1 AND part < 60 THEN article ELSE own END AS host FROM z) SELECT doc_id, host AS own, string_agg(title, chr(10) || chr(10) ORDER BY ord) AS text FROM h GROUP BY doc_id, host""",
    "sentence_segments": rf"""WITH RECURSIVE {text_queries.PREPARED_SQL},
g AS MATERIALIZED (SELECT doc_id, line_id, s, {_HARD} AS hard, regexp_matches(s, '[.!?…;]$') AS ends, length(s) AS own FROM prepared),
f(doc_id, line_id, seg, n, size, shut) AS (
  SELECT doc_id, line_id, 1, 1, own::BIGINT, hard OR ends OR own >= 1200 FROM g WHERE line_id = 1 UNION ALL
  SELECT doc_id, l, seg + x::INTEGER, CASE WHEN x THEN 1 ELSE n + 1 END, CASE WHEN x THEN own ELSE size + own + 1 END, hard OR ends OR (CASE WHEN x THEN 1 ELSE n + 1 END) >= 8 OR (CASE WHEN x THEN own ELSE size + own + 1 END) >= 1200
  FROM (SELECT f.*, g.own, g.hard, g.ends, f.shut OR g.hard AS x, g.line_id AS l FROM f JOIN g ON g.doc_id = f.doc_id AND g.line_id = f.line_id + 1) q),
t AS (SELECT doc_id, seg, string_agg(g.s, chr(10) ORDER BY line_id) AS text, arg_min(g.s, line_id) AS s, min(line_id) AS start_line, max(line_id) AS end_line, count(*) AS n FROM f JOIN g USING (doc_id, line_id) GROUP BY doc_id, seg),
k AS (SELECT *, CASE WHEN {text_queries._SPACED_TITLE} THEN 'STRUCTURAL_TITLE' WHEN {text_queries._MARKED} THEN 'STRUCTURAL_UNIT' END AS fixed, {text_queries._LOWER} OR NOT regexp_matches(s, '[.!?…:]$') AS goes_on FROM t),
b AS (SELECT *, lag(coalesce(fixed, 'LINE')) OVER (PARTITION BY doc_id ORDER BY seg) AS before FROM k)
SELECT doc_id, seg AS segment_id, text, coalesce(fixed, CASE WHEN before IN ('STRUCTURAL_UNIT', 'LINE') AND goes_on THEN 'BODY_CONTINUATION' WHEN n = 1 THEN 'LINE' ELSE 'PARAGRAPH_OR_SENTENCE' END) AS kind, start_line, end_line FROM b""",
}

_GOES_ON = rf"({text_queries._LOWER} OR regexp_matches(s, '(?i)^\d{{1,2}}\s+(ngày|tháng|năm)') OR (length(s) <= 35 AND NOT {text_queries._ANY} AND NOT regexp_matches(s, '[.!?;:]$')))"
_INVITES = rf"CASE WHEN regexp_matches(s, '[,;\-–]$') THEN true WHEN s LIKE '%:' THEN false ELSE NOT regexp_matches(s, '[.!?…]$') AND {text_queries._WORDS} >= 6 AND NOT {text_queries._TITLE} END"
_NOISE = rf"(s = '' OR ({text_queries._PLAIN} <= 1 AND length(s) <= 8) OR regexp_matches(s, '(?i)^={{2,}}\s*PAGE\s+\d+') OR regexp_matches(s, '^\d+\s*$'))"
#: Every line of the outline is a block, as each has a marker of its own or is noise.
_ROLES_SQL = _SHALLOW_SQL + r""",
b AS (SELECT doc_id, line_num AS block_id, regexp_replace(line, '^#+ ', '') AS s FROM shallow), ro AS (
  SELECT doc_id, block_id, s, CASE WHEN s = '```' THEN 'NOISE' WHEN regexp_matches(s, '^(CHƯƠNG|Điều|\d|[c]\))') THEN 'MAIN_CONTENT_UNIT' ELSE 'SUB_CONTENT_UNIT' END AS role,
    CASE WHEN s LIKE 'CHƯƠNG%' THEN 1 WHEN s LIKE 'Điều%' THEN 2 WHEN regexp_matches(s, '^\d') THEN 3 ELSE 4 END AS level FROM b)"""
SQL |= {
    "text_blocks": rf"""WITH RECURSIVE {text_queries.PREPARED_SQL},
j AS (SELECT doc_id, line_id, s, {text_queries._TITLE} OR {text_queries._ANY} AS own_, {_GOES_ON} AS goes_on, {_INVITES} AS invites, {_NOISE} AS noise FROM prepared),
g AS MATERIALIZED (SELECT doc_id, line_id, s, noise, length(s) AS own, noise OR coalesce(own_ OR NOT (goes_on OR lag(invites) OVER (PARTITION BY doc_id ORDER BY line_id)), true) AS start FROM j),
f(doc_id, line_id, seg, n, size, shut) AS (
  SELECT doc_id, line_id, 1, 1, own::BIGINT, noise FROM g WHERE line_id = 1 UNION ALL
  SELECT doc_id, l, seg + x::INTEGER, CASE WHEN x THEN 1 ELSE n + 1 END, CASE WHEN x THEN own ELSE size + own + 1 END, noise
  FROM (SELECT f.*, g.own, g.noise, f.shut OR g.start OR f.n >= 12 OR f.size + g.own > 2200 AS x, g.line_id AS l FROM f JOIN g ON g.doc_id = f.doc_id AND g.line_id = f.line_id + 1) q),
t AS (SELECT doc_id, seg, string_agg(g.s, chr(10) ORDER BY line_id) AS text, arg_min(g.s, line_id) AS first_line, min(line_id) AS start_line, max(line_id) AS end_line, count(*) AS line_count FROM f JOIN g USING (doc_id, line_id) GROUP BY doc_id, seg)
SELECT doc_id, seg AS block_id, text, first_line, start_line, end_line, line_count, length(text) AS char_count FROM t""",
    "page_parts": """WITH RECURSIVE p AS (SELECT coalesce(source, '?') || '/' || (doc_id // 50) AS doc, doc_id AS page, text, ceil(length(text) / 4.0)::BIGINT AS n FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc, sum(n) AS total, list(n ORDER BY page) AS ns, list(page ORDER BY page) AS ps, list(length(text) ORDER BY page) AS ls FROM p GROUP BY doc),
e AS MATERIALIZED (SELECT *, CASE WHEN total > 2000 THEN ceil((total / ceil(total / 2000.0) + 2000) / 2) ELSE 1e18 END AS target FROM d),
f(doc, i, first, size, k, done) AS (
  SELECT doc, 0, 0, 0::BIGINT, 0, NULL::INTEGER[] FROM e UNION ALL
  SELECT doc, i + 1, CASE WHEN over THEN greatest(i - 1, 0) ELSE first END, CASE WHEN NOT over THEN size WHEN i > 0 THEN ns[i] ELSE 0 END + own, k + over::INTEGER, CASE WHEN over THEN [k, first, i - 1] END
  FROM (SELECT f.*, e.ns, e.ns[f.i + 1] AS own, f.size + e.ns[f.i + 1] > e.target AS over FROM f JOIN e ON e.doc = f.doc WHERE f.i < len(e.ns)) q),
c AS (SELECT doc, done[1] AS k, done[2] AS a, done[3] AS b FROM f WHERE done IS NOT NULL UNION ALL SELECT f.doc, f.k, f.first, f.i - 1 FROM f JOIN e ON e.doc = f.doc WHERE f.i = len(ns))
SELECT c.doc AS doc_id, k AS part, ps[a + 1] AS first_page, ps[b + 1] AS last_page, list_sum(ls[a + 1 : b + 1]) AS chars FROM c JOIN e ON e.doc = c.doc WHERE a <= b""",
    "block_roles": f"WITH {_ROLES_SQL} SELECT doc_id, block_id, role, CASE role WHEN 'SUB_CONTENT_UNIT' THEN 'SUB' ELSE 'MAIN' END AS rough_level, level FROM ro WHERE role <> 'NOISE'",
    "outline_nodes": f"""WITH {_ROLES_SQL} SELECT doc_id, block_id, level, CASE level WHEN 2 THEN max(block_id) FILTER (WHERE level < 2) OVER w WHEN 3 THEN max(block_id) FILTER (WHERE level < 3) OVER w WHEN 4 THEN max(block_id) FILTER (WHERE level < 4) OVER w END AS parent_block_id
FROM ro WHERE role <> 'NOISE' WINDOW w AS (PARTITION BY doc_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "sections": f"""WITH {_ROLES_SQL}, a AS (SELECT doc_id, block_id, CASE WHEN s LIKE 'CHƯƠNG%' THEN 'MAJOR_STRUCTURAL' WHEN s LIKE 'Điều%' OR regexp_matches(s, '^[0-9]') THEN 'MAIN_UNIT' ELSE '' END AS anchor FROM ro),
g AS (SELECT *, count(*) FILTER (WHERE anchor <> '') OVER (PARTITION BY doc_id ORDER BY block_id) AS section_id FROM a) SELECT doc_id, section_id, min(block_id) AS first_block, count(*) AS n_blocks, arg_min(anchor, block_id) AS anchor FROM g GROUP BY doc_id, section_id""",
}
