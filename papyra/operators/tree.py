"""Heading trees as flat tables: (doc_id, ord, level, title, line_num, parent_ord).

Parents, subtree ends and outlines are windows over a document's headings; no
recursion and no nested structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from .lines import explode_lines, in_order, ordered_text, running, with_fences

MAX_LEVEL = 6
OUTLINE_CHARS, OUTLINE_DEPTHS, TITLE_CHARS = 24_000, (5, 4, 3, 2, 1), 150
OPEN_ENDED_LINES = 20


def headings(lines: DataFrame) -> DataFrame:
    """(doc_id, ord, level, title, line_num) of the headings outside code fences.

    An indented heading is none: its text stays in the node before it."""
    rows = with_fences(lines).where("not in_fence and not is_fence")
    found = rows.where(F.col("line").rlike(r"^#{1,6}\s+.+"))
    found = found.select("doc_id", "line_num", F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1)).alias("level"), t.strip(F.regexp_extract("line", r"^#{1,6}\s+(.+)", 1)).alias("title"))
    return found.withColumn("ord", F.row_number().over(in_order("line_num")))


def node_texts(lines: DataFrame) -> DataFrame:
    """headings() with ``text``: from the heading to the line before the next one of any level."""
    nodes = headings(lines)
    marked = lines.join(nodes, ["doc_id", "line_num"], "left")
    marked = marked.withColumn("node", F.last("ord", ignorenulls=True).over(running("line_num"))).where("node is not null")
    texts = marked.groupBy("doc_id", F.col("node").alias("ord")).agg(t.strip(ordered_text(F.col("line"), F.col("line_num"))).alias("text"))
    return nodes.join(texts, ["doc_id", "ord"])


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent_ord``: the nearest node before it of a smaller level."""
    before = in_order("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("ord"))).over(before) for k in range(1, MAX_LEVEL)]
    numbered = nodes.select("*", *(c.alias(f"_last{k}") for k, c in enumerate(last, 1)))
    # Of the levels above this one, the one seen last.
    above = F.greatest(*(F.when(F.col("level") > k, F.col(f"_last{k}")) for k in range(1, MAX_LEVEL)), F.lit(None).cast("int"))
    return numbered.withColumn("parent_ord", above).drop(*(f"_last{k}" for k in range(1, MAX_LEVEL)))


def with_node_ids(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``node_id``: four digits at least, from 0000 in document order."""
    return nodes.withColumn("node_id", F.format_string("%04d", F.row_number().over(in_order("ord")) - 1))


def with_subtree_end(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``last_ord``, the last node of each one's subtree."""
    after = in_order("ord").rowsBetween(1, Window.unboundedFollowing)
    first = [F.min(F.when(F.col("level") <= k, F.col("ord"))).over(after) for k in range(1, MAX_LEVEL + 1)]
    numbered = nodes.select("*", *(c.alias(f"_next{k}") for k, c in enumerate(first, 1)), F.max("ord").over(Window.partitionBy("doc_id")).alias("_last"))
    next_ = F.coalesce(*(F.when(F.col("level") == k, F.col(f"_next{k}")) for k in range(1, MAX_LEVEL + 1)))
    return numbered.withColumn("last_ord", F.coalesce(next_ - 1, "_last")).drop("_last", *(f"_next{k}" for k in range(1, MAX_LEVEL + 1)))


def with_subtree_sum(nodes: DataFrame, value: str, out: str) -> DataFrame:
    """``nodes`` with ``value`` summed over each subtree, from running sums at its two ends."""
    summed = with_subtree_end(nodes).withColumn("_run", F.sum(value).over(running("ord")))
    ends = summed.select("doc_id", F.col("ord").alias("last_ord"), F.col("_run").alias("_end"))
    return summed.join(ends, ["doc_id", "last_ord"]).withColumn(out, F.col("_end") - F.col("_run") + F.col(value)).drop("_run", "_end")


def with_depth(nodes: DataFrame) -> DataFrame:
    """``nodes`` (with parents) with ``depth`` from 0: how many nodes stand above.

    A node is above another if it is the last of its level so far and no later
    one of a smaller level came between, so depth counts rising last places."""
    upto = in_order("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = nodes.select("*", *(F.max(F.when(F.col("level") == k, F.col("ord"))).over(upto).alias(f"_last{k}") for k in range(1, MAX_LEVEL)))
    depth = F.lit(0)
    for k in range(1, MAX_LEVEL):
        lower = [F.coalesce(F.col(f"_last{j}"), F.lit(0)) for j in range(1, k)]
        open_ = (F.col("level") > k) & F.col(f"_last{k}").isNotNull()
        if lower:
            open_ = open_ & (F.col(f"_last{k}") > (F.greatest(*lower) if len(lower) > 1 else lower[0]))
        depth = depth + F.when(open_, 1).otherwise(0)
    return last.withColumn("depth", depth).drop(*(f"_last{k}" for k in range(1, MAX_LEVEL)))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    return nodes.join(nodes.select("doc_id", F.col("parent_ord").alias("ord")).where("ord is not null").distinct(), ["doc_id", "ord"], "left_anti")


def markdown_tree(docs: DataFrame) -> DataFrame:
    """Documents' markdown to nodes: ids, parents, depths, texts."""
    return with_depth(with_node_ids(with_parents(node_texts(explode_lines(docs)))))


def dotted_parents(items: DataFrame) -> DataFrame:
    """``items`` (doc_id, ord, code like 1.2.3) with ``parent_ord``: the latest earlier
    row of the code without its last part; null makes a root."""
    parent = F.when(F.col("code").contains("."), F.regexp_replace("code", r"\.[^.]*$", ""))
    up = items.select("doc_id", F.col("code").alias("parent_code"), F.col("ord").alias("up"))
    asked = items.withColumn("parent_code", parent)
    found = asked.join(up, ["doc_id", "parent_code"]).where("up < ord").groupBy("doc_id", "ord").agg(F.max("up").alias("parent_ord"))
    return asked.drop("parent_code").join(found, ["doc_id", "ord"], "left")


def page_spans(items: DataFrame, last_page: Column) -> DataFrame:
    """``items`` (doc_id, ord, physical_index, appear_start) with start_index and
    end_index; a section that opens its page ends the one before on the page before."""
    w = in_order("ord")
    next_, opens = F.lead("physical_index").over(w), F.lead("appear_start").over(w)
    # the last item runs to the document's end
    end = F.when(F.lead("ord").over(w).isNull(), last_page).when(opens == "yes", next_ - 1).otherwise(next_)
    return items.withColumn("start_index", F.col("physical_index")).withColumn("end_index", end)


def with_preface(items: DataFrame) -> DataFrame:
    """``items`` (doc_id, ord, structure, title, physical_index) with a Preface on page 1
    for each document whose first item starts later."""
    first = items.groupBy("doc_id").agg(F.min_by("physical_index", "ord").alias("first"), F.min("ord").alias("o")).where("first > 1")
    preface = first.select("doc_id", (F.col("o") - 1).alias("ord"), F.lit("0").alias("structure"), F.lit("Preface").alias("title"), F.lit(1).alias("physical_index"))
    return items.select("doc_id", "ord", "structure", "title", "physical_index").unionByName(preface)


def span_texts(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """``spans`` (doc_id, ord, start_index, end_index) with the text of their pages.

    A span is exploded to its pages, so the join is on equal keys."""
    wide = spans.withColumn("page", F.explode_outer(F.sequence("start_index", F.greatest("start_index", "end_index"))))
    found = wide.join(pages.select("doc_id", "page", "text", F.lit(True).alias("_found")), ["doc_id", "page"], "left")
    page = F.when(F.col("_found"), F.struct(F.col("page").alias("o"), F.col("text").alias("l")))
    texts = found.groupBy(spans.columns).agg(F.sort_array(F.collect_list(page)).alias("_texts"))
    # a span without a single page has no text; one with pages without text has an empty one
    return texts.select(*spans.columns, F.when(F.size("_texts") > 0, F.array_join("_texts.l", "")).alias("text"))


def line_bounds(nodes: DataFrame) -> DataFrame:
    """``nodes`` with start_line and end_line: the line before the next distinct heading line."""
    # backwards, so that the frame of later lines only grows
    later = Window.partitionBy("doc_id").orderBy(F.desc("line_num")).rangeBetween(Window.unboundedPreceding, -1)
    return nodes.where("doc_id is not null and line_num is not null").withColumn("end_line", F.min("line_num").over(later) - 1).withColumn("start_line", F.col("line_num"))


def context_of_nodes(asked: DataFrame, nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, context) of ``asked`` (doc_id, pick, node_id, filename): the nodes' lines
    under source tags, in the order asked for; an open end takes 20 lines.

    Lines join on the heading they stand under, which is an equal key."""
    bounds = line_bounds(with_node_ids(nodes)).select("doc_id", "node_id", "start_line", "end_line")
    rows = asked.join(bounds, ["doc_id", "node_id"])
    upto = F.coalesce("end_line", F.col("start_line") + OPEN_ENDED_LINES - 1)
    wide = rows.withColumn("line_num", F.explode(F.sequence("start_line", F.greatest(upto, F.col("start_line"))))).join(lines, ["doc_id", "line_num"])
    texts = wide.groupBy("doc_id", "pick", "filename", "start_line", "end_line").agg(t.strip(ordered_text(F.col("line"), F.col("line_num"))).alias("body"))
    tag = F.concat(F.lit("[Nguồn: "), F.col("filename"), F.lit(", Dòng: "), F.col("start_line").cast("string"), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("...")), F.lit("]\n"))
    return texts.groupBy("doc_id").agg(ordered_text(F.concat(tag, F.col("body")), F.col("pick"), "\n\n---\n\n").alias("context"))


def _clipped(c: Column) -> Column:
    return F.when(F.length(c) > TITLE_CHARS, F.concat(F.substring(c, 1, TITLE_CHARS), F.lit("..."))).otherwise(c)


def outlines(nodes: DataFrame, limit: int = OUTLINE_CHARS) -> DataFrame:
    """(doc_id, outline): the deepest indented outline that fits ``limit`` characters,
    first with summaries, then without, else the shallowest one cut off.

    ``nodes`` has node_id, title, depth, ord and summary (null: none)."""
    plain = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- ["), F.col("node_id"), F.lit("] "), _clipped(F.col("title")))
    told = t.strip(F.regexp_replace(F.coalesce("summary", F.lit("")), r"(?U)\s+", " "))
    full = F.when(told == "", plain).otherwise(F.concat(plain, F.lit(": "), _clipped(told)))
    rows = nodes.select("doc_id", "ord", "depth", plain.alias("p"), full.alias("f"))
    tries = [(kind, d) for kind in ("f", "p") for d in OUTLINE_DEPTHS]
    drafts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "depth", "p", "f"))).alias("rows"))

    def draft(kind: str, depth: int) -> Column:
        return F.array_join(F.transform(F.filter("rows", lambda r: r["depth"] <= depth), lambda r: r[kind]), "\n")

    fitting = [F.when(F.length(draft(k, d)) <= limit, draft(k, d)) for k, d in tries]
    cut = F.concat(F.substring(draft("p", OUTLINE_DEPTHS[-1]), 1, limit), F.lit("\n...[TRUNCATED Outline due to size limit]..."))
    return drafts.select("doc_id", F.coalesce(*fitting, cut).alias("outline"))


def top_headings(nodes: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, node_count, top_headings): the first titles of roots, comma separated."""
    roots = F.when(F.col("parent_ord").isNull() & (t.strip("title") != ""), F.struct(F.col("ord").alias("o"), t.strip("title").alias("x")))
    listed = F.slice(F.array_sort(F.collect_list(roots)), 1, most)
    return nodes.groupBy("doc_id").agg(F.count("*").alias("node_count"), F.array_join(F.transform(listed, lambda r: r["x"]), ", ").alias("top_headings"))


def nodes_in_pages(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Nodes whose line lies between the smallest and largest number asked for
    (doc_id, pages like ``3,8``), one a line."""
    wanted = asked.withColumn("n", t.page_numbers("pages")).select("doc_id", F.array_min("n").alias("lo"), F.array_max("n").alias("hi"))
    rows = nodes.join(wanted, "doc_id").where("line_num between lo and hi")
    first = F.row_number().over(Window.partitionBy("doc_id", "line_num").orderBy("ord"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n", "lo", "hi")


def pages_asked(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """The pages (doc_id, page, text) that a request (doc_id, pages like ``3,8``) names; others are ignored."""
    wanted = asked.select("doc_id", F.explode(t.page_numbers("pages")).alias("page")).distinct()
    return pages.join(wanted, ["doc_id", "page"], "left_semi")


def sibling_levels(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``fixed_level``: siblings that share a kind of marker, two or
    more, stand at the level of that kind."""
    kind = t.marker_kind("title")
    group = F.when(kind.isin("NUMBER", "ROMAN", "DECIMAL"), "NUMBER").when(kind.isin("LETTER", "ARTICLE"), kind)
    rows = nodes.withColumn("_g", group)
    n = F.count("_g").over(Window.partitionBy("doc_id", "parent_ord", "_g"))
    return rows.withColumn("fixed_level", F.when(F.col("_g").isNotNull() & (n >= 2), t.level_of_kind(F.col("_g"))).otherwise(F.col("level"))).drop("_g")


def node_fields(nodes: DataFrame, first: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """``nodes`` with the fields ``first`` in that order, then the others, but none of ``without``;
    inside struct columns and arrays of structs those are removed too."""
    gone = set(without or [])

    def pruned(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(c, lambda x: pruned(x, kind.elementType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(pruned(c[f.name], f.dataType).alias(f.name) for f in kind if f.name not in gone)))
        return c

    kinds = {f.name: f.dataType for f in nodes.schema if f.name not in gone}
    order = [n for n in first or [] if n in kinds]
    return nodes.select(*(pruned(F.col(n), kinds[n]).alias(n) for n in [*order, *(n for n in kinds if n not in order)]))
