"""Ordered line tables: (doc_id, line_num, line), one row a line.

Windows are per document, so a task holds one document's lines at most; lines
that belong together get an island number and are joined by an ordered list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

FENCE = "```"
MERGE_SCORE = 4
PAGE_MARK = r"(?i)^={2,}\s*PAGE\s+(\d+)\s*={2,}"


def in_order(*order: str, by: str = "doc_id"):
    return Window.partitionBy(by).orderBy(*order)


def running(*order: str, by: str = "doc_id"):
    """All rows of the document up to this one."""
    return in_order(*order, by=by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def judged(rows: DataFrame, value: Column, judge: Callable[[Column], list[Column]]) -> DataFrame:
    """``rows`` with the columns that ``judge`` makes of ``value``, which is known to be stripped.

    The value is computed once a row and named once inside an array, so rules that
    are put together neither multiply in the plan nor swell the generated code;
    a generator's output is not merged into what reads it."""
    made = F.transform(F.array(value), lambda x: F.struct(*judge(t.stripped(x))))
    return rows.select("*", F.explode(made).alias("_judged")).select(*(F.col(c) for c in rows.columns), "_judged.*")


def explode_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, line_num from 1, line) of every line; a null text has none, an empty one has one."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_num"), "line")


def ordered_text(line: Column, order: Column, joint: str = "\n") -> Column:
    """Aggregate: the rows' texts in order."""
    return F.array_join(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l")))).getField("l"), joint)


def kept_lines(lines: DataFrame) -> DataFrame:
    """Non-empty stripped lines with a dense ``line_id`` from 1."""
    kept = lines.withColumn("line", t.strip("line")).where("line != ''")
    return kept.withColumn("line_id", F.row_number().over(in_order("line_num")))


def prepare_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_id, text, page): spaced, repaired lines without noise; a page
    mark says on which page the lines after it are, letterheads are taken apart."""


    def parts(x: Column) -> list[Column]:
        mark = F.regexp_extract(x, PAGE_MARK, 1)
        repaired = F.transform(t.letterhead_parts(x), lambda y: t.rule_corrections(y))
        return [(x == "").alias("blank"), F.when(mark != "", mark.cast("int")).alias("mark"), F.filter(repaired, lambda y: ~t.is_garbage(t.stripped(y))).alias("parts")]

    paged = judged(lines.select("doc_id", "line_num", "line"), t.spacing("line"), parts).where("not blank")
    paged = paged.withColumn("page", F.last("mark", ignorenulls=True).over(running("line_num"))).where("mark is null")
    clean = paged.select("doc_id", "line_num", "page", F.posexplode("parts").alias("part", "text"))
    return clean.select("doc_id", F.row_number().over(in_order("line_num", "part")).alias("line_id"), "text", "page")


def merge_wrapped(lines: DataFrame, text: str = "text", order: str = "line_id") -> DataFrame:
    """(doc_id, line_id, text, page, source_line): visually wrapped lines joined.

    The score looks at a line's end only, so comparing neighbours gives the same
    islands as comparing with what was merged so far."""
    scored = judged(lines, t.spacing(text), lambda c: [(t.is_hard_structural(c) | (c == "")).alias("_hard"), t.joins_previous(c).alias("_own"), F.when(c != "", t.asks_for_next(c)).alias("_asks")])
    merges = ~F.col("_hard") & (F.lag("_asks").over(in_order(order)) + F.col("_own") >= MERGE_SCORE)
    islands = scored.withColumn("b", 1 - F.coalesce(merges, F.lit(False)).cast("int")).withColumn("island", F.sum("b").over(running(order)))
    page = F.min_by("page", order) if "page" in lines.columns else F.lit(None).cast("int")
    one = islands.groupBy("doc_id", "island").agg(ordered_text(F.col(text), F.col(order), " ").alias("raw"), F.min(order).alias("source_line"), page.alias("page"), F.count("*").alias("n"))
    merged = judged(one, F.when(F.col("n") == 1, F.col("raw")).otherwise(t.spacing("raw")), lambda x: [x.alias("text")])
    return merged.select("doc_id", F.col("island").cast("int").alias("line_id"), "text", "page", "source_line")


def final_cleanup(lines: DataFrame) -> DataFrame:
    """One text a document: noise out, wrapped lines merged, rules applied."""
    clean = judged(lines.where(t.strip("line") != ""), t.spacing("line"), lambda x: [x.alias("text"), t.is_garbage(x).alias("garbage")]).where("not garbage")
    merged = merge_wrapped(clean.select("doc_id", "line_num", "text"), order="line_num")
    ruled = judged(merged.select("doc_id", "line_id", F.col("text").alias("raw")), F.col("raw"), lambda x: [t.rule_corrections(x).alias("text")])
    joined = ruled.groupBy("doc_id").agg(ordered_text(F.col("text"), F.col("line_id")).alias("text"))
    return joined.withColumn("text", F.concat(t.strip(F.regexp_replace("text", r"[ \t]{2,}", " ")), F.lit("\n")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, para, level, text) of recognised pages: wrapped lines grouped, layout
    artefacts dropped, and headings marked by their first line."""
    split = explode_lines(docs.withColumn("text", t.split_midline_headings("text")))
    split = split.withColumn("line", t.strip("line"))
    split = split.withColumn("gap", (F.col("line") == "") | t.is_artifact("line"))
    # A gap ends a run: the first line of a run has no line before it.
    split = split.withColumn("run", F.sum(F.col("gap").cast("int")).over(running("line_num"))).where("not gap")
    before = F.lag("line").over(Window.partitionBy("doc_id", "run").orderBy("line_num"))
    start = F.when(before.isNull(), 1).otherwise(t.starts_paragraph(F.col("line"), before).cast("int"))
    islands = split.withColumn("start", start).withColumn("para", F.sum("start").over(running("line_num")).cast("int"))
    out = islands.groupBy("doc_id", "para").agg(ordered_text(F.col("line"), F.col("line_num"), " ").alias("body"), F.min_by("line", "line_num").alias("first"))
    level = t.page_heading_level("first")
    return out.select("doc_id", "para", level.alias("level"), F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("body"))).otherwise(F.col("body")).alias("text"))


def format_markdown(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the paragraphs of each document, a blank line between."""
    return paragraphs(docs).groupBy("doc_id").agg(ordered_text(F.col("text"), F.col("para"), "\n\n").alias("text"))


def with_fences(lines: DataFrame) -> DataFrame:
    """``lines`` with ``is_fence`` and ``in_fence`` (inside a code fence)."""
    fenced = lines.withColumn("is_fence", t.strip("line").startswith(FENCE))
    parity = F.sum(F.col("is_fence").cast("int")).over(running("line_num")) % 2
    return fenced.withColumn("in_fence", (parity == 1) & ~F.col("is_fence"))


def correct_heading_levels(lines: DataFrame) -> DataFrame:
    """``lines`` with headings of level 1 to 4 at the level that their marker asks
    for; a document's first heading that is a law's title becomes plain text.
    Fence lines stay as they are, and so do headings without a marker."""
    s = t.strip("line")
    pattern = r"^(#{1,4})\s+(.*)"
    body = t.strip(F.regexp_extract(s, pattern, 2))
    rows = lines.withColumn("is_heading", s.rlike(pattern) & ~s.startswith(FENCE)).withColumn("body", F.when(F.col("is_heading"), body))
    seen = F.coalesce(F.sum(F.col("is_heading").cast("int")).over(in_order("line_num").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = t.heading_level("body")
    fixed = F.when(~F.col("is_heading"), F.col("line")).when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("body")))
    fixed = fixed.when((F.col("seen") == 0) & t.is_document_title("body"), F.col("body")).otherwise(F.col("line"))
    return rows.withColumn("seen", seen).select("doc_id", "line_num", fixed.alias("line"))


def render_markdown(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, text) of ``lines`` (doc_id, line_id, text) with ``nodes`` (doc_id,
    line_id, level) as headings, a blank line before and after each."""
    rows = lines.join(nodes.select("doc_id", "line_id", "level"), ["doc_id", "line_id"], "left")
    rows = rows.withColumn("previous", F.lag("level").over(in_order("line_id"))).withColumn("before", F.lag("text").over(in_order("line_id")))
    gap = F.when(F.col("before").isNull() | F.col("previous").isNotNull() | (F.col("before") == ""), "").otherwise("\n")
    heading = F.concat(gap, F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"), F.lit("\n"))
    shown = rows.withColumn("out", F.when(F.col("level").isNull(), F.col("text")).otherwise(heading))
    return shown.groupBy("doc_id").agg(F.concat(F.regexp_replace(ordered_text(F.col("out"), F.col("line_id")), r"(?U)\s+$", ""), F.lit("\n")).alias("text"))


def cited_blocks(chunks: DataFrame) -> DataFrame:
    """``chunks`` (text, line_num, end_line_num, filename) with ``block``: the lines
    numbered, under a line that names the source."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("["), (F.col("line_num") + i).cast("string"), F.lit("] "), x))
    head = F.concat(F.lit("[Nguồn: "), F.col("filename"), F.lit(", Dòng: "), F.col("line_num").cast("string"), F.lit("-"), F.col("end_line_num").cast("string"), F.lit("]\n"))
    return chunks.withColumn("block", F.concat(head, F.array_join(numbered, "\n")))


def missing_lines(lines: DataFrame, rendered: DataFrame) -> DataFrame:
    """Lines (doc_id, line_id, text) that the rendered lines (doc_id, line) do not have."""
    plain = rendered.select("doc_id", t.strip(F.regexp_replace("line", r"^#{1,6}\s+", "")).alias("key")).where("key != ''").distinct()
    rows = lines.withColumn("key", t.strip("text")).where("key != ''")
    return rows.join(plain, ["doc_id", "key"], "left_anti").drop("key")


def loss_signal(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, line_id, status): whether a line of 12 characters or more is in its
    document's new text (doc_id, new_text) exactly, after folding, or not."""
    rows = judged(lines.withColumn("s", t.strip("text")).where(F.length("s") >= 12), F.col("s"), lambda x: [t.is_garbage(x).alias("garbage")]).where("not garbage").drop("garbage")
    new = texts.select("doc_id", "new_text", F.regexp_replace("new_text", r"(?U)\s+", " ").alias("compact"), t.compare_key("new_text").alias("key"))
    both = rows.join(new, "doc_id")
    exact = F.contains("new_text", "s") | F.contains(F.col("compact"), F.regexp_replace("s", r"(?U)\s+", " "))
    key = t.compare_key("s")
    status = F.when(exact, "EXACT_FOUND").when((key != "") & F.contains(F.col("key"), key), "FUZZY_FOUND").otherwise("MISSING")
    return both.select("doc_id", "line_id", status.alias("status"))
