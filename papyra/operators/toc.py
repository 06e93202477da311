"""Tables of contents: pages, offsets, missing numbers, accuracy, large sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .lines import in_order, running
from .tree import page_spans, span_texts, with_preface

TOC_SCAN_PAGES, NODE_PAGES, NODE_TOKENS, TOKEN_LIMIT = 20, 10, 1024, 110_000


def toc_pages(pages: DataFrame, scan: int = TOC_SCAN_PAGES) -> DataFrame:
    """The first run of pages (doc_id, page from 0, is_toc) with a table of contents.

    The scan ends at page ``scan`` unless the run goes on there."""
    rows = pages.withColumn("run", F.sum((~F.col("is_toc")).cast("int")).over(running("page"))).where("is_toc")
    runs = rows.withColumn("start", F.min("page").over(Window.partitionBy("doc_id", "run"))).where(F.col("start") < scan)
    first = F.min("start").over(Window.partitionBy("doc_id"))
    return runs.withColumn("_first", first).where("start = _first").select("doc_id", "page")


def page_pairs(listed: DataFrame, found: DataFrame, start: Column | int) -> DataFrame:
    """(doc_id, ord, title, page, physical_index): equal titles of the listed (doc_id,
    title, page) and the found entries (doc_id, ord, title, physical_index)."""
    return found.where(F.col("physical_index") >= start).join(listed.select("doc_id", "title", "page"), ["doc_id", "title"]).select("doc_id", "ord", "title", "page", "physical_index")


def page_offsets(pairs: DataFrame) -> DataFrame:
    """(doc_id, offset): the most frequent difference, of equals the one seen first."""
    known = pairs.where("page is not null and physical_index is not null").withColumn("offset", F.col("physical_index") - F.col("page"))
    counts = known.groupBy("doc_id", "offset").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counts.groupBy("doc_id").agg(F.max_by("offset", F.struct(F.col("n"), -F.col("first"))).alias("offset"))


def apply_offset(items: DataFrame, offsets: DataFrame) -> DataFrame:
    """``items`` with physical_index = page + the document's offset where both are known."""
    shifted = items.join(offsets, "doc_id", "left")
    return shifted.withColumn("physical_index", F.coalesce(F.col("page") + F.col("offset"), F.col("physical_index"))).drop("offset")


def known_neighbours(items: DataFrame) -> DataFrame:
    """``items`` with prev_index and next_index: the nearest known pages around each."""
    before = in_order("ord").rowsBetween(Window.unboundedPreceding, -1)
    after = in_order("ord").rowsBetween(1, Window.unboundedFollowing)
    return items.withColumn("prev_index", F.last("physical_index", ignorenulls=True).over(before)).withColumn("next_index", F.first("physical_index", ignorenulls=True).over(after))


def fill_missing(items: DataFrame, pages: DataFrame) -> DataFrame:
    """``items`` (doc_id, ord, title, physical_index) with missing pages found: the first
    page between the known neighbours whose text holds the title, white space aside."""
    gaps = known_neighbours(items).where("physical_index is null")
    ends = pages.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    gaps = gaps.join(ends, "doc_id").withColumn("page", F.explode(F.sequence(F.coalesce("prev_index", F.lit(1)), F.greatest(F.coalesce("next_index", "last_page"), F.coalesce("prev_index", F.lit(1))))))
    squeezed = [F.lower(F.regexp_replace(c, r"(?U)\s+", "")) for c in ("text", "title")]
    found = gaps.join(pages.select("doc_id", "page", "text"), ["doc_id", "page"]).where(F.contains(*squeezed)).groupBy("doc_id", "ord").agg(F.min("page").alias("_found"))
    return items.join(found, ["doc_id", "ord"], "left").withColumn("physical_index", F.coalesce("physical_index", "_found")).drop("_found")


def truncate_indices(items: DataFrame, n_pages: Column, start: int = 1) -> DataFrame:
    """Pages beyond the document's end become null."""
    return items.withColumn("physical_index", F.when(F.col("physical_index") <= n_pages + (start - 1), F.col("physical_index")))


def title_on_page(title: Column, text: Column, at_start: bool = False) -> Column:
    """Whether a page shows a title (opens with it), white space and case aside: the
    offline stand-in for a model's judgement."""
    a, b = (F.lower(F.regexp_replace(c, r"(?U)\s+", "")) for c in (title, text))
    return (a != "") & (F.startswith(b, a) if at_start else F.contains(b, a))


def toc_accuracy(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, accuracy): share of entries with a page whose title is on it; 0 if the
    last known page lies in the document's first half."""
    size = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    last = items.where("physical_index is not null").groupBy("doc_id").agg(F.max_by("physical_index", "ord").alias("last"))
    checked = items.where("physical_index is not null").join(pages.select("doc_id", F.col("page").alias("physical_index"), "text"), ["doc_id", "physical_index"], "left")
    share = checked.groupBy("doc_id").agg(F.avg(F.coalesce(title_on_page(F.col("title"), F.col("text")), F.lit(False)).cast("int")).alias("share"))
    out = size.join(last, "doc_id", "left").join(share, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("last") >= F.col("n") / 2, F.col("share")).otherwise(0.0).alias("accuracy"))


def repair_entries(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries whose title is not on their page get the page that fill_missing() finds
    between their nearest right neighbours; without one they stay as they are."""
    judged = items.join(pages.select("doc_id", F.col("page").alias("physical_index"), "text"), ["doc_id", "physical_index"], "left")
    right = F.coalesce(title_on_page(F.col("title"), F.col("text")), F.lit(False))
    cleared = judged.select("doc_id", "ord", "title", F.col("physical_index").alias("_was"), F.when(right, F.col("physical_index")).alias("physical_index"))
    return fill_missing(cleared, pages).withColumn("physical_index", F.coalesce("physical_index", "_was")).drop("_was")


def large_sections(spans: DataFrame, pages: DataFrame, most_pages: int = NODE_PAGES, least_tokens: int = NODE_TOKENS) -> DataFrame:
    """Spans (doc_id, ord, start_index, end_index) of more than ``most_pages`` pages and at
    least ``least_tokens`` tokens, which are to be split; token sums from running totals.

    Pages are far more rows than a plan can tell where they come out of an array, so
    both joins are by sorting: the pages are never sent whole to every task."""
    run = pages.select("doc_id", "page", F.sum("token_len").over(running("page")).alias("run"), "token_len")
    start = run.select("doc_id", F.col("page").alias("start_index"), (F.col("run") - F.col("token_len")).alias("before"))
    end = run.select("doc_id", F.col("page").alias("end_index"), F.col("run").alias("upto"))
    wide = spans.where(F.col("end_index") - F.col("start_index") > most_pages)
    return wide.join(start.hint("merge"), ["doc_id", "start_index"]).join(end.hint("merge"), ["doc_id", "end_index"]).withColumn("tokens", F.col("upto") - F.col("before")).where(F.col("tokens") >= least_tokens).drop("before", "upto")


def over_token_limit(nodes: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    return nodes.where(F.col("token_len") > limit)


def approximate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up: stands in for a model's own counter."""
    return F.ceil(F.length(text) / 4).cast("long")


def clean_toc(c: Column) -> Column:
    return t.dot_leaders(c)


ACCEPT_ACCURACY, REPAIR_ACCURACY, REPAIR_ROUNDS = 1.0, 0.6, 3


def _settled(modes: list[DataFrame], pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries of each document's chosen mode, those that are right already and those to
    repair.  All modes are judged at once, so that entries meet their pages once."""
    every = reduce(DataFrame.unionByName, (m.select("doc_id", "ord", "title", "physical_index").withColumn("mode", F.lit(k)) for k, m in enumerate(modes)))
    ends = pages.groupBy("doc_id").agg(F.max("page").alias("_last"), F.count("*").alias("_n"))
    items = truncate_indices(every.join(ends, "doc_id"), F.col("_last")).where("physical_index is not null")
    shown = items.join(pages.select("doc_id", F.col("page").alias("physical_index"), F.col("text").alias("_text")), ["doc_id", "physical_index"], "left")
    right = F.coalesce(title_on_page(F.col("title"), F.col("_text")), F.lit(False)).cast("int")
    own = Window.partitionBy("doc_id", "mode")
    judged = shown.select(*items.columns, right.alias("_right")).repartition("doc_id")
    judged = judged.withColumn("_share", F.when(F.max_by("physical_index", "ord").over(own) >= F.col("_n") / 2, F.avg("_right").over(own)).otherwise(0.0))
    best = F.min(F.when(F.col("_share") > REPAIR_ACCURACY, F.col("mode"))).over(Window.partitionBy("doc_id"))
    chosen = judged.withColumn("_best", best).where("mode = _best").select("doc_id", "mode", "ord", "title", "physical_index", "_share")
    return chosen.where(F.col("_share") >= ACCEPT_ACCURACY).drop("_share"), chosen.where(F.col("_share") < ACCEPT_ACCURACY).drop("_share")


def settled_toc(modes: list[DataFrame], pages: DataFrame) -> DataFrame:
    """(doc_id, mode, ord, title, physical_index): each document's entries from the first of
    ``modes`` (tables doc_id, ord, title, physical_index, best first) that holds.

    Entries beyond the document's pages (doc_id, page, text) lose their page and
    go, as do those without one.  A mode holds for a document if all its entries
    are right; above 0.6 it holds once its wrong entries are repaired, three
    rounds at most; else the next mode is tried.  Documents for which no mode
    holds are left out."""
    right, wrong = _settled(modes, pages)
    mended = wrong
    for _ in range(REPAIR_ROUNDS):
        mended = repair_entries(mended, pages)
    # a document has one mode left, so what was mended finds its own again by the document
    mended = mended.join(wrong.select("doc_id", "mode").distinct(), "doc_id")
    return right.unionByName(mended.select(right.columns)).select("doc_id", "mode", "ord", "title", "physical_index")


def page_index(modes: list[DataFrame], pages: DataFrame) -> DataFrame:
    """(doc_id, ord, title, start_index, end_index, text): the sections of each document's
    settled contents, with a Preface where the first one starts after page 1."""
    toc = settled_toc(modes, pages).withColumn("structure", F.lit(None).cast("string"))
    items = with_preface(toc).join(pages.groupBy("doc_id").agg(F.max("page").alias("_last")), "doc_id")
    shown = items.join(pages.select("doc_id", F.col("page").alias("physical_index"), F.col("text").alias("_text")), ["doc_id", "physical_index"], "left")
    shown = shown.withColumn("appear_start", F.when(title_on_page(F.col("title"), F.col("_text"), True), "yes").otherwise("no"))
    return span_texts(page_spans(shown, F.col("_last")).select("doc_id", "ord", "title", "start_index", "end_index"), pages)
