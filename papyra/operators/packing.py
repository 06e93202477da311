"""Order-dependent packing: lines to chunks, segments, blocks, sections; pages to parts.

Whether a row starts or ends a group is an expression over it and its
neighbours; only the size caps need a fold, one small function that sees a
document's flags and lengths in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .lines import in_order, judged, ordered_text, running

CHUNK_CHARS, CHUNK_OVERLAP = 1000, 150
SEGMENT_LINES, SEGMENT_CHARS = 8, 1200
BLOCK_LINES, BLOCK_CHARS = 12, 2200
SECTION_BLOCKS, SECTION_CHARS = 28, 5000
PROMPT_BLOCKS, PROMPT_CHARS, CONTEXT_CHARS = 12, 1500, 100
PART_TOKENS = 20_000


def chunk_spans(lengths: list[int], most: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int]]:
    """First and last line (from 0) of each overlapping chunk of lines of these lengths.

    A chunk closes before the line that would exceed ``most``, the line breaks of
    its own lines included; the next one starts with the closing lines that fit
    in ``overlap``.  A line longer than ``most`` is a chunk's last line, uncut."""
    spans, first, size = [], 0, 0
    for i, n in enumerate(lengths):
        if i > first and size + n > most:
            spans.append((first, i - 1))
            back, shared = i, 0
            while back > first and shared + lengths[back - 1] < overlap:
                back -= 1
                shared += lengths[back] + 1
            # no break is counted after the line that opened this round
            first, size = back, shared + n
        else:
            size += n + 1
    spans.append((first, len(lengths) - 1))
    return spans


def chunk_lines(docs: DataFrame, most: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(doc_id, chunk, text, line_num, end_line_num) of documents (doc_id, text), lines
    counted from 1.  A narrow map over documents; null texts give no chunk."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame.doc_id, frame.text):
                lines = text.split("\n")
                for k, (a, b) in enumerate(chunk_spans([len(x) for x in lines], most, overlap)):
                    rows.append((doc_id, k, "\n".join(lines[a : b + 1]), a + 1, b + 1))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "text", "line_num", "end_line_num"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.where("text is not null").select("doc_id", "text").mapInPandas(pack, f"doc_id {kind}, chunk int, text string, line_num int, end_line_num int")


def _folded(rows: DataFrame, order: str, needs: list[Column], fold: Callable[..., list[int]]) -> DataFrame:
    """(doc_id, _rows, _groups): a document's rows in order as one array, of which only the
    lists of what ``fold`` ``needs`` leave the JVM, and the group numbers that it gives."""

    def number(*lists: pd.Series) -> pd.Series:
        return pd.Series([fold(*row) for row in zip(*lists)], dtype=object)

    names, kinds = [c for c in rows.columns if c not in ("doc_id", order)], [f"_need{i}" for i in range(len(needs))]
    packed = F.struct(F.col(order), *names, *(c.alias(k) for c, k in zip(needs, kinds)))
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(packed)).alias("_rows"))
    return docs.withColumn("_groups", F.pandas_udf(number, "array<int>")(*(F.col(f"_rows.{k}") for k in kinds)))


def _grouped(rows: DataFrame, order: str, needs: list[Column], fold: Callable[..., list[int]], out: str) -> DataFrame:
    """``rows`` with ``out``, the group numbers from 1 that ``fold`` gives a document's
    rows in order, from the lists of what it ``needs`` of them."""
    numbered = _folded(rows, order, needs, fold).select("doc_id", F.explode(F.arrays_zip("_rows", "_groups")).alias("_z"))
    return numbered.select("doc_id", *(F.col(f"_z._rows.`{c}`").alias(c) for c in rows.columns if c != "doc_id"), F.col("_z._groups").alias(out))


def _joined(lines: DataFrame, needs: list[Column], fold: Callable[..., list[int]], out: str) -> DataFrame:
    """(doc_id, ``out``, text, first, start_line, end_line, n) of lines (doc_id, line_id, text)
    in groups of consecutive ones, numbered by ``fold``.

    A group is a slice of its document's array, so lines are put together in one pass
    over documents and never aggregated by group."""
    docs = _folded(lines, "line_id", needs, fold)
    starts = F.filter(F.transform("_groups", lambda g, i: F.when((i == 0) | (g != F.get("_groups", i - 1)), i)), lambda i: i.isNotNull())
    spans = docs.withColumn("_starts", starts).withColumn("_ends", F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(F.size("_groups"))))
    each = spans.select("doc_id", "_rows", F.posexplode(F.arrays_zip("_starts", "_ends")).alias("_k", "_z"))
    part = each.select("doc_id", (F.col("_k") + 1).alias(out), F.slice("_rows", F.col("_z._starts") + 1, F.col("_z._ends") - F.col("_z._starts")).alias("_part"))
    return part.select(
        "doc_id", out, F.array_join("_part.text", "\n").alias("text"), F.get("_part", F.lit(0))["text"].alias("first"), F.get("_part", F.lit(0))["line_id"].alias("start_line"),
        F.element_at("_part", -1)["line_id"].alias("end_line"), F.size("_part").cast("long").alias("n"),
    )


def capped(starts: list[bool], ends: list[bool], sizes: list[int], most_rows: int, most_size: int, joint: int = 0, after: bool = False) -> list[int]:
    """Group numbers of rows: a start opens a group, an end closes it, and so do the caps.

    ``after`` closes a group once it has reached a cap, otherwise it closes
    before the row that would exceed one."""
    out, group, n, size = [], 0, 0, 0
    for start, end, own in zip(starts, ends, sizes):
        full = n >= most_rows or (not after and n > 0 and size + own > most_size)
        if n == 0 or start or full:
            group, n, size = group + 1, 0, 0
        n, size = n + 1, size + own + (joint if n else 0)
        out.append(group)
        if end or (after and (n >= most_rows or size >= most_size)):
            n = size = 0
    return out


def sentence_segments(lines: DataFrame) -> DataFrame:
    """(doc_id, segment_id, text, kind, start_line, end_line) of lines (doc_id, line_id, text).

    Structural lines stand alone; others run to a sentence's end, 8 lines or 1200 characters."""
    flagged = judged(lines.select("doc_id", "line_id", "text"), t.strip("text"), lambda s: [t.is_hard_structural(s).alias("hard"), t.ends_sentence(s).alias("ends")]).withColumn("size", F.length("text"))
    one = _joined(flagged, [F.col("hard"), F.col("hard") | F.col("ends"), F.col("size")], lambda *of: capped(*of, SEGMENT_LINES, SEGMENT_CHARS, 1, True), "segment_id")
    total = F.max("end_line").over(Window.partitionBy("doc_id"))

    def kinds(first: Column) -> list[Column]:
        fixed = F.when(t.is_title_like(first, True), "STRUCTURAL_TITLE").when(t.any_marker(first, True), "STRUCTURAL_UNIT").when(t.is_footer_or_signature(first), "FOOTER_OR_SIGNATURE")
        fixed = fixed.when(t.is_strict_metadata(first, (F.col("start_line") - 1) / F.col("total")), "METADATA")
        goes_on = t.starts_lower(first) | ~first.rlike("[.!?…:]$") | first.rlike(r"(?iuU)^\d{1,2}\s+năm\b")
        return [fixed.alias("fixed"), goes_on.alias("goes_on")]

    rows = judged(one.withColumn("total", total), t.strip("first"), kinds)
    # What precedes decides through one fact, whether it is a title, footer or metadata, and that needs no fold.
    before = F.lag(F.coalesce("fixed", F.lit("LINE"))).over(in_order("segment_id"))
    body = F.when(before.isin("STRUCTURAL_UNIT", "LINE") & F.col("goes_on"), "BODY_CONTINUATION").when(F.col("n") == 1, "LINE").otherwise("PARAGRAPH_OR_SENTENCE")
    return rows.select("doc_id", "segment_id", "text", F.coalesce("fixed", body).alias("kind"), "start_line", "end_line")


def blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, block_id, text, first_line, start_line, end_line, line_count, char_count)
    of lines (doc_id, line_id, text): noise stands alone, markers and titles start a
    block, continuing lines join it up to 12 lines and 2200 characters."""

    def flags(s: Column) -> list[Column]:
        own = t.any_marker(s) | t.is_footer_section(s) | t.is_title_like(s) | t.is_signature_like(s)
        # what opens a block itself is not asked whether it goes on
        state = F.when(own, "own").when(t.is_continuation(s), "goes on").when(s.isNotNull(), "")
        return [state.alias("_state"), t.invites_next(s).alias("_invites"), t.is_noise(s).alias("noise")]

    rows = judged(lines.select("doc_id", "line_id", "text"), t.strip("text"), flags)
    opens = (F.col("_state") == "own") | ~((F.col("_state") == "goes on") | F.lag("_invites").over(in_order("line_id")))
    flagged = rows.select("doc_id", "line_id", "text", F.coalesce(opens, F.lit(True)).alias("opens"), "noise", F.length("text").alias("size"))
    out = _joined(flagged, [F.col("opens") | F.col("noise"), F.col("noise"), F.col("size")], lambda *of: capped(*of, BLOCK_LINES, BLOCK_CHARS, 1), "block_id")
    return out.withColumnsRenamed({"first": "first_line", "n": "line_count"}).withColumn("char_count", F.length("text"))


def with_position(blocks_: DataFrame) -> DataFrame:
    """``blocks_`` with ``position``: the share of the document's blocks before each."""
    every = Window.partitionBy("doc_id")
    return blocks_.withColumn("position", (F.col("block_id") - 1) / F.greatest(F.count("*").over(every), F.lit(1)))


def anchor(first: Column, position: Column) -> Column:
    """Which section a block opens, or ''."""
    return (
        F.when(t.is_noise(first), "").when(t.is_title_like(first) & (position < 0.15), "DOCUMENT_TITLE").when(t.is_subject_like(first) & (position < 0.25), "DOCUMENT_SUBJECT")
        .when(t.is_chapter(first), "MAJOR_STRUCTURAL").when(t.is_marker(first, "ARTICLE") | t.is_marker(first, "NUMBER") | t.is_marker(first, "DECIMAL"), "MAIN_UNIT")
        .when(t.is_footer_section(first) & (position > 0.45), "FOOTER_SECTION").when(t.is_signature_like(first) & (position > 0.55), "SIGNATURE_BLOCK").otherwise("")
    )


def sections(blocks_: DataFrame) -> DataFrame:
    """``blocks_`` with ``anchor`` and ``section_id``: anchors other than a subject open a
    section, and so do 28 blocks or 5000 characters."""
    rows = with_position(blocks_.withColumn("first_line", t.strip("first_line")))
    rows = judged(rows, F.col("first_line"), lambda x: [anchor(x, F.col("position")).alias("anchor")]).withColumn("opens", ~F.col("anchor").isin("", "DOCUMENT_SUBJECT"))
    return _grouped(rows, "block_id", [F.col("opens"), F.lit(False), F.col("char_count")], lambda *of: capped(*of, SECTION_BLOCKS, SECTION_CHARS), "section_id").drop("opens")


def block_signals(blocks_: DataFrame) -> DataFrame:
    """``blocks_`` with one column for each structural signal of its first line."""

    def signals(first: Column) -> list[Column]:
        number = t.numbering(first)
        return [
            number.alias("_number"), t.marker_kind(first).alias("marker_kind"), t.is_marker(first, "BULLET").alias("bullet"),
            t.is_marker(first, "ARTICLE").alias("article"), t.is_chapter(first).alias("chapter"), t.is_title_like(first).alias("all_caps"), (F.col("char_count") < 80).alias("short_line"),
            first.rlike("[.!?…]$").alias("ends_period"), t.is_continuation(first).alias("continuation"), t.is_noise(first).alias("noise_like"), t.is_metadata_like(first).alias("metadata_like"),
            t.is_footer_section(first).alias("footer_like"), t.is_signature_like(first).alias("signature_like"), t.is_subject_like(first).alias("subject_like"), t.invites_next(first).alias("_invites"),
        ]

    rows = judged(blocks_.withColumn("first_line", t.strip("first_line")), F.col("first_line"), signals)
    rows = rows.withColumns({"numbering": F.col("_number.numbering"), "numbering_level": F.col("_number.level")}).drop("_number")
    before = F.lag("_invites").over(in_order("block_id"))
    return rows.withColumn("incomplete_prev", F.coalesce(before, F.lit(False))).drop("_invites")


def _prompt_groups(opening: list[bool], sizes: list[int], levels: list[int], titles: list[bool]) -> list[int]:
    """Groups of blocks for one recognition prompt each; a number at the level of the
    group's highest one or above opens the next, and so does a title after text."""
    out, group, n, size, top, title = [], 0, 0, 0, 0, False
    for opens, chars, level, caps in zip(opening, sizes, levels, titles):
        numbered = level > 0 and top > 0 and level <= top
        if n == 0 or opens or n >= PROMPT_BLOCKS or size + chars > PROMPT_CHARS or numbered or (caps and not title):
            group, n, size, top, title = group + 1, 0, 0, 0, bool(caps)
        n, size = n + 1, size + chars
        if level > 0:
            top = min(top, level) if top else level
        out.append(group)
    return out


def semantic_chunks(blocks_: DataFrame) -> DataFrame:
    """block_signals() with ``chunk_id``: consecutive blocks that are recognised together."""
    rows = block_signals(blocks_)
    opens = F.col("noise_like") | F.col("metadata_like") | F.col("footer_like") | F.col("signature_like") | F.col("chapter") | F.col("subject_like")
    return _grouped(rows, "block_id", [opens, F.col("char_count"), F.col("numbering_level"), F.col("all_caps")], _prompt_groups, "chunk_id")


def chunk_signals(chunked: DataFrame) -> DataFrame:
    """One row a chunk (doc_id, chunk_id): texts, contexts and the roll-up of its blocks' signals."""
    level = F.when(F.col("numbering_level") > 0, F.col("numbering_level"))
    # one sorted list of a chunk's blocks: an aggregate for each signal costs several times as much
    own = F.struct("block_id", "text", "first_line", F.col("numbering").isNotNull().alias("numbered"), level.alias("level"), "article", "chapter", "all_caps", "short_line", "ends_period", "continuation")
    rolled = chunked.groupBy("doc_id", "chunk_id").agg(F.sort_array(F.collect_list(own)).alias("_b"), F.sum("char_count").alias("char_count"), F.count("*").alias("block_count"))
    first, last = F.get("_b", F.lit(0)), F.element_at("_b", -1)
    one = rolled.select(
        "doc_id", "chunk_id", F.col("_b.block_id").alias("source_block_ids"), F.array_join("_b.text", "\n").alias("text"), first["first_line"].alias("candidate_header"),
        last["text"].alias("_last"), F.array_max("_b.numbered").alias("has_numbering"), F.coalesce(F.array_min("_b.level"), F.lit(0)).alias("numbering_level"), F.array_max("_b.article").alias("has_article"),
        F.array_max("_b.chapter").alias("has_chapter"), F.array_max("_b.all_caps").alias("is_all_caps"), F.array_min("_b.short_line").alias("is_short"), last["ends_period"].alias("ends_period"),
        first["continuation"].alias("is_continuation"), "char_count", "block_count",
    )
    w = in_order("chunk_id")
    around = one.withColumn("context_before", F.coalesce(t.clip(F.lag("_last").over(w), CONTEXT_CHARS), F.lit(""))).withColumn("context_after", F.coalesce(t.clip(F.lead("candidate_header").over(w), CONTEXT_CHARS), F.lit("")))
    return around.drop("_last")


def pack_pages(pages: DataFrame, most: int = PART_TOKENS, overlap: int = 1) -> DataFrame:
    """(doc_id, part, first_page, last_page, text) of pages (doc_id, page, text, token_len).

    A document over ``most`` tokens is cut in parts of about half way between an
    even share and ``most``; a part starts with the last ``overlap`` pages of the one before."""

    def spans(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("page", kind="stable", ignore_index=True)
        tokens = [int(x) for x in part.token_len]
        total, found, first, size = sum(tokens), [], 0, 0
        share = -(-total // -(-total // most)) if total else 0
        target = -(-(total / max(1, -(-total // most)) + most) // 2) if share else most
        for i, n in enumerate(tokens):
            if total > most and size + n > target:
                found.append((first, i - 1))
                first = max(i - overlap, 0)
                size = sum(tokens[first:i])
            size += n
        found.append((first, len(tokens) - 1))
        return pd.DataFrame([(part.doc_id[0], k, int(part.page[a]) if a <= b else None, int(part.page[b]) if a <= b else None) for k, (a, b) in enumerate(found)], columns=["doc_id", "part", "first_page", "last_page"])

    kind = dict(pages.dtypes)["doc_id"]
    found = pages.select("doc_id", "page", "token_len").groupBy("doc_id").applyInPandas(spans, f"doc_id {kind}, part int, first_page int, last_page int")
    wide = found.withColumn("page", F.explode(F.sequence("first_page", "last_page"))).join(pages.select("doc_id", "page", "text"), ["doc_id", "page"])
    return wide.groupBy("doc_id", "part", "first_page", "last_page").agg(ordered_text(F.col("text"), F.col("page"), "").alias("text"))


def thin_tree(nodes: DataFrame, least_tokens: int) -> DataFrame:
    """``nodes`` (doc_id, ord, level, text, last_ord, subtree_tokens) without what stands
    under a node of fewer than ``least_tokens`` tokens, whose text takes theirs in.

    A small node's descendants are small too, so the topmost small node takes the
    whole subtree: a running maximum of subtree ends finds it."""
    small = F.when(F.col("subtree_tokens") < least_tokens, F.col("last_ord"))
    before = in_order("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.withColumn("_covered", F.coalesce(F.max(small).over(before) >= F.col("ord"), F.lit(False)))
    rows = rows.withColumn("_host", F.max(F.when(~F.col("_covered"), F.col("ord"))).over(running("ord")))
    merged = rows.where("not _covered or trim(text) != ''").groupBy("doc_id", F.col("_host").alias("ord")).agg(ordered_text(F.col("text"), F.col("ord"), "\n\n").alias("text"))
    return rows.where("not _covered").drop("_covered", "_host", "text").join(merged, ["doc_id", "ord"])
