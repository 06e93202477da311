"""Queries of expressions and small operators over made-up values, each with its SQL.

Every sixth order, part or event gets another case, so the SQL can say by the
key what an expression has to find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import replies
from ..functions import text as t
from ..operators import geometry, lines, recognition, retrieval, rules, spell, stats, toc, tree
from ..sources import store
from .derived import BOXES_SQL, ITEMS_SQL, OUTLINE_SQL, STATS_SQL, boxes, outline_lines, sessions, spread, stored_documents, table, unique_items, users
from .text_queries import _ANY, _LOWER, _MARKED, _PLAIN, _TITLE, _WORDS, STRIPPED_SQL, _KIND

#: Lines of letterheads and closings, by the remainder of the key.
LINES = ["Số: 12/QĐ", "Hà Nội, ngày 3 tháng 4 năm 2020", "Nơi nhận:", "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "TM.ỦY BAN", "Về việc mua sắm", "plain words"]
NAMES = ["Hà Nội", "plain words", "VIỆT NAM", "Acme Corp", "One", "đường/phố"]


def _pick(values: list, key: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice")


def letterhead_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select("o_orderkey", _pick(LINES, F.col("o_orderkey")).alias("line"), (F.col("o_orderkey") % 10 / 10).alias("position"))
    return lines.judged(rows, F.col("line"), lambda s: [
        t.is_metadata_like(s, True).alias("metadata"), t.is_strict_metadata(s, F.col("position")).alias("strict"), t.is_footer_or_signature(s).alias("closing"),
        t.is_footer_section(s).alias("footer"), t.is_signature_like(s).alias("signature"), t.is_subject_like(s).alias("subject"),
    ]).drop("line", "position")


def line_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.explode_lines(spread(table(spark, sf_dir, "documents")))
    return lines.judged(rows, t.strip("line"), lambda s: [t.is_continuation(s).alias("goes_on"), t.invites_next(s).alias("invites"), t.starts_lower(s).alias("low")]).drop("line")


def line_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outline_lines(spark, sf_dir).select("doc_id", "line_num", F.regexp_replace("line", "^#+ ", "").alias("line"))
    made = lines.judged(rows, t.strip("line"), lambda s: [t.line_features(s).alias("f")])
    return made.select("doc_id", "line_num", "f.marker_kind", "f.title_like", "f.noise_like", "f.starts_marker", "f.starts_bullet", "f.subject_like", "f.footer_section_like")


def straight_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat(F.lit("“"), F.col("o_orderpriority"), F.lit("” ★☆ – đ€…"))
    return _orders(spark, sf_dir).select("o_orderkey", t.clean_strange(odd).alias("clean"))


def safe_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of a text, replaced by the next ones."""
    words = F.split("text", " ")
    n, m = F.col("doc_id") % 4 + 1, F.col("doc_id") % 3 + 1
    part = lambda at, k: F.array_join(F.slice(words, at.cast("int"), k.cast("int")), " ")
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", part(F.lit(1), n).alias("a"), part(n + 1, m).alias("b"))
    return lines.judged(rows, F.col("a"), lambda a: [F.array_join(t.fix_breaks(a, F.col("b")), " ").alias("breaks")]).select("doc_id", "breaks")


def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = t.dot_leaders(F.concat("o_orderpriority", F.lit(" ........ "), F.col("o_orderkey").cast("string"), F.lit(" . . . . . . end")))
    tagged = F.concat(t.tag_page(text, F.col("o_orderkey") % 50), t.tag_page(F.lit("x"), F.lit(7)))
    return _orders(spark, sf_dir).select("o_orderkey", tagged.alias("tagged"), F.array_join(t.tagged_pages(tagged).cast("array<string>"), " ").alias("pages"))


def phrase_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("a1 a2, a3 - a4 "), F.col("o_orderstatus"), F.lit(" b1. b2 b3 b4"))
    source = F.when(F.col("o_orderkey") % 3 == 0, F.lit("absent")).otherwise(F.col("o_orderstatus"))
    return _orders(spark, sf_dir).select("o_orderkey", t.phrase_window(said, source).alias("window"))


def name_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _pick(NAMES, F.col("o_orderkey"))
    cap = t.token_cap(F.repeat(F.lit("x"), (F.col("o_orderkey") % 200 * 80).cast("int")), 1024)
    return _orders(spark, sf_dir).select("o_orderkey", t.has_accents(name).alias("accents"), t.is_proper_noun(name).alias("proper"), t.safe_filename(name).alias("file"), cap.alias("tokens"))


def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("1998-08-02 10:00:00").cast("timestamp_ntz")
    at = F.when(F.col("o_orderkey") % 4 == 0, now - F.make_dt_interval(mins=F.col("o_orderkey") % 12_000)).otherwise(F.col("o_orderdate"))
    return _orders(spark, sf_dir).select("o_orderkey", t.relative_time(at, now).alias("ago"))


def reply_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"a": '), F.col("o_orderkey").cast("string"), F.lit(', "b": ["x", "y"],}'))
    shapes = [F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("<think>{no}</think>Sure: "), body, F.lit("\nINFO: done")), body, F.lit("no object")]
    said = F.coalesce(*(F.when(F.col("o_orderkey") % 4 == i, s) for i, s in enumerate(shapes)))
    loose = F.concat(F.lit("```json\n{\"a\":  None,\n \"k\": "), F.col("o_orderkey").cast("string"), F.lit(",}\n```"))
    return _orders(spark, sf_dir).select("o_orderkey", replies.json_object(said).alias("found"), replies.loose_json(F.when(F.col("o_orderkey") % 4 == 3, said).otherwise(loose)).alias("loose"))


def token_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1000).alias("token_len"), F.concat("p_brand", F.lit("......"), "p_size").alias("title"))
    return toc.over_token_limit(nodes, 20_000).select("p_partkey", toc.clean_toc(F.col("title")).alias("title"))


def shifted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents whose offset is known for two of three."""
    items = unique_items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber") * 2).alias("page"), F.lit(9).alias("physical_index"))
    offsets = _orders(spark, sf_dir).where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 5).alias("offset"))
    return toc.apply_offset(items, offsets).select("doc_id", "ord", F.col("physical_index").cast("long").alias("physical_index"))


def span_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's span is its own page and the next one."""
    pages = unique_items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    spans = pages.select("doc_id", F.col("page").alias("ord"), F.col("page").alias("start_index"), (F.col("page") + 1).alias("end_index"))
    return tree.span_texts(spans, pages).select("doc_id", "ord", "text")


def applied_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = unique_items(spark, sf_dir)
    number = F.col("l_quantity").cast("int")
    chunks = item.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_id"), F.array(F.col("l_linenumber") * 2, F.col("l_linenumber") * 2 + 1).alias("source_block_ids"), F.col("l_returnflag").alias("candidate_header"),
        _pick(["KEEP", "MERGE_PREVIOUS", "MARK_NOISE"], number).alias("final_decision"), (number % 5 > 0).alias("applied"), (number % 2 == 0).alias("is_node"), F.lit("HEADING").alias("role"), (number % 8).alias("final_level"),
    )
    return rules.apply_decisions(chunks).select("doc_id", "block_id", "level", "first_line", "merged_into")


def table_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells: every page is a table, its most frequent kind of cell and its header rows."""
    cells = table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).cast("int").alias("page"), F.col("p_partkey").alias("box_id"), F.when(F.col("p_size") % 2 == 0, "12.5").otherwise("2020-01-02").alias("text"))
    return geometry.most_common_type(cells, ["page"])


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("table_id"), (F.col("p_partkey") % 7).alias("row_no"), (F.col("p_size") > 20).alias("in_header"))
    return geometry.header_rows(cells)


def clean_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, wide = boxes(spark, sf_dir)
    shifted = wide.unionByName(wide.selectExpr("page", "box_id + 100000 AS box_id", "x0 + 5 AS x0", "x1", "top", "bottom - 3 AS bottom"))
    return geometry.clean_layouts(shifted.withColumn("type", F.lit("text")).withColumn("score", (F.col("box_id") % 10 / 10))).select("page", "box_id")


def tagged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    small, wide = boxes(spark, sf_dir)
    kinds = wide.withColumn("type", _pick(["text", "header", "table"], F.col("box_id")))
    return geometry.tag_layouts(small, kinds).select("page", "box_id", "layout_type")


def resized_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = geometry.resized_shape((F.col("p_size") * 64).cast("double"), F.lit(960.0))
    rows = table(spark, sf_dir, "part").select("p_partkey", shape.alias("s"), (F.col("p_size") / 50).alias("score"))
    return geometry.confident(rows, 0.5).select("p_partkey", "s.height", "s.width")


def visible_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.search_names(stored_documents(spark, sf_dir), "A", "nguoi_dung").select("id", "filename")


def found_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.find_document(stored_documents(spark, sf_dir).withColumn("id", F.col("id").cast("string")), "17").select("id", "status")


def renamed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored_documents(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    return stats.rename_document(docs, "17", " new name ").where("id in ('16', '17')").select("id", "filename")


def changed_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change that an admin is spared, then one that another user is not."""
    ids = users(spark, sf_dir)
    once = stats.change_role(stats.change_role(ids.withColumn("id", F.col("id").cast("string")), "1", "can_bo"), "2", "can_bo")
    return once.select("id", "role")


def owned_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = sessions(spark, sf_dir)
    first = every.join(users(spark, sf_dir).select(F.col("id").alias("user_id"), "username"), "user_id").orderBy("id").limit(1).select("id", "username").first()
    return stats.owned_session(every, users(spark, sf_dir), first.id, first.username).select("id", "user_id") if first else every.select("id", "user_id")


def final_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" [Nguồn: d"), F.col("o_custkey"), F.lit(".md, Dòng: 3-4]"))).otherwise("")
    rows = _orders(spark, sf_dir).select("o_orderkey", F.concat("o_orderpriority", tag).alias("answer"), F.lit("kept.md").alias("filename"), F.lit("1-2").alias("lines"))
    return retrieval.final_sources(rows).select("o_orderkey", "source_file", "source_lines", "plain_answer")


def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _pick(["một hai ba", "one two three four", "ab cd ef", "one two"], F.col("o_orderkey"))
    return _orders(spark, sf_dir).select("o_orderkey", spell.needs_review(said).alias("review"))


def leaf_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short nodes are their own summaries; no model is asked."""
    nodes = outline_lines(spark, sf_dir).select("doc_id", "own", F.col("line").alias("text"), (F.col("level") == 3).alias("is_leaf"))
    told = recognition.node_summaries(nodes, lambda: str.upper, F.length("text"), least=10_000)
    return told.select("doc_id", "own", "summary", "prefix_summary")


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as pages of orders, put together under their marks."""
    pages = unique_items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.concat(F.lit(" "), "l_returnflag", F.lit("\n")).alias("text"))
    raw = store.raw_texts(pages).withColumnRenamed("text", "raw")
    return raw.join(store.markdown_documents(pages), "doc_id").select("doc_id", "raw", "text")


def page_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as native pages, every third one recognised as well."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), F.col("text").alias("native_text"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" more"))).alias("ocr_text"))
    return store.page_report(pages).select("doc_id", "page", "method", "reason", "selected_chars")


def replaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = stored_documents(spark, sf_dir).select("id", "status")
    return store.replace_rows(old, old.where("id % 10 = 0").withColumn("status", F.lit("new")), "id")


def merged_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as blocks; a model calls some of them the head of a footer."""
    number = F.col("l_quantity").cast("int")
    blocks = unique_items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("block_id"), _pick(["plain words", "Nơi nhận:", "- item"], number).alias("first_line"), F.lit(3).alias("line_count"), ((F.col("l_linenumber") - 1) / 7).alias("position"), number.alias("q"))
    model = blocks.where("q % 7 = 0").select("doc_id", "block_id", F.lit("FOOTER_SECTION").alias("role"))
    return rules.block_roles(blocks.drop("q"), model).select("doc_id", "block_id", "role")


def reviewed_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"))
    flagged = rows.select("doc_id", F.lit("phap").alias("token"), F.lit(0).alias("position"), F.array(F.lit("pháp"), F.lit("phạp")).alias("candidates"))
    chosen, action = _pick(["Pháp", "xyz", "luật", "luat", "pháp"], F.col("doc_id")), _pick(["pick", "pick", "suggest", "suggest", "skip"], F.col("doc_id"))
    answers = rows.select("doc_id", F.lit(1).alias("ord"), F.lit("pháp").alias("word"), chosen.alias("chosen"), action.alias("action"))
    words = spark.createDataFrame([("luật", 9), ("luát", 2), ("pháp", 5)], "term string, freq long")
    return spell.reviewed_fixes(flagged, answers, words).select("doc_id", "token", "position", F.col("candidates")[0].alias("fix"))


def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("text"))
    return recognition.document_summaries(docs, lambda: lambda prompt, tokens: f"{len(prompt.strip())} of {tokens}", "unheard of").select("doc_id", "summary", "max_tokens")


def reviewed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that lowers some texts and answers others at three times their length."""
    rows = _orders(spark, sf_dir).select("o_orderkey", F.col("o_orderpriority").alias("text"))
    return recognition.reviewed_texts(rows, lambda: lambda p: p.lower() if "1" in p else p * 3).select("o_orderkey", "reviewed")


def model_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that keeps to a schema for some prompts, answers others without one, and fails for the rest."""

    def ask(prompt: str, schema: str | None) -> str:
        if "5" in prompt:
            raise ValueError("no")
        return f'{{"a": "{prompt}"}}' if schema is None or "1" in prompt else "nothing"

    told = retrieval.with_json_model(_orders(spark, sf_dir).select("o_orderkey", "o_orderpriority"), "o_orderpriority", lambda: ask, "{}", "found", wait=0.0)
    return told.select("o_orderkey", "found", "found_error")


def condensed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    ids = said.select("conv_id").distinct()
    asked = ids.union(ids.select(F.col("conv_id") + 1_000_000)).withColumn("question", F.lit("why?"))
    return retrieval.condensed_questions(said, asked, lambda: lambda p: p.split("\n")[-1].upper()).select("conv_id", "condensed")


def catalogue_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored_documents(spark, sf_dir).select("id", "status")
    known = docs.where("id % 3 = 0").select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("summary"))
    return stats.catalogue_summaries(docs, known, "none yet").select("id", "summary")


def node_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = outline_lines(spark, sf_dir).select("doc_id", "own", F.struct("level", "line", F.array(F.struct("line", "up")).alias("more")).alias("f"))
    kept = tree.node_fields(nodes, first=["own"], without=["line"])
    return kept.select("own", "doc_id", "f.level", F.to_json("f").alias("json"))


def _modes(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], DataFrame]:
    """Contents that are right at once, right without page numbers, or never."""
    items = unique_items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("T"), "l_linenumber").alias("title"), F.col("l_linenumber").alias("physical_index"))
    wrong = F.when(F.col("doc_id") % 3 == 0, F.col("title")).otherwise("zz")
    later = F.when(F.col("doc_id") % 3 == 1, F.col("title")).otherwise("zz")
    return [items.withColumn("title", wrong), items.withColumn("title", later)], items.select("doc_id", F.col("ord").alias("page"), F.col("title").alias("text"))


def settled_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.settled_toc(*_modes(spark, sf_dir))


def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.page_index(*_modes(spark, sf_dir))


QUERIES = [
    letterhead_flags, line_links, line_feature_rows, straight_quotes, safe_fixes, page_tags, phrase_windows, name_shapes, relative_times, reply_objects, token_limits, shifted_pages, span_texts, applied_decisions,
    table_types, header_rows, clean_layouts, tagged_boxes, resized_shapes, visible_names, found_document, renamed_documents, changed_roles, owned_sessions, final_sources, review_flags, leaf_summaries,
    stored_pages, page_reports, replaced_rows, merged_roles, reviewed_fixes, document_summaries, reviewed_texts, model_objects, condensed_questions, catalogue_summaries, node_fields, settled_toc, page_index,
]

_AREA = "((least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * (least({a}.bottom, {b}.bottom) - greatest({a}.top, {b}.top)))"
_SHARE = "CASE WHEN least({a}.x1, {b}.x1) > greatest({a}.x0, {b}.x0) AND least({a}.bottom, {b}.bottom) > greatest({a}.top, {b}.top) THEN " + _AREA + " / (({a}.x1 - {a}.x0) * ({a}.bottom - {a}.top)) ELSE 0 END"

#: White space of any kind, as fix_breaks() takes it.
_SPACE = r"[\s\x0b\x{85}\p{Z}]"

SQL = {
    "letterhead_flags": """SELECT o_orderkey, k IN (0, 1, 3) AS metadata, k IN (0, 3) OR (k = 1 AND o_orderkey % 10 < 2) AS strict, k IN (2, 4) AS closing, k = 2 AS footer, k = 4 AS signature, k = 5 AS subject
FROM (SELECT o_orderkey, o_orderkey % 7 AS k FROM orders)""",
    "line_links": rf"""WITH {STRIPPED_SQL} SELECT doc_id, line_num, {_LOWER} OR regexp_matches(s, '(?i)^\d{{1,2}}\s+(ngày|tháng|năm)') OR (length(s) <= 35 AND NOT {_ANY} AND NOT regexp_matches(s, '[.!?;:]$')) AS goes_on,
  CASE WHEN regexp_matches(s, '[,;\-–]$') THEN true WHEN s LIKE '%:' THEN false ELSE NOT regexp_matches(s, '[.!?…]$') AND {_WORDS} >= 6 AND NOT {_TITLE} END AS invites, {_LOWER} AS low FROM st""",
    "line_feature_rows": rf"""WITH {OUTLINE_SQL}, b AS (SELECT doc_id, line_num, regexp_replace(line, '^#+ ', '') AS s FROM outline)
SELECT doc_id, line_num, {_KIND} AS marker_kind, {_TITLE} AS title_like, (s = '' OR ({_PLAIN} <= 1 AND length(s) <= 8) OR regexp_matches(s, '^\d+\s*$')) AS noise_like, {_ANY} AS starts_marker, regexp_matches(s, '^[-–•+]') AS starts_bullet, false AS subject_like, false AS footer_section_like FROM b""",
    "straight_quotes": """SELECT o_orderkey, '"' || o_orderpriority || '"  – đ…' AS clean FROM orders""",
    "safe_fixes": rf"""WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws, doc_id % 4 + 1 AS n, doc_id % 3 + 1 AS m FROM documents),
f AS (SELECT doc_id, regexp_replace(array_to_string(ws[1 : n], ' '), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS a, regexp_replace(array_to_string(ws[n + 1 : n + m], ' '), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS b FROM w),
c AS (SELECT doc_id, coalesce(a, '') AS a, coalesce(b, '') AS b FROM f),
k AS (SELECT *, CASE WHEN a = '' THEN 0 ELSE len(regexp_split_to_array(a, '{_SPACE}+')) END AS wa, CASE WHEN b = '' THEN 0 ELSE len(regexp_split_to_array(b, '{_SPACE}+')) END AS wb FROM c)
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN contains(a, chr(10)) OR contains(b, chr(10)) THEN 'layout' END, CASE WHEN a = b THEN 'nothing' END,
  CASE WHEN regexp_replace(a, '[^\p{{Nd}}]', '', 'g') <> regexp_replace(b, '[^\p{{Nd}}]', '', 'g') THEN 'numbers' END,
  CASE WHEN regexp_matches(a || b, '[\x{{3400}}-\x{{9fff}}]') THEN 'script' END,
  CASE WHEN length(a) < 2 OR length(a) > 36 OR length(b) > 44 OR length(b) > 2 * length(a) + 6 THEN 'size' END,
  CASE WHEN {_MARKED.replace("(s,", "(a,")} OR regexp_matches(a, '(?i)^Điều\s+\d+[.:]?\s+') OR regexp_matches(a, '(?i)^(PHẦN|CHƯƠNG|MỤC|TIỂU\s+MỤC)\s+([IVXLCDM]+|\d+|THỨ\s+[\p{{L}}\p{{N}}_]+)')
    OR regexp_matches(a, '(?i)^(số|so)\s*[:：]') OR regexp_matches(a, '(?i)(^|[^\p{{L}}\p{{N}}_])ngày\s+\d{{1,2}}\s+tháng\s+\d{{1,2}}\s+năm\s+\d{{4}}($|[^\p{{L}}\p{{N}}_])')
    OR regexp_matches(a, '(?i){t.MOTTO}') OR regexp_matches(a, '(?i)^({t.STATE})$') THEN 'structure' END,
  CASE WHEN greatest(wa, wb) > 5 OR abs(wa - wb) > 1 THEN 'words' END], lambda x: x IS NOT NULL), ' ') AS breaks FROM k""",
    "page_tags": """SELECT o_orderkey, tag || chr(10) || o_orderpriority || ' :  ' || o_orderkey || ' : end' || chr(10) || tag || chr(10) || '<physical_index_7>' || chr(10) || 'x' || chr(10) || '<physical_index_7>' || chr(10) AS tagged, p || ' ' || p || ' 7 7' AS pages
FROM (SELECT *, o_orderkey % 50 AS p, '<physical_index_' || (o_orderkey % 50) || '>' AS tag FROM orders)""",
    "phrase_windows": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'absent' ELSE 'a2 a3 a4 ' || o_orderstatus || ' b1 b2 b3' END AS \"window\" FROM orders",
    "name_shapes": """SELECT o_orderkey, k IN (0, 2, 5) AS accents, k IN (0, 3) AS proper, (['Hà Nội', 'plain words', 'VIỆT NAM', 'Acme Corp', 'One', 'đường-phố'])[k + 1] AS file, least(greatest(256, trunc(5800 - (o_orderkey % 200 * 80 * 0.4 + 50))::INTEGER), 1024)::INTEGER AS tokens
FROM (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)""",
    "relative_times": """SELECT o_orderkey, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || ' min' WHEN m < 1440 THEN (m // 60) || ' h' WHEN m < 10080 THEN (m // 1440) || ' d' ELSE strftime(then_, '%Y-%m-%d') END AS ago
FROM (SELECT o_orderkey, then_, floor((epoch(TIMESTAMP '1998-08-02 10:00:00') - epoch(then_)) / 60)::BIGINT AS m FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '1998-08-02 10:00:00' - to_minutes((o_orderkey % 12000)::INTEGER) ELSE o_orderdate END AS then_ FROM orders))""",
    "reply_objects": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN '{"a": ' || o_orderkey || ', "b": ["x", "y"]}' END AS found, CASE WHEN o_orderkey % 4 = 3 THEN '{}' ELSE '{"a": null, "k": ' || o_orderkey || '}' END AS loose FROM orders""",
    "token_limits": "SELECT p_partkey, p_brand || ': ' || p_size AS title FROM part WHERE p_size > 20",
    "shifted_pages": f"""WITH {ITEMS_SQL} SELECT l_orderkey AS doc_id, l_linenumber AS ord, CASE WHEN l_linenumber % 3 > 0 AND l_orderkey % 3 > 0 THEN l_linenumber * 2 + l_orderkey % 5 ELSE 9 END::BIGINT AS physical_index FROM items""",
    "span_texts": f"""WITH {ITEMS_SQL} SELECT a.l_orderkey AS doc_id, a.l_linenumber AS ord, a.l_returnflag || a.l_linenumber || coalesce(b.l_returnflag || b.l_linenumber, '') AS text FROM items a LEFT JOIN items b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""",
    "applied_decisions": f"""WITH {ITEMS_SQL}, c AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_returnflag, trunc(l_quantity)::INTEGER AS q FROM items),
p AS (SELECT *, q % 3 = 1 AND q % 5 > 0 AND lag(n) OVER w IS NOT NULL AS gone, lag(n) OVER w * 2 + 1 AS into_ FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY n))
SELECT doc_id, n * 2 AS block_id, greatest(1, least({rules.MAX_LEVEL}, q % 8)) AS level, l_returnflag AS first_line, NULL::INTEGER AS merged_into FROM p WHERE q % 5 > 0 AND q % 2 = 0 AND q % 3 <> 2 AND NOT gone
UNION ALL SELECT doc_id, unnest([n * 2, n * 2 + 1]), NULL, NULL, into_ FROM p WHERE gone""",
    "table_types": """SELECT page, CASE WHEN a > b OR (a = b AND fa < fb) OR b IS NULL THEN 'Nu' ELSE 'Dt' END AS cell_type FROM (SELECT (p_partkey % 25)::INTEGER AS page, count(*) FILTER (WHERE p_size % 2 = 0) AS a, count(*) FILTER (WHERE p_size % 2 = 1) AS b, min(p_partkey) FILTER (WHERE p_size % 2 = 0) AS fa, min(p_partkey) FILTER (WHERE p_size % 2 = 1) AS fb FROM part GROUP BY 1)""",
    "header_rows": "SELECT p_partkey % 25 AS table_id, p_partkey % 7 AS row_no, avg(CASE WHEN p_size > 20 THEN 1.0 ELSE 0.0 END) > 0.5 AS is_header FROM part GROUP BY 1, 2",
    "clean_layouts": f"""WITH {BOXES_SQL}, l AS (SELECT page, box_id, x0, x1, top, bottom, (box_id % 10) / 10.0 AS score FROM regions UNION ALL SELECT page, box_id + 100000, x0 + 5, x1, top, bottom - 3, ((box_id + 100000) % 10) / 10.0 FROM regions)
SELECT page, box_id FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.page = a.page AND b.box_id <> a.box_id AND (b.score > a.score OR (b.score = a.score AND b.box_id < a.box_id)) AND greatest({_SHARE.format(a='a', b='b')}, {_SHARE.format(a='b', b='a')}) >= 0.7)""",
    "tagged_boxes": f"""WITH {BOXES_SQL}, r AS (SELECT *, box_id % 3 AS k, (CASE box_id % 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END) AS o FROM regions), p AS (SELECT b.page, b.box_id, r.k, r.o, r.box_id AS rid, {_SHARE.format(a='b', b='r')} AS ov, {_SHARE.format(a='r', b='b')} AS vo FROM boxes b JOIN r ON r.page = b.page),
c AS (SELECT *, row_number() OVER (PARTITION BY page, box_id ORDER BY o, ov DESC, vo DESC, rid DESC) AS n FROM p WHERE ov >= 0.4)
SELECT b.page, b.box_id, CASE c.k WHEN 0 THEN 'text' WHEN 2 THEN 'table' ELSE '' END AS layout_type FROM boxes b LEFT JOIN c ON c.page = b.page AND c.box_id = b.box_id AND c.n = 1 WHERE c.k IS NULL OR c.k <> 1""",
    "resized_shapes": """SELECT p_partkey, greatest(round_even(h * ratio / 32, 0) * 32, 32)::INTEGER AS height, greatest(round_even(960.0::DOUBLE * ratio / 32, 0) * 32, 32)::INTEGER AS width FROM (SELECT p_partkey, p_size, (p_size * 64)::DOUBLE AS h, least(1.0::DOUBLE, 960 / greatest((p_size * 64)::DOUBLE, 960.0::DOUBLE)) AS ratio FROM part) WHERE p_size / 50 >= 0.5""",
    "visible_names": f"WITH {STATS_SQL} SELECT id, filename FROM docs WHERE status IN ('processed', 'vector_processed') AND contains(lower(filename), 'a')",
    "found_document": f"WITH {STATS_SQL} SELECT id::VARCHAR AS id, status FROM docs WHERE id = 17",
    "renamed_documents": f"WITH {STATS_SQL} SELECT id::VARCHAR AS id, CASE WHEN id = 17 THEN 'new name' ELSE filename END AS filename FROM docs WHERE id IN (16, 17)",
    "changed_roles": f"WITH {STATS_SQL} SELECT id::VARCHAR AS id, CASE WHEN id IN (1, 2) AND role <> 'admin' THEN 'can_bo' ELSE role END AS role FROM users",
    "owned_sessions": f"WITH {STATS_SQL} SELECT id, user_id FROM sessions WHERE user_id IN (SELECT id FROM users) ORDER BY id LIMIT 1",
    "final_sources": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'd' || o_custkey || '.md' ELSE 'kept.md' END AS source_file, CASE WHEN o_orderkey % 2 = 0 THEN '3-4' ELSE '1-2' END AS source_lines, o_orderpriority AS plain_answer FROM orders""",
    "review_flags": "SELECT o_orderkey, o_orderkey % 4 = 1 AS review FROM orders",
    "leaf_summaries": f"WITH {OUTLINE_SQL} SELECT doc_id, own, CASE WHEN level = 3 THEN line END AS summary, CASE WHEN level < 3 THEN line END AS prefix_summary FROM outline",
    "stored_pages": f"""WITH {ITEMS_SQL} SELECT l_orderkey AS doc_id, string_agg('=== PAGE ' || l_linenumber || ' ===' || chr(10) || l_returnflag, chr(10) || chr(10) ORDER BY l_linenumber) AS raw, string_agg(' ' || l_returnflag || chr(10), chr(10) || chr(10) ORDER BY l_linenumber) AS text FROM items GROUP BY 1""",
    "page_reports": r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s, text FROM documents), r AS (SELECT *, length(s) < 500 AS short, CASE WHEN doc_id % 3 = 0 AND length(s) < 500 THEN regexp_replace(coalesce(text || ' more', ''), '^\s+|\s+$', '', 'g') ELSE '' END AS o FROM n)
SELECT doc_id, 1 AS page, CASE WHEN o = '' THEN 'native_text_selected_ocr_empty' WHEN s = '' THEN 'ocr_selected_native_empty' ELSE 'ocr_selected_longer_text' END AS method, CASE WHEN short THEN 'native_text_too_short' ELSE 'native_text_enough' END AS reason, length(CASE WHEN o = '' THEN s ELSE o END) AS selected_chars FROM r""",
    "replaced_rows": f"WITH {STATS_SQL} SELECT id, CASE WHEN id % 10 = 0 THEN 'new' ELSE status END AS status FROM docs",
    "merged_roles": f"""WITH {ITEMS_SQL}, b AS (SELECT l_orderkey AS doc_id, l_linenumber AS block_id, trunc(l_quantity)::INTEGER AS q, l_linenumber - 1 > 7 * 0.45 AS late FROM items),
h AS (SELECT *, (q % 3 = 1 AND late) OR q % 7 = 0 AS head FROM b), f AS (SELECT *, coalesce(bool_or(head) OVER (PARTITION BY doc_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS below FROM h)
SELECT doc_id, block_id, CASE WHEN q % 3 = 1 AND late THEN 'FOOTER_SECTION' WHEN below AND q % 3 = 2 THEN 'FOOTER_ITEM' WHEN q % 7 = 0 THEN 'FOOTER_SECTION' WHEN below THEN 'BODY_DETAIL' WHEN q % 3 = 1 THEN 'SECTION_INTRO' WHEN q % 3 = 2 THEN 'LIST_ITEM' ELSE 'BODY_DETAIL' END AS role FROM f""",
    "reviewed_fixes": """SELECT o_orderkey AS doc_id, 'phap' AS token, 0 AS position, CASE o_orderkey % 5 WHEN 0 THEN 'Pháp' ELSE 'luật' END AS fix FROM orders WHERE o_orderkey % 5 IN (0, 2, 3)""",
    "document_summaries": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 > 0 THEN length(o_orderpriority) || ' of 1024' ELSE '' END AS summary, 1024 AS max_tokens FROM orders",
    "reviewed_texts": "SELECT o_orderkey, CASE WHEN contains(o_orderpriority, '1') THEN lower(o_orderpriority) ELSE o_orderpriority END AS reviewed FROM orders",
    "model_objects": """SELECT o_orderkey, CASE WHEN NOT contains(o_orderpriority, '5') THEN '{"a": "' || o_orderpriority || '"}' END AS found, CASE WHEN contains(o_orderpriority, '5') THEN 'ValueError: no' END AS found_error FROM orders""",
    "condensed_questions": "SELECT DISTINCT conv_id, 'WHY?' AS condensed FROM conversations UNION ALL SELECT DISTINCT conv_id + 1000000, 'why?' FROM conversations",
    "catalogue_summaries": f"WITH {STATS_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 's' || id ELSE 'none yet' END AS summary FROM docs",
    "node_fields": f"""WITH {OUTLINE_SQL} SELECT own, doc_id, level, '{{"level":' || level || ',"more":[{{' || CASE WHEN up IS NULL THEN '' ELSE '"up":"' || up || '"' END || '}}]}}' AS json FROM outline""",
    "settled_toc": f"""WITH {ITEMS_SQL} SELECT l_orderkey AS doc_id, (l_orderkey % 3)::INTEGER AS mode, l_linenumber AS ord, 'T' || l_linenumber AS title, l_linenumber AS physical_index FROM items WHERE l_orderkey % 3 < 2""",
    "page_index": f"""WITH {ITEMS_SQL}, i AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, lead(l_linenumber) OVER w AS n, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS first FROM items WHERE l_orderkey % 3 < 2 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
SELECT doc_id, ord, 'T' || ord AS title, ord AS start_index, coalesce(n - 1, ord) AS end_index, 'T' || ord AS text FROM i UNION ALL SELECT doc_id, first - 1, 'Preface', 1, first - 1, NULL FROM i WHERE ord = first AND first > 1""",
    "box_suppression": f"""WITH RECURSIVE {BOXES_SQL}, r AS MATERIALIZED (SELECT page, box_id % 3 AS kind, {{'id': box_id, 'x0': x0, 'x1': x1, 'a': top, 'b': bottom}} AS o, row_number() OVER (PARTITION BY page, box_id % 3 ORDER BY box_id * 31 % 101 DESC, box_id) AS i FROM boxes),
f(page, kind, i, kept) AS (SELECT page, kind, i, [o] FROM r WHERE i = 1 UNION ALL
  SELECT f.page, f.kind, r.i, CASE WHEN len(list_filter(kept, lambda k: greatest(0, least(k.x1, r.o.x1) - greatest(k.x0, r.o.x0) + 1.0) * greatest(0, least(k.b, r.o.b) - greatest(k.a, r.o.a) + 1.0)
    > 0.45 * ((k.x1 - k.x0) * (k.b - k.a) + (r.o.x1 - r.o.x0) * (r.o.b - r.o.a) - greatest(0, least(k.x1, r.o.x1) - greatest(k.x0, r.o.x0) + 1.0) * greatest(0, least(k.b, r.o.b) - greatest(k.a, r.o.a) + 1.0)))) > 0 THEN kept ELSE list_append(kept, r.o) END
  FROM f JOIN r ON r.page = f.page AND r.kind = f.kind AND r.i = f.i + 1),
n AS (SELECT page, kind, max(i) AS i FROM r GROUP BY page, kind)
SELECT page, kind, unnest(kept).id AS box_id FROM f JOIN n USING (page, kind, i)""",
}
