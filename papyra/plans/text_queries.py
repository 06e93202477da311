"""Queries of the line expressions and line operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import lines as ln
from .derived import LINES_SQL, OUTLINE_SQL, outline_lines, spread, table

BODY_SQL = OUTLINE_SQL + ", body AS (SELECT doc_id, line_num, regexp_replace(line, '^#+ ', '') AS s FROM outline)"
_CHAPTER = r"(?i)^(PHẦN|CHƯƠNG|MỤC|TIỂU\s+MỤC)"
_ANY = rf"(regexp_matches(s, '^[-–•+]\s*') OR regexp_matches(s, '^\d+[.)]') OR regexp_matches(s, '^\d+(?:\.\d+)+[.)]?') OR regexp_matches(s, '(?i)^[A-Za-zÀ-ỹĐđ][.)]') OR regexp_matches(s, '(?i)^[IVXLCDM]+[.)]') OR regexp_matches(s, '(?i)^Điều\s+\d+') OR regexp_matches(s, '{_CHAPTER}'))"
_RATIO = r"(CASE WHEN length(regexp_replace(s, '[^A-Za-zÀ-ỹĐđ]', '', 'g')) = 0 THEN 0.0 ELSE length(regexp_replace(regexp_replace(s, '[^A-Za-zÀ-ỹĐđ]', '', 'g'), '[^\p{Lu}]', '', 'g'))::DOUBLE / length(regexp_replace(s, '[^A-Za-zÀ-ỹĐđ]', '', 'g')) END)"
STRIPPED_SQL = LINES_SQL + r", st AS (SELECT doc_id, line_num, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM lines)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.explode_lines(_docs(spark, sf_dir))


def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline_lines(spark, sf_dir).select("doc_id", "line_num", F.regexp_replace("line", "^#+ ", "").alias("s"))


def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


def marker_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _body(spark, sf_dir).select("doc_id", "line_num", t.marker_kind("s").alias("kind"), t.heading_level("s").alias("level"))


def numbering_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t.numbering("s")
    return _body(spark, sf_dir).select("doc_id", "line_num", n["numbering"].alias("numbering"), n["level"].alias("level"))


def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:

    def predicates(s: Column) -> list[Column]:
        return [
            F.round(t.upper_ratio(s), 6).alias("upper_ratio"), t.starts_lower(s).alias("starts_lower"), t.ends_sentence(s).alias("ends_sentence"),
            t.is_title_like(s).alias("title_like"), t.is_noise(s).alias("noise_like"), t.is_garbage(s).alias("garbage"),
        ]

    return ln.judged(_lines(spark, sf_dir), t.strip("line"), predicates).drop("line")


def spacing_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line_num", t.spacing("line").alias("spaced"))


def folded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line_num", t.strip_diacritics("line").alias("plain"), t.compare_key("line").alias("key"))


def clipped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", t.clip("text", 200).alias("clipped"), t.truncate_context("text", 6000).alias("truncated"))


def smalltalk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third message opens with a greeting."""
    said = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Xin chào, "), F.col("text"))).otherwise(F.col("text")))
    return said.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(t.is_smalltalk("text")).alias("smalltalk"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges from line items, every eighth running backwards."""
    a, q = F.col("l_linenumber"), F.col("l_quantity").cast("int") % 5
    spec = F.concat(a + 3, F.lit(", "), a, F.lit("-"), F.when(F.col("l_quantity").cast("int") % 8 == 0, a - 1).otherwise(a + q))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(t.page_numbers(spec).cast("array<string>"), " ").alias("pages"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat(F.lit(" [Nguồn: d"), F.col("o_custkey"), F.lit(".md, Dòng: "), F.col("o_orderkey") % 90, F.lit("-"), F.col("o_orderkey") % 90 + 4, F.lit("]"))
    answer = F.concat(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 3 > 0, tag).otherwise(""), F.when(F.col("o_orderkey") % 3 == 2, F.concat(F.lit("."), tag)).otherwise(""))
    rows = table(spark, sf_dir, "orders").withColumn("answer", answer)
    return rows.select("o_orderkey", t.citation("answer")["file"].alias("file"), t.citation("answer")["lines"].alias("lines"), t.without_citations("answer").alias("plain"))


def text_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native against recognised text: the latter is the text without its first half."""
    reason = t.recognition_reason("text")
    picked = t.choose_text(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" end"))).otherwise(F.lit("")), reason)
    return _docs(spark, sf_dir).select("doc_id", reason.alias("reason"), picked["method"].alias("method"), F.length(picked["text"]).alias("chars"))


def session_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("1998-08-02 10:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").groupBy(t.session_bucket(F.col("o_orderdate"), now).alias("bucket")).agg(F.count("*").alias("n"))


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.correct_heading_levels(outline_lines(spark, sf_dir).select("doc_id", "line_num", "line"))


def wrapped_line_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = ln.merge_wrapped(_lines(spark, sf_dir).where(t.strip("line") != "").select("doc_id", "line_num", t.spacing("line").alias("text")), order="line_num")
    return merged.select("doc_id", "line_id", "source_line", "text")


def prepared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.prepare_lines(_lines(spark, sf_dir))


def paragraph_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.paragraphs(_docs(spark, sf_dir))


def final_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.final_cleanup(_lines(spark, sf_dir))


def fence_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = outline_lines(spark, sf_dir).withColumn("line", F.when(F.col("line_num") % 5 == 0, "```").otherwise(F.col("line")))
    return ln.with_fences(fenced.select("doc_id", "line_num", "line")).groupBy("doc_id").agg(F.count_if("in_fence").alias("inside"), F.count_if("is_fence").alias("fences"))


def lossless_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth line is left out of what was rendered."""
    rows = _lines(spark, sf_dir)
    return ln.missing_lines(rows.select("doc_id", F.col("line_num").alias("line_id"), F.col("line").alias("text")), rows.where("line_num % 10 != 0")).select("doc_id", "line_id")


def loss_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against texts of which even documents were put in lower case and odd ones halved."""
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    new = _docs(spark, sf_dir).where("text is not null").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(half).alias("new_text"))
    found = ln.loss_signal(_lines(spark, sf_dir).select("doc_id", F.col("line_num").alias("line_id"), F.col("line").alias("text")), new)
    return found.groupBy("status").agg(F.count("*").alias("n"))


def cited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _docs(spark, sf_dir).where("text is not null").select("doc_id", "text", F.lit(7).alias("line_num"), (F.size(F.split("text", "\n")) + 6).alias("end_line_num"), F.col("source").alias("filename"))
    return ln.cited_blocks(whole.fillna({"filename": "?"})).select("doc_id", "block")


def rendered_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select("doc_id", F.col("line_num").alias("line_id"), t.strip("line").alias("text"))
    return ln.render_markdown(rows, rows.where("line_id % 6 = 1").select("doc_id", "line_id", (F.col("line_id") % 4 + 1).cast("int").alias("level")))


QUERIES = [
    line_explode, marker_kind, numbering_level, line_predicates, spacing_normalise, folded_keys, clipped_texts, smalltalk_gate, page_ranges, citations, text_choice, session_buckets, heading_levels,
    wrapped_line_merge, prepared_lines, paragraph_groups, final_cleanup, fence_parity, lossless_antijoin, loss_signal, cited_lines, rendered_markdown,
]

_KIND = rf"""CASE WHEN regexp_matches(s, '{_CHAPTER}') THEN replace(upper(regexp_extract(s, '{_CHAPTER}', 1)), ' ', '_') WHEN regexp_matches(s, '(?i)^Điều\s+\d+') THEN 'ARTICLE'
  WHEN regexp_matches(s, '^\d+(?:\.\d+)+[.)]?') THEN 'DECIMAL' WHEN regexp_matches(s, '^\d+[.)]') THEN 'NUMBER' WHEN regexp_matches(s, '(?i)^[A-Za-zÀ-ỹĐđ][.)]') THEN 'LETTER'
  WHEN regexp_matches(s, '(?i)^[IVXLCDM]+[.)]') THEN 'ROMAN' WHEN regexp_matches(s, '^[-–•+]') THEN 'BULLET' ELSE '' END"""
_LEVEL = "CASE WHEN kind IN ('PHẦN', 'CHƯƠNG') THEN 1 WHEN kind IN ('MỤC', 'TIỂU_MỤC', 'ARTICLE') THEN 2 WHEN kind IN ('NUMBER', 'DECIMAL', 'ROMAN') THEN 3 WHEN kind = 'LETTER' THEN 4 END"


def _spaced(x: str) -> str:
    """SQL of spacing(): the pattern that looks ahead is applied twice instead."""
    s = rf"regexp_replace(regexp_replace(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '[ \t]+', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g')"
    for _ in range(2):
        s = rf"regexp_replace({s}, '([,.;:!?])(\S)', '\1 \2', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({s}, '\s*/\s*', '/', 'g'), '\s+-\s+', ' - ', 'g'), '^\s+|\s+$', '', 'g')"


_PLAIN = "length(regexp_replace(s, '[^A-Za-zÀ-ỹĐđ0-9]', '', 'g'))"
_GARBAGE = rf"""({_PLAIN} = 0 OR (length(s) <= 8 AND length(regexp_replace(s, '[A-Za-zÀ-ỹĐđ0-9\s]', '', 'g')) >= greatest(2, {_PLAIN} + 1))
  OR (length(s) > 5 AND (length(s) - length(regexp_replace(s, '[.,]', '', 'g')))::DOUBLE / length(s) > 0.4) OR regexp_matches(s, '(?i)^={{2,}}\s*PAGE\s+\d+\s*={{2,}}\s*\d*\s*$')
  OR regexp_matches(s, '^\d+\s*$') OR regexp_matches(s, '(\.\s){{3,}}\.?\s*$') OR regexp_matches(s, '^([A-Za-zÀ-ỹĐđ]\s){{4,}}[A-Za-zÀ-ỹĐđ]$') OR regexp_matches(s, '^([.\-=_*]{{2,}}\s*)+$'))"""
_WORDS = r"(CASE WHEN s = '' THEN 0 ELSE len(regexp_split_to_array(s, '\s+')) END)"
_TITLE = rf"(s <> '' AND NOT {_ANY} AND {_WORDS} <= 12 AND {_RATIO} >= 0.65 AND NOT regexp_matches(s, '[.!?…]$'))"
_LOWER = f"regexp_matches(s, '^[{t.LOWER}]')"
#: Documents have no metadata, footers or numbered chapters, so titles, markers and noise are what is structural.
_MARKED = r"(regexp_matches(s, '^[-–•+]\s+') OR regexp_matches(s, '^\d+[.)]\s+') OR regexp_matches(s, '^\d+(?:\.\d+)+[.)]?\s+') OR regexp_matches(s, '(?i)^[A-Za-zÀ-ỹĐđ][.)]\s+') OR regexp_matches(s, '(?i)^[IVXLCDM]+[.)]\s+'))"

_SPACED_TITLE = rf"(s <> '' AND NOT {_MARKED} AND {_WORDS} <= 12 AND {_RATIO} >= 0.65 AND NOT regexp_matches(s, '[.!?…]$'))"

SQL = {
    "line_explode": f"WITH {LINES_SQL} SELECT * FROM lines",
    "marker_kind": f"WITH {BODY_SQL}, k AS (SELECT doc_id, line_num, {_KIND} AS kind FROM body) SELECT doc_id, line_num, kind, {_LEVEL} AS level FROM k",
    "numbering_level": rf"""WITH {BODY_SQL}, k AS (SELECT *, {_KIND} AS kind FROM body)
SELECT doc_id, line_num, CASE kind WHEN 'CHƯƠNG' THEN 'CHƯƠNG' WHEN 'ARTICLE' THEN trim(regexp_extract(s, '(?i)^Điều\s+\d+[.:]?')) WHEN 'NUMBER' THEN regexp_extract(s, '^\d+[.)]') WHEN 'LETTER' THEN regexp_extract(s, '^.[.)]') END AS numbering,
  CASE WHEN kind = 'LETTER' AND regexp_matches(s, '(?i)^[IVXLCDM][.)]') THEN 3 ELSE coalesce({_LEVEL}, 0) END AS level FROM k""",
    "line_predicates": rf"""WITH {STRIPPED_SQL} SELECT doc_id, line_num, round({_RATIO}, 6) AS upper_ratio, {_LOWER} AS starts_lower, regexp_matches(s, '[.!?…;]$') AS ends_sentence, {_TITLE} AS title_like,
  (s = '' OR ({_PLAIN} <= 1 AND length(s) <= 8) OR regexp_matches(s, '(?i)^={{2,}}\s*PAGE\s+\d+') OR regexp_matches(s, '^\d+\s*$')) AS noise_like, {_GARBAGE} AS garbage FROM st""",
    "spacing_normalise": f"WITH {LINES_SQL} SELECT doc_id, line_num, {_spaced('line')} AS spaced FROM lines",
    "folded_keys": f"WITH {LINES_SQL} SELECT doc_id, line_num, lower(strip_accents(line)) AS plain, trim(regexp_replace(lower(line), '[^a-zà-ỹđ0-9]+', ' ', 'g')) AS key FROM lines",
    "clipped_texts": r"""SELECT doc_id, CASE WHEN length(s) <= 200 THEN s ELSE rtrim(s[1:100]) || ' ... ' || ltrim(right(s, 100)) END AS clipped,
  CASE WHEN length(text) <= 6000 THEN text ELSE text[1:3000] || chr(10) || chr(10) || '...[TRUNCATED]...' || chr(10) || chr(10) || right(text, 3000) END AS truncated
FROM (SELECT *, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s FROM documents)""",
    "smalltalk_gate": rf"""WITH m AS (SELECT conv_id, regexp_replace(regexp_replace(regexp_replace(replace(lower(strip_accents(CASE WHEN turn % 3 = 0 THEN 'Xin chào, ' || text ELSE text END)), 'đ', 'd'), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s FROM conversations)
SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE s IN ({', '.join(repr(g) for g in t.GREETINGS)}) OR (NOT regexp_matches(s, '{"|".join(t.DOCUMENT_WORDS)}') AND regexp_matches(s, '^({"|".join(t.GREETING_STARTS)})\b'))) AS smalltalk FROM m GROUP BY conv_id""",
    "page_ranges": """WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber AS a, CASE WHEN trunc(l_quantity)::INTEGER % 8 = 0 THEN l_linenumber - 1 ELSE l_linenumber + trunc(l_quantity)::INTEGER % 5 END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a <= b THEN array_to_string(list_sort(list_distinct(list_append(range(a::BIGINT, b::BIGINT + 1), (a + 3)::BIGINT))), ' ') END AS pages FROM r""",
    "citations": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'd' || o_custkey || '.md' END AS file, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 90) || '-' || (o_orderkey % 90 + 4) END AS lines,
  o_orderpriority || CASE WHEN o_orderkey % 3 = 2 THEN ' .' ELSE '' END AS plain FROM orders""",
    "text_choice": r"""WITH n AS (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents), r AS (SELECT *, CASE WHEN length(s) < 500 THEN 'native_text_too_short' ELSE 'native_text_enough' END AS reason FROM n)
SELECT doc_id, reason, CASE WHEN doc_id % 2 = 1 THEN 'native_text_selected_ocr_empty' WHEN s = '' THEN 'ocr_selected_native_empty' ELSE 'ocr_selected_longer_text' END AS method,
  CASE WHEN doc_id % 2 = 1 THEN length(s) ELSE length(regexp_replace(text || ' end', '^\s+|\s+$', '', 'g')) END AS chars FROM r""",
    "session_buckets": """SELECT CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d <= 7 THEN 'last 7 days' ELSE 'older' END AS bucket, count(*) AS n
FROM (SELECT date_diff('day', o_orderdate::DATE, DATE '1998-08-02') AS d FROM orders) GROUP BY 1""",
    "heading_levels": f"""WITH {OUTLINE_SQL}, k AS (SELECT doc_id, line_num, s, {_KIND} AS kind FROM (SELECT doc_id, line_num, regexp_replace(line, '^#+ ', '') AS s FROM outline)) SELECT doc_id, line_num, repeat('#', {_LEVEL}) || ' ' || s AS line FROM k""",
    "wrapped_line_merge": rf"""WITH {LINES_SQL}, sp AS (SELECT doc_id, line_num, {_spaced('line')} AS s FROM lines WHERE regexp_replace(line, '\s+', '', 'g') <> ''),
f AS (SELECT *, ({_GARBAGE} OR {_MARKED} OR (s <> '' AND NOT {_MARKED} AND {_WORDS} <= 12 AND {_RATIO} >= 0.65 AND NOT regexp_matches(s, '[.!?…]$'))) AS hard, {_LOWER} AS low,
  regexp_matches(lower(s), '^({'|'.join(t.CONNECTIVES)})') AS joint, lag(s) OVER (PARTITION BY doc_id ORDER BY line_num) AS p FROM sp),
m AS (SELECT *, coalesce(p <> '' AND s <> '' AND NOT hard AND (CASE WHEN regexp_matches(p, '[,\-–(/:]$') THEN 4 ELSE 0 END + CASE WHEN p LIKE '%;' THEN 3 ELSE 0 END + CASE WHEN NOT regexp_matches(p, '([.?!]|…")$') THEN 3 ELSE 0 END
  + CASE WHEN low THEN 3 ELSE 0 END + CASE WHEN joint THEN 2 ELSE 0 END - CASE WHEN regexp_matches(p, '[.?!]$') THEN 5 ELSE 0 END - CASE WHEN p LIKE '%…"' THEN 4 ELSE 0 END) >= 4, false) AS merge FROM f),
i AS (SELECT *, sum(CASE WHEN merge THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_num) AS island FROM m),
g AS (SELECT doc_id, island, min(line_num) AS source_line, count(*) AS n, string_agg(s, ' ' ORDER BY line_num) AS raw FROM i GROUP BY doc_id, island)
SELECT doc_id, island::INTEGER AS line_id, source_line, CASE WHEN n = 1 THEN raw ELSE {_spaced('raw')} END AS text FROM g""",
    "fence_parity": f"""WITH {OUTLINE_SQL}, f AS (SELECT doc_id, line_num % 5 = 0 AS is_fence, count(*) FILTER (WHERE line_num % 5 = 0) OVER (PARTITION BY doc_id ORDER BY line_num) % 2 = 1 AS odd FROM outline)
SELECT doc_id, count(*) FILTER (WHERE odd AND NOT is_fence) AS inside, count(*) FILTER (WHERE is_fence) AS fences FROM f GROUP BY doc_id""",
    "lossless_antijoin": rf"""WITH {STRIPPED_SQL}, r AS (SELECT DISTINCT doc_id, regexp_replace(regexp_replace(line, '^#{{1,6}}\s+', ''), '^\s+|\s+$', '', 'g') AS s FROM lines WHERE line_num % 10 <> 0)
SELECT doc_id, line_num AS line_id FROM st WHERE s <> '' AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = st.doc_id AND r.s = st.s)""",
    "loss_signal": rf"""WITH {STRIPPED_SQL}, n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lower(text) ELSE text[1:length(text) // 2] END AS new_text FROM documents WHERE text IS NOT NULL),
j AS (SELECT st.doc_id, s, new_text, trim(regexp_replace(lower(s), '[^a-zà-ỹđ0-9]+', ' ', 'g')) AS key, trim(regexp_replace(lower(new_text), '[^a-zà-ỹđ0-9]+', ' ', 'g')) AS new_key FROM st JOIN n USING (doc_id) WHERE length(s) >= 12 AND NOT {_GARBAGE})
SELECT CASE WHEN contains(new_text, s) OR contains(regexp_replace(new_text, '\s+', ' ', 'g'), regexp_replace(s, '\s+', ' ', 'g')) THEN 'EXACT_FOUND' WHEN key <> '' AND contains(new_key, key) THEN 'FUZZY_FOUND' ELSE 'MISSING' END AS status, count(*) AS n FROM j GROUP BY 1""",
    "cited_lines": """WITH d AS (SELECT doc_id, coalesce(source, '?') AS f, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
SELECT doc_id, '[Nguồn: ' || f || ', Dòng: 7-' || (len(ls) + 6) || ']' || chr(10) || array_to_string(list_transform(range(1, len(ls) + 1), lambda i: '[' || (i + 6) || '] ' || ls[i]), chr(10)) AS block FROM d""",
    "rendered_markdown": rf"""WITH {STRIPPED_SQL}, h AS (SELECT doc_id, line_num, s, line_num % 6 = 1 AS head, lag(s) OVER w AS before, lag(line_num % 6 = 1) OVER w AS previous FROM st WINDOW w AS (PARTITION BY doc_id ORDER BY line_num))
SELECT doc_id, regexp_replace(string_agg(CASE WHEN head THEN CASE WHEN before IS NULL OR previous OR before = '' THEN '' ELSE chr(10) END || repeat('#', (line_num % 4 + 1)::INTEGER) || ' ' || s || chr(10) ELSE s END, chr(10) ORDER BY line_num), '\s+$', '') || chr(10) AS text FROM h GROUP BY doc_id""",
}

#: Documents have no page marks, letterheads or labels to repair, so of the rules those about stray marks are left.
_RULED = "regexp_replace(regexp_replace(regexp_replace({x}, '^[_]+\\s+', '', 'g'), ',\\s*\\.\\s*', ', ', 'g'), '\\.\\s+\\.\\s+\\.', '...', 'g')"


def _ruled(x: str) -> str:
    return _spaced(_RULED.format(x=_spaced(x)))


#: Cleaned lines (doc_id, line_id, s).
PREPARED_SQL = rf"""{LINES_SQL}, ruled AS (SELECT doc_id, line_num, {_ruled("line")} AS s FROM lines WHERE {_spaced("line")} <> ''),
prepared AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_num) AS line_id, s FROM ruled WHERE NOT {_GARBAGE})"""

_MERGED = SQL["wrapped_line_merge"]
SQL |= {
    "prepared_lines": f"WITH {PREPARED_SQL} SELECT doc_id, line_id::INTEGER AS line_id, s AS text, NULL::INTEGER AS page FROM prepared",
    "final_cleanup": rf"""WITH merged AS ({_MERGED.replace("f AS (SELECT *,", f"clean AS (SELECT * FROM sp WHERE NOT {_GARBAGE}), f AS (SELECT *,", 1).replace("ORDER BY line_num) AS p FROM sp)", "ORDER BY line_num) AS p FROM clean)", 1)}),
j AS (SELECT doc_id, string_agg({_ruled("text")}, chr(10) ORDER BY line_id) AS text FROM merged GROUP BY doc_id)
SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g') || chr(10) AS text FROM j""",
}
