"""Queries of retrieval, statistics, geometry and spelling, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import geometry, retrieval, spell, stats
from ..sources import store
from ..streaming import ingest
from . import derived
from .derived import BOXES_SQL, CHUNKS_SQL, ITEMS_SQL, STATS_SQL, chunks, spread, table, unique_items

QUERY = [((i * 37) % 64 - 31.5) / 32 for i in range(64)]
QUESTION = "where the edth thar Und"
_QUERY_SQL = "[" + ", ".join(str(x) for x in QUERY) + "]::DOUBLE[]"
_WORDS_SQL = "[" + ", ".join(f"'{w}'" for w in v.query_words(QUESTION)) + "]"
_COSINE = f"(list_dot_product(vector, {_QUERY_SQL}) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product({_QUERY_SQL}, {_QUERY_SQL}))))"
_OVERLAP = f"(len(list_filter({_WORDS_SQL}, lambda w: contains(lower(text), w)))::DOUBLE / {len(v.query_words(QUESTION))})"
SCORED_SQL = CHUNKS_SQL + f", scored AS (SELECT chunk_id, doc_id, text, {_COSINE} + 0.5 * {_OVERLAP} AS score FROM chunks)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.scored(chunks(spark, sf_dir), QUERY, QUESTION)


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_chunks(_scored(spark, sf_dir)).select("chunk_id", "doc_id", F.round("score", 6).alias("score"))


def hybrid_topk_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_per_document(_scored(spark, sf_dir)).select("chunk_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def cosine_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("cos", v.cosine(F.col("embedding"), retrieval.vector_column(QUERY)))
    return vectors.groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("cos"), 6).alias("best"), F.round(F.avg("cos"), 6).alias("mean"))


def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(v.keyword_overlap(v.query_words(QUESTION), F.col("text")), 6).alias("overlap"))


def ask_global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rank_documents(_scored(spark, sf_dir)).select("doc_id", F.round("doc_score", 6).alias("doc_score"), "accepted")


def answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = retrieval.top_per_document(_scored(spark, sf_dir), k=2)
    rows = top.withColumns({"line_num": F.lit(1), "end_line_num": F.size(F.split("text", "\n")), "filename": F.concat(F.lit("d"), F.col("doc_id"))})
    return retrieval.answer_context(rows).select("doc_id", F.md5("context").alias("context_md5"))


def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("f"), F.col("vec_id")).alias("filename"), F.lit("s").alias("summary"), F.col("embedding").alias("summary_vector"))
    return retrieval.search_catalogue(entries, QUERY, accept=0.2).select("doc_id", "filename", "rank", F.round("score", 6).alias("score"))


def history_last5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.last_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "back")


def history_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.history_prompts(table(spark, sf_dir, "conversations")).select("conv_id", F.md5("history").alias("history_md5"))


def admin_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.admin_statistics(*(f(spark, sf_dir) for f in (derived.stored_documents, derived.users, derived.sessions, derived.messages)))


def document_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of what a reader may see, dearest first."""
    seen = stats.visible_documents(derived.stored_documents(spark, sf_dir), "nguoi_dung")
    return stats.page_of(seen, [F.desc("price"), F.col("id")], page=3, page_size=20).select("id", "filename", "status")


def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.concat(F.lit("file "), "doc_id").alias("filename"))
    return stats.recent_sessions(derived.sessions(spark, sf_dir), docs).select("id", "doc_id", "name")


def route_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(*(F.lit(p) for p in ("/upload/new", "/stats", "/chat", "/files", "/users/1"))), (F.col("id") % 5 + 1).cast("int"))
    rows = derived.users(spark, sf_dir).select(path.alias("path"), "role", stats.allowed_route(path, F.col("role")).alias("allowed"))
    return rows.groupBy("path", "role", "allowed").agg(F.count("*").alias("n"))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in each table after ten documents are deleted."""
    sessions, messages = derived.sessions(spark, sf_dir), derived.messages(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"))
    gone = docs.where(F.col("id").isin(*(f"d{i}" for i in range(10)))).select(F.col("id").alias("doc_id"))
    left = store.delete_cascading({"documents": docs, "sessions": sessions, "messages": messages}, gone)
    counts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, rows in sorted(left.items())]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "nation").where("n_nationkey < 15").select("n_name", "n_regionkey")
    new = table(spark, sf_dir, "nation").where("n_nationkey >= 10").select("n_name", F.lit(9).alias("n_regionkey"))
    return store.insert_missing(old, new, "n_name")


def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), "event_type", F.concat("event_type", F.lit(":"), "event_id").alias("payload"), F.struct("ts", "event_id").alias("updated_at"))
    return stats.known_progress([events.where(f"event_type = '{kind}'") for kind in ("error", "purchase", "view")])


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.event_windows(table(spark, sf_dir, "events"))
    return found.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def titled_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    sessions = said.select(F.col("conv_id").alias("id")).distinct().withColumn("title", F.when(F.col("id") % 4 == 0, "kept").otherwise(""))
    messages = said.select(F.col("conv_id").alias("session_id"), "role", F.col("text").alias("content"), F.col("turn").alias("created_at"), F.col("turn").alias("id"))
    return stats.titled_sessions(sessions, messages).select("id", "title")


def box_overlap_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    small, wide = derived.boxes(spark, sf_dir)
    return geometry.best_overlap(small, wide).select("page", "box_id", "region_id")


def box_first_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    small, wide = derived.boxes(spark, sf_dir)
    return geometry.first_overlap(small, wide).select("page", "box_id", "region_id")


def box_tightest_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    small, wide = derived.boxes(spark, sf_dir)
    return geometry.tightest_fit(small.withColumn("layoutno", F.concat(F.lit("t"), F.col("box_id") % 3)), wide.withColumn("layoutno", F.concat(F.lit("t"), F.col("box_id") % 3))).select("page", "box_id", "column_id")


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.reading_order(derived.boxes(spark, sf_dir)[0], gap=4.0).select("page", "box_id", "band", "position")


def repeated_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = derived.boxes(spark, sf_dir)[0].withColumn("text", F.concat(F.lit(" p"), F.col("box_id") % 7))
    return geometry.without_repeated_garbage(small, small.where("box_id % 7 < 3 and box_id < 17")).select("page", "box_id")


def cell_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.element_at(F.array(F.col("l_shipdate").cast("date").cast("string"), F.col("l_quantity").cast("string"), F.col("l_returnflag"), F.concat("l_returnflag", F.lit("-12")), F.lit("plain words"), F.lit("One Two three Four")), F.col("l_linenumber") % 6 + 1)
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber", geometry.cell_type(words).alias("cell_type")).agg(F.count("*").alias("n"))


def row_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_linenumber") % 3 == 0, "table column").otherwise("table row")
    parts = item.select(F.col("l_orderkey").alias("table_id"), "l_linenumber", label.alias("label"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 40).alias("x1"), (F.col("l_linenumber") * 7.0).alias("top"), (F.col("l_linenumber") * 9.0 + 20).alias("bottom"))
    return geometry.align_rows(parts).select("table_id", "l_linenumber", *(F.round(c, 6).alias(c) for c in ("x0", "x1", "top", "bottom")))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = unique_items(spark, sf_dir)
    return item.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("box_id"), F.floor((F.col("l_linenumber") + 1) / 2).alias("R"), (F.col("l_linenumber") % 2).alias("C"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), F.concat("l_returnflag", F.col("l_quantity").cast("int")).alias("text"))


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.table_markdown(_cells(spark, sf_dir))


def table_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.table_sentences(_cells(spark, sf_dir))


def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = derived.boxes(spark, sf_dir)[0]
    scored = small.select("page", (F.col("box_id") % 3).alias("kind"), "box_id", "x0", "x1", "top", "bottom", (F.col("box_id") * 31 % 101 / 101.0).alias("score"))
    return geometry.suppress(scored).select("page", "kind", "box_id")


def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = unique_items(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity").cast("int") % 4).alias("x")))).alias("s"))
    letters = F.array(*(F.lit(x) for x in "_abc"))
    return labels.select("l_orderkey", geometry.ctc_text(F.transform("s", lambda r: r["x"]), letters).alias("text"))


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents with their counts; rare ones are left for the speller to find."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("term"))
    return spell.dictionary(words.groupBy("term").agg(F.count("*").alias("count")).where("count >= 20 and length(term) >= 3"))


def base_form_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spell.base_forms(_dictionary(spark, sf_dir))


def edit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt part names: the second letter doubled, the last one gone."""
    words = spell.dictionary(table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), "[^a-z]+")).alias("term")).where("term != ''").groupBy("term").agg(F.count("*").alias("count")))
    asked = words.select(F.concat(F.substring("term", 1, 2), F.substring("term", 2, 20)).alias("token")).unionByName(words.select(F.expr("substring(term, 1, length(term) - 1)").alias("token")))
    return spell.near_terms(asked.where("length(token) > 2").distinct(), words)


def flagged_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spell.flagged_in_context(texts, _dictionary(spark, sf_dir)).select("doc_id", "token", "position", F.array_join("reasons", ",").alias("reasons"), F.array_join("candidates", ",").alias("candidates"))


def applied_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    at = F.expr("array(3, 12, 40)")
    fixes = texts.select("doc_id", "text", F.explode(at).alias("position")).select("doc_id", F.substring(F.col("text"), F.col("position") + 1, F.lit(2)).alias("token"), "position")
    fixes = fixes.where(F.col("token").rlike("^[a-z]{2}$")).withColumn("candidates", F.array(F.concat(F.reverse("token"), F.lit("x"))))
    return spell.apply_fixes(texts, fixes).select("doc_id", F.md5("text").alias("text_md5"))


QUERIES = [
    hybrid_topk, hybrid_topk_per_document, cosine_by_label, keyword_overlap, ask_global_rank, answer_context, catalogue_search, history_last5, history_prompts, admin_statistics, document_page, recent_sessions, route_access,
    cascade_delete, insert_missing, progress_latest, event_windows, titled_sessions, box_overlap_argmax, box_first_overlap, box_tightest_fit, reading_order, repeated_garbage, cell_types, row_align, table_markdown, table_sentences,
    box_suppression, ctc_decode, base_form_candidates, edit_candidates, flagged_tokens, applied_fixes,
]


def _overlap_sql(a: str, b: str) -> str:
    """Share of box a that box b covers."""
    return f"(greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.bottom, {b}.bottom) - greatest({a}.top, {b}.top)) / (({a}.x1 - {a}.x0) * ({a}.bottom - {a}.top)))"


_GRID_SQL = ITEMS_SQL + """,
cells AS (SELECT l_orderkey AS table_id, (l_linenumber + 1) // 2 AS r, l_linenumber % 2 AS c, l_returnflag || trunc(l_quantity)::INTEGER AS text FROM items),
grid AS (SELECT table_id, dense_rank() OVER (PARTITION BY table_id ORDER BY r) AS row_no, dense_rank() OVER (PARTITION BY table_id ORDER BY c) AS col_no, text FROM cells)"""
_PART_WORDS = "words AS (SELECT term, count(*) AS freq FROM (SELECT unnest(regexp_split_to_array(lower(p_name), '[^a-z]+')) AS term FROM part) WHERE term <> '' GROUP BY term)"

SQL = {
    "hybrid_topk": f"WITH {SCORED_SQL} SELECT chunk_id, doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, chunk_id LIMIT 5",
    "hybrid_topk_per_document": f"WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_id) AS rank FROM scored) SELECT chunk_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5",
    "cosine_by_label": f"SELECT label, count(*) AS n, round(max({_COSINE}), 6) AS best, round(avg({_COSINE}), 6) AS mean FROM (SELECT label, embedding::DOUBLE[] AS vector FROM embeddings) GROUP BY label",
    "keyword_overlap": f"SELECT doc_id, round({_OVERLAP}, 6) AS overlap FROM documents",
    "ask_global_rank": f"WITH {SCORED_SQL}, b AS (SELECT doc_id, max(score) AS s FROM scored GROUP BY doc_id) SELECT doc_id, round(s, 6) AS doc_score, row_number() OVER (ORDER BY s DESC, doc_id) = 1 AND s >= 0.35 AS accepted FROM b",
    "answer_context": f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_id) AS rank, string_split(text, chr(10)) AS ls FROM scored),
b AS (SELECT doc_id, rank, '[Nguồn: d' || doc_id || ', Dòng: 1-' || len(ls) || ']' || chr(10) || array_to_string(list_transform(range(1, len(ls) + 1), lambda i: '[' || i || '] ' || ls[i]), chr(10)) AS block FROM r WHERE rank <= 2)
SELECT doc_id, md5(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM b GROUP BY doc_id""",
    "catalogue_search": f"""WITH s AS (SELECT vec_id AS doc_id, {_COSINE} AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS vector FROM embeddings)), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT doc_id, 'f' || doc_id AS filename, rank, round(score, 6) AS score FROM r WHERE rank <= 3 AND (score > 0.2 OR rank = 1)""",
    "history_last5": "SELECT conv_id, turn, role, back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 5",
    "history_prompts": "SELECT conv_id, md5(string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn)) AS history_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 5 GROUP BY conv_id",
    "admin_statistics": f"""WITH {STATS_SQL}, asked AS (SELECT s.user_id, s.doc_id FROM messages m JOIN sessions s ON s.id = m.session_id WHERE m.role = 'user')
SELECT 'total' AS section, 'documents' AS key, count(*) AS n FROM docs UNION ALL SELECT 'total', 'users', count(*) FROM users UNION ALL SELECT 'total', 'sessions', count(*) FROM sessions UNION ALL SELECT 'total', 'questions', count(*) FROM messages WHERE role = 'user'
UNION ALL SELECT 'documents_by_status', d.k, count(docs.id) FROM (SELECT unnest([{', '.join(repr(x) for x in stats.STATUSES)}]) AS k) d LEFT JOIN docs ON docs.status = d.k GROUP BY d.k
UNION ALL SELECT 'users_by_role', d.k, count(users.id) FROM (SELECT unnest([{', '.join(repr(x) for x in stats.ROLES)}]) AS k) d LEFT JOIN users ON users.role = d.k GROUP BY d.k
UNION ALL SELECT 'sessions_by_role', role, count(*) FROM users JOIN sessions ON sessions.user_id = users.id GROUP BY role UNION ALL SELECT 'questions_by_role', role, count(*) FROM users JOIN asked ON asked.user_id = users.id GROUP BY role
UNION ALL SELECT 'feature_usage', '{stats.ASKED_GLOBALLY}', count(*) FROM asked WHERE doc_id = '__global__' UNION ALL SELECT 'feature_usage', '{stats.ASKED_OF_DOCUMENT}', count(*) FROM asked WHERE doc_id <> '__global__'""",
    "document_page": "SELECT p_partkey AS id, p_name AS filename, CASE p_partkey % 4 WHEN 1 THEN 'processed' ELSE 'vector_processed' END AS status FROM part WHERE p_partkey % 4 IN (1, 2) ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40",
    "recent_sessions": f"""WITH {STATS_SQL}, s AS (SELECT sessions.id, sessions.doc_id FROM sessions JOIN orders ON o_orderkey = id ORDER BY o_orderdate DESC, id LIMIT 9)
SELECT s.id, s.doc_id, CASE WHEN s.doc_id = '__global__' THEN '{stats.ASKED_GLOBALLY}' ELSE coalesce('file ' || d.doc_id, s.doc_id) END AS name FROM s LEFT JOIN documents d ON 'd' || d.doc_id = s.doc_id""",
    "route_access": f"""WITH {STATS_SQL}, p AS (SELECT (['/upload/new', '/stats', '/chat', '/files', '/users/1'])[(id % 5 + 1)::INTEGER] AS path, role FROM users)
SELECT path, role, CASE WHEN path IN ('/upload/new', '/files') THEN role <> 'nguoi_dung' WHEN path IN ('/stats', '/users/1') THEN role = 'admin' ELSE true END AS allowed, count(*) AS n FROM p GROUP BY ALL""",
    "cascade_delete": f"""WITH {STATS_SQL}, gone AS (SELECT 'd' || doc_id AS doc_id FROM documents WHERE doc_id < 10)
SELECT 'documents' AS name, count(*) AS n FROM documents WHERE 'd' || doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'sessions', count(*) FROM sessions WHERE doc_id NOT IN (SELECT doc_id FROM gone)
UNION ALL SELECT 'messages', count(*) FROM messages WHERE session_id NOT IN (SELECT id FROM sessions WHERE doc_id IN (SELECT doc_id FROM gone))""",
    "insert_missing": "SELECT n_name, CASE WHEN n_nationkey < 15 THEN n_regionkey ELSE 9 END AS n_regionkey FROM nation",
    "progress_latest": """WITH r AS (SELECT user_id, event_type, event_type || ':' || event_id AS payload, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type IN ('error', 'purchase', 'view'))
SELECT user_id AS document_id, arg_min(payload, event_type) AS payload FROM r WHERE k = 1 GROUP BY user_id""",
    "event_windows": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "titled_sessions": """WITH q AS (SELECT conv_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT s.conv_id AS id, CASE WHEN s.conv_id % 4 = 0 THEN 'kept' ELSE q[1:100] END AS title FROM (SELECT DISTINCT conv_id FROM conversations) s LEFT JOIN q ON q.conv_id = s.conv_id""",
    "box_overlap_argmax": f"""WITH {BOXES_SQL}, p AS (SELECT b.page, b.box_id, r.box_id AS region_id, {_overlap_sql('b', 'r')} AS o, {_overlap_sql('r', 'b')} AS q FROM boxes b JOIN regions r ON r.page = b.page),
k AS (SELECT *, row_number() OVER (PARTITION BY page, box_id ORDER BY o DESC, q DESC, region_id DESC) AS n FROM p WHERE o >= 0.3) SELECT b.page, b.box_id, k.region_id FROM boxes b LEFT JOIN k ON k.page = b.page AND k.box_id = b.box_id AND n = 1""",
    "box_first_overlap": f"""WITH {BOXES_SQL}, p AS (SELECT b.page, b.box_id, r.box_id AS region_id, {_overlap_sql('r', 'b')} AS o FROM boxes b JOIN regions r ON r.page = b.page),
k AS (SELECT *, row_number() OVER (PARTITION BY page, box_id ORDER BY o DESC, region_id) AS n FROM p WHERE o > 0) SELECT b.page, b.box_id, k.region_id FROM boxes b LEFT JOIN k ON k.page = b.page AND k.box_id = b.box_id AND n = 1""",
    "box_tightest_fit": f"""WITH {BOXES_SQL}, p AS (SELECT b.page, b.box_id, r.box_id AS column_id, least(abs(b.x0 - r.x0), abs(b.x1 - r.x1), abs(b.x0 + b.x1 - r.x0 - r.x1) / 2) AS d FROM boxes b JOIN regions r ON r.page = b.page AND r.box_id % 3 = b.box_id % 3),
k AS (SELECT *, row_number() OVER (PARTITION BY page, box_id ORDER BY d, column_id) AS n FROM p) SELECT b.page, b.box_id, k.column_id FROM boxes b LEFT JOIN k ON k.page = b.page AND k.box_id = b.box_id AND n = 1""",
    "reading_order": f"""WITH {BOXES_SQL}, g AS (SELECT *, CASE WHEN top - lag(top) OVER w <= 4 THEN 0 ELSE 1 END AS o FROM boxes WINDOW w AS (PARTITION BY page ORDER BY top, box_id)), b AS (SELECT *, sum(o) OVER (PARTITION BY page ORDER BY top, box_id) AS band FROM g)
SELECT page, box_id, band, row_number() OVER (PARTITION BY page ORDER BY band, x0, box_id) AS position FROM b""",
    "repeated_garbage": f"WITH {BOXES_SQL}, o AS (SELECT box_id % 7 AS k FROM boxes WHERE box_id % 7 < 3 AND box_id < 17 GROUP BY 1 HAVING count(*) > 1) SELECT page, box_id FROM boxes WHERE box_id % 7 NOT IN (SELECT k FROM o)",
    "cell_types": """SELECT l_linenumber, CASE l_linenumber % 6 WHEN 0 THEN CASE WHEN l_shipdate::DATE::VARCHAR SIMILAR TO '(20|19).*' THEN 'Dt' ELSE 'Nu' END WHEN 1 THEN 'Nu' WHEN 2 THEN 'Ca' WHEN 3 THEN 'Ca' WHEN 4 THEN 'En' ELSE 'Tx' END AS cell_type, count(*) AS n FROM lineitem GROUP BY ALL""",
    "row_align": """WITH p AS (SELECT l_orderkey AS t, l_linenumber, l_linenumber % 3 = 0 AS tall, l_quantity AS x0, l_quantity + 40 AS x1, l_linenumber * 7.0::DOUBLE AS top, l_linenumber * 9.0::DOUBLE + 20 AS bottom FROM lineitem),
s AS (SELECT t, count(*) FILTER (WHERE NOT tall) AS n, min(x0) FILTER (WHERE NOT tall) AS l, max(x1) FILTER (WHERE NOT tall) AS r, avg(x0) FILTER (WHERE NOT tall) AS al, avg(x1) FILTER (WHERE NOT tall) AS ar, CASE WHEN count(*) FILTER (WHERE tall) > 4 THEN median(top) FILTER (WHERE tall) ELSE min(top) FILTER (WHERE tall) END AS a, CASE WHEN count(*) FILTER (WHERE tall) > 4 THEN median(bottom) FILTER (WHERE tall) ELSE max(bottom) FILTER (WHERE tall) END AS b FROM p GROUP BY t)
SELECT p.t AS table_id, l_linenumber, round(CASE WHEN tall THEN x0 ELSE least(x0, CASE WHEN n > 4 THEN al ELSE l END) END, 6) AS x0, round(CASE WHEN tall THEN x1 ELSE greatest(x1, CASE WHEN n > 4 THEN ar ELSE r END) END, 6) AS x1,
  CASE WHEN tall THEN least(top, a) ELSE top END AS top, CASE WHEN tall THEN greatest(bottom, b) ELSE bottom END AS bottom FROM p JOIN s ON s.t = p.t""",
    "table_markdown": f"""WITH {_GRID_SQL}, w AS (SELECT table_id, max(col_no) AS width FROM grid GROUP BY table_id), r AS (SELECT table_id, row_no, '| ' || string_agg(coalesce(text, ''), ' | ' ORDER BY col_no) || ' |' AS line
  FROM (SELECT rows.table_id, rows.row_no, cols.col_no, grid.text FROM (SELECT DISTINCT table_id, row_no FROM grid) rows JOIN (SELECT table_id, unnest(range(1, width + 1)) AS col_no FROM w) cols ON cols.table_id = rows.table_id LEFT JOIN grid ON grid.table_id = rows.table_id AND grid.row_no = rows.row_no AND grid.col_no = cols.col_no) GROUP BY ALL)
SELECT r.table_id, string_agg(CASE WHEN row_no = 1 THEN line || chr(10) || '|' || repeat(' --- |', width) ELSE line END, chr(10) ORDER BY row_no) AS markdown FROM r JOIN w ON w.table_id = r.table_id GROUP BY r.table_id""",
    "table_sentences": f"""WITH {_GRID_SQL} SELECT g.table_id, g.row_no, string_agg(CASE WHEN coalesce(h.text, '') = '' THEN g.text ELSE h.text || ': ' || g.text END, '; ' ORDER BY g.col_no) AS text
FROM grid g LEFT JOIN grid h ON h.table_id = g.table_id AND h.row_no = 1 AND h.col_no = g.col_no WHERE g.row_no > 1 GROUP BY ALL""",
    "ctc_decode": f"""WITH {ITEMS_SQL}, l AS (SELECT l_orderkey, l_linenumber, trunc(l_quantity)::INTEGER % 4 AS x, lag(trunc(l_quantity)::INTEGER % 4) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS p FROM items)
SELECT l_orderkey, coalesce(string_agg((['_', 'a', 'b', 'c'])[x + 1], '' ORDER BY l_linenumber) FILTER (WHERE x <> 0 AND x IS DISTINCT FROM p), '') AS text FROM l GROUP BY l_orderkey""",
    "base_form_candidates": r"""WITH w AS (SELECT term, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents) GROUP BY term HAVING count(*) >= 20 AND length(term) >= 3)
SELECT strip_accents(term) AS base, term, freq FROM w WHERE strip_accents(term) <> term""",
    "edit_candidates": f"""WITH {_PART_WORDS}, a AS (SELECT DISTINCT token FROM (SELECT term[1:2] || term[2:21] AS token FROM words UNION ALL SELECT term[1:length(term) - 1] FROM words) WHERE length(token) > 2),
d AS (SELECT token, term, levenshtein(token, term) AS distance, freq FROM a, words WHERE levenshtein(token, term) <= 2), m AS (SELECT *, min(distance) OVER (PARTITION BY token) AS least FROM d) SELECT token, term, distance, freq FROM m WHERE distance = least""",
    "applied_fixes": """WITH p AS (SELECT doc_id, text, [x for x in [3, 12, 40] if regexp_full_match(text[x + 1 : x + 2], '[a-z]{2}')] AS spots FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, text, list_concat([0], list_transform(spots, lambda x: x + 2)) AS starts, list_concat(spots, [length(text)]) AS ends, spots FROM p)
SELECT doc_id, md5(array_to_string(list_transform(range(1, len(starts) + 1), lambda i: text[starts[i] + 1 : ends[i]] || CASE WHEN i <= len(spots) THEN reverse(text[spots[i] + 1 : spots[i] + 2]) || 'x' ELSE '' END), '')) AS text_md5 FROM b""",
}
