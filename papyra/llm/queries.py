"""The operators' queries over the tables of a folder, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bestfit, decontaminate, licenses, linededup, minhash, mixing, negatives, quality, sharding, urlfilter, variants, warc
from .common import materialise, table

KEEP_SCORE = 0.3
#: (verdict, host and start of the path)
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    facts, placed = sharding.assign(docs, shards=16)
    # Written, so that the numbers of the slots and their starts come from the same rows.
    rows = placed(facts).select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", "_h", "_salt", "_row")
    out = sharding.with_slots(materialise(rows, "placed"), [F.col("_salt"), F.col("_h"), F.col("_row")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.site_line_dedup(table(spark, sf_dir, "pages")).select("page_id", "host", "clean_text", "n_lines", "n_dropped")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.fit(docs, labels.where(~quality.is_held_out()))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir)).withColumnRenamed("quality_score", "score")
    return scored.select("doc_id", quality.is_held_out().alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


#: The vocabulary file of op11; a parameter of the operator, found where the tokenizers are installed.
TOKENIZER = "word_bpe_49k.json"


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = bestfit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), capacity=4096, end_id=1)
    return packed.drop("ids")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumns({"label": noisy, "embedding": negatives.quantised("embedding")})
    return negatives.hard_negatives(rows, k=5, positives=5, every=100, low=(80, 100))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_groups(variants.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_linededup, op3_mixing, op4_licenses, op5_ann, op6_decontamination, op7_urlfilter, op8_minhash, op9_warc, op10_quality, op11_packing, op12_negatives, op13_variants)}


#: Brute force over all pairs that share a shingle; components by recursion.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 2))) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    list_filter(list_transform(
      regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script\b.*?</script>', chr(10), 'gis'), '<style\b.*?</style>', chr(10), 'gis'), '<!--.*?-->', chr(10), 'gs'), '<[^>]*>', chr(10), 'g'), '[\n\r]+'),
      lambda x: regexp_replace(regexp_replace(x, '^[\x09-\x0D ]+', ''), '[\x09-\x0D ]+$', '')), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS total FROM p GROUP BY host),
d AS (SELECT host, line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) JOIN t USING (host)
  GROUP BY host, line, total HAVING count(*) >= 3 AND count(*) > 0.3 * total),
b AS (SELECT host, list(line) AS drops FROM d GROUP BY host)
SELECT page_id, host, array_to_string(list_filter(lines, lambda x: NOT list_contains(coalesce(drops, []), x)), chr(10)) AS clean_text,
  len(lines) AS n_lines, len(list_filter(lines, lambda x: list_contains(coalesce(drops, []), x))) AS n_dropped
FROM p LEFT JOIN b USING (host)
"""

#: base32 of a SHA-1 digest: character i holds the five bits from bit 5 i on.
OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) || '0' AS x FROM p),
g AS (
  SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY x) AS first_id, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((16 * (position(substr(x, 1 + (i * 5) // 4, 1) IN '0123456789abcdef') - 1)
      + position(substr(x, 2 + (i * 5) // 4, 1) IN '0123456789abcdef') - 1) >> (3 - (i * 5) % 4)) & 31)::INTEGER, 1)), '') AS payload_digest
  FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g
"""


#: All anchors against all rows.
OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM r a JOIN r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""


#: crc32 by a table of its rule and a step a byte; near words by what they have in common without one code point.
OP13_SQL = """
WITH RECURSIVE
t AS (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents WHERE text IS NOT NULL),
occ AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS c, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS hx FROM runs WHERE length(run) >= 5 GROUP BY ALL),
crc(doc_id, run, rest, v) AS (
  SELECT doc_id, run, hx, 4294967295::BIGINT FROM occ
  UNION ALL
  SELECT doc_id, run, substr(rest, 3), xor(crc.v >> 8, t.v) FROM crc
  JOIN t ON t.i = xor(crc.v & 255, 16 * (position(rest[1] IN '0123456789ABCDEF') - 1) + position(rest[2] IN '0123456789ABCDEF') - 1)
  WHERE rest <> ''),
h AS (SELECT doc_id, run, xor(v, 4294967295) AS h FROM crc WHERE rest = ''),
w AS MATERIALIZED (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % 97 = 0 THEN substr(occ.run, 1, (h % length(occ.run))::BIGINT) || substr(occ.run, (h % length(occ.run))::BIGINT + 2) ELSE occ.run END AS word
    FROM occ JOIN h ON h.run = occ.run AND h.doc_id IS NOT DISTINCT FROM occ.doc_id)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
d AS MATERIALIZED (
  SELECT word, n, length(word) AS len, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
e AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.len = b.len AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.less = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.less = w.word),
f AS MATERIALIZED (
  SELECT w.word, w.n, count(e.near) AS n_near, arg_min(e.near, (-e.near_n, e.near)) AS best, max(e.near_n) AS best_n
  FROM w LEFT JOIN e USING (word) GROUP BY w.word, w.n),
g AS MATERIALIZED (
  SELECT word, n, n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM f),
r(word, root) AS (SELECT word, word FROM g UNION ALL SELECT r.word, g.form FROM r JOIN g ON g.word = r.root WHERE g.form IS NOT NULL)
SELECT g.word, g.form, r.root, g.n, g.n_near, g.form_n
FROM g JOIN r USING (word) JOIN g z ON z.word = r.root AND z.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_linededup": OP2_SQL, "op8_minhash": OP8_SQL, "op9_warc": OP9_SQL, "op12_negatives": OP12_SQL, "op13_variants": OP13_SQL}
