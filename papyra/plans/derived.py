"""Inputs that the queries derive from the base tables, and the same as SQL.

A customer is a document: its orders are articles, their line items numbered
and lettered points, so parents are known from foreign keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lines import in_order


#: Scan tasks up to which a table counts as small: some hundred MB each at most.
SMALL_SCAN = 8
#: Rows that a task sorts at once: some ten MB for each sort.
ROWS_A_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a small scan over all cores.

    A file of one row group is one task, however much work follows it; larger
    scans have tasks enough and are left as they are."""
    n, cores = rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if n <= min(SMALL_SCAN, cores) else rows


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows`` of about ``n`` dealt by ``keys`` over tasks of ROWS_A_TASK.

    Adaptive execution deals rows to few tasks by their packed size, so what a task
    sorts would grow with the table; a small table is left to it."""
    tasks = -(-n // ROWS_A_TASK)
    return rows.repartition(tasks, *keys) if tasks > rows.sparkSession.sparkContext.defaultParallelism else rows


def unique_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line item for each number of an order: that of the largest quantity.

    Hardly any number comes twice, so items are dealt by their orders first, which later
    steps by order need as well, and not aggregated in the scan."""
    best = F.max(F.struct("l_quantity", "l_returnflag", "l_linestatus")).alias("x")
    item = table(spark, sf_dir, "lineitem")
    items = dealt(item.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"), item.count(), "l_orderkey")
    return items.groupBy("l_orderkey", "l_linenumber").agg(best).select("l_orderkey", "l_linenumber", "x.*")


ITEMS_SQL = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_returnflag DESC, l_linestatus DESC) AS k FROM lineitem), items AS (SELECT * FROM ranked WHERE k = 1)"""


def outline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_num, level, own, up, line): each customer's orders and line items as
    headings, in key order; own and up are the keys of a heading and of the one above it."""
    customer, orders = (table(spark, sf_dir, n) for n in ("customer", "orders"))
    item = unique_items(spark, sf_dir)
    none = F.lit(-1).cast("long")
    one = customer.select(F.col("c_custkey").alias("doc_id"), none.alias("o"), none.alias("i"), F.lit(1).alias("level"), F.lit("c").alias("own"), F.lit(None).cast("string").alias("up"), F.concat(F.lit("# CHƯƠNG "), F.col("c_custkey"), F.lit(" "), F.col("c_mktsegment")).alias("line"))
    key = F.concat(F.lit("o"), F.col("o_orderkey"))
    two = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("o"), none.alias("i"), F.lit(2).alias("level"), key.alias("own"), F.lit("c").alias("up"), F.concat(F.lit("## Điều "), F.col("o_orderkey"), F.lit(". "), F.col("o_orderpriority")).alias("line"))
    number = F.col("l_linenumber").cast("long")
    title = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.col("l_linenumber"), F.lit(". "), F.col("l_returnflag"))).otherwise(F.concat(F.chr(F.lit(96) + number), F.lit(") "), F.col("l_linestatus")))
    keys = item.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    three = keys.select(F.col("o_custkey").alias("doc_id"), F.col("l_orderkey").alias("o"), number.alias("i"), F.lit(3).alias("level"), F.concat(F.lit("i"), F.col("l_orderkey"), F.lit("."), F.col("l_linenumber")).alias("own"), F.concat(F.lit("o"), F.col("l_orderkey")).alias("up"), F.concat(F.lit("### "), title).alias("line"))
    rows = dealt(one.unionByName(two).unionByName(three), table(spark, sf_dir, "lineitem").count() + orders.count(), "doc_id")
    return rows.withColumn("line_num", F.row_number().over(in_order("o", "i", "line"))).select("doc_id", "line_num", "level", "own", "up", "line")


OUTLINE_SQL = ITEMS_SQL + """,
outline_rows AS (
  SELECT c_custkey AS doc_id, -1 AS o, -1 AS i, 1 AS level, 'c' AS own, NULL AS up, '# CHƯƠNG ' || c_custkey || ' ' || c_mktsegment AS line FROM customer
  UNION ALL SELECT o_custkey, o_orderkey, -1, 2, 'o' || o_orderkey, 'c', '## Điều ' || o_orderkey || '. ' || o_orderpriority FROM orders
  UNION ALL SELECT o_custkey, l_orderkey, l_linenumber, 3, 'i' || l_orderkey || '.' || l_linenumber, 'o' || l_orderkey,
    '### ' || CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber || '. ' || l_returnflag ELSE chr((96 + l_linenumber)::INTEGER) || ') ' || l_linestatus END
  FROM items JOIN orders ON o_orderkey = l_orderkey),
outline AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o, i, line) AS line_num, level, own, up, line FROM outline_rows)"""


#: Lines of documents, numbered from 1.
LINES_SQL = """
lines AS (
  SELECT doc_id, i AS line_num, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL) d, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i) u)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users, their role from the market segment."""
    role = F.when(F.col("c_mktsegment") == "BUILDING", "admin").when(F.col("c_mktsegment") == "MACHINERY", "can_bo").otherwise("nguoi_dung")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), role.alias("role"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions; every seventh asks all documents."""
    doc = F.when(F.col("o_orderkey") % 7 == 0, "__global__").otherwise(F.concat(F.lit("d"), F.col("o_orderkey") % 100))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), doc.alias("doc_id"), F.col("o_orderdate").alias("updated_at"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as messages; returned ones are the users'."""
    role = F.when(F.col("l_returnflag") == "R", "user").otherwise("assistant")
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("session_id"), role.alias("role"), F.col("l_shipdate").alias("created_at"))


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stored documents in four states."""
    status = F.element_at(F.array(*(F.lit(s) for s in ("pending", "processed", "vector_processed", "error"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("filename"), status.alias("status"), F.col("p_retailprice").alias("price"))


STATS_SQL = """
users AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'can_bo' ELSE 'nguoi_dung' END AS role FROM customer),
sessions AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderkey % 7 = 0 THEN '__global__' ELSE 'd' || (o_orderkey % 100) END AS doc_id FROM orders),
messages AS (SELECT l_orderkey AS session_id, CASE l_returnflag WHEN 'R' THEN 'user' ELSE 'assistant' END AS role FROM lineitem),
docs AS (SELECT p_partkey AS id, p_name AS filename, (['pending', 'processed', 'vector_processed', 'error'])[(p_partkey % 4 + 1)::INTEGER] AS status FROM part)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded documents as chunks, ten labels as documents."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), F.col("embedding").alias("vector"))
    return vectors.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")


CHUNKS_SQL = """
chunks AS (SELECT vec_id AS chunk_id, label AS doc_id, embedding::DOUBLE[] AS vector, text FROM embeddings JOIN documents ON documents.doc_id = vec_id)"""


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as boxes and suppliers as regions on 25 pages, in whole coordinates."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    x = (F.col("p_partkey") * 37 % 500).cast("double")
    y = (F.col("p_partkey") * 53 % 700).cast("double")
    small = part.select((F.col("p_partkey") % 25).cast("int").alias("page"), F.col("p_partkey").alias("box_id"), x.alias("x0"), (x + 10 + F.col("p_size")).alias("x1"), y.alias("top"), (y + 12.0).alias("bottom"), F.col("p_name").alias("text"))
    u = (F.col("s_suppkey") * 91 % 450).cast("double")
    v = (F.col("s_suppkey") * 67 % 600).cast("double")
    wide = supplier.select(F.col("s_nationkey").cast("int").alias("page"), F.col("s_suppkey").alias("box_id"), u.alias("x0"), (u + 120.0).alias("x1"), v.alias("top"), (v + 90.0).alias("bottom"))
    return small, wide


BOXES_SQL = """
boxes AS (SELECT (p_partkey % 25)::INTEGER AS page, p_partkey AS box_id, (p_partkey * 37 % 500)::DOUBLE AS x0, (p_partkey * 37 % 500)::DOUBLE + 10 + p_size AS x1, (p_partkey * 53 % 700)::DOUBLE AS top, (p_partkey * 53 % 700)::DOUBLE + 12 AS bottom, p_name AS text FROM part),
regions AS (SELECT s_nationkey AS page, s_suppkey AS box_id, (s_suppkey * 91 % 450)::DOUBLE AS x0, (s_suppkey * 91 % 450)::DOUBLE + 120 AS x1, (s_suppkey * 67 % 600)::DOUBLE AS top, (s_suppkey * 67 % 600)::DOUBLE + 90 AS bottom FROM supplier)"""
