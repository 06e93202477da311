"""Listing, lookup and usage statistics over documents, users, sessions and messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The domains that dense counts cover.
STATUSES = ["pending", "processing", "pending_review", "processed", "vector_processed", "error"]
ROLES = ["admin", "can_bo", "nguoi_dung"]
STAFF, READABLE = ["admin", "can_bo"], ["processed", "vector_processed"]
ROUTES = [("/upload", STAFF), ("/files", STAFF), ("/stats", ["admin"]), ("/users", ["admin"])]
GLOBAL_DOC, ASKED_GLOBALLY, ASKED_OF_DOCUMENT = "__global__", "Hỏi đáp", "Hỏi tài liệu"


def page_of(rows: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of the ordered rows; give the order a unique last column."""
    return rows.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def visible_documents(docs: DataFrame, role: str) -> DataFrame:
    """All documents for staff, the readable ones for others; a filter that reaches the scan."""
    return docs if role in STAFF else docs.where(F.col("status").isin(READABLE))


def page_model(total: int, page_size: int, page: int, around: int = 1) -> list[int | None]:
    """Page numbers to show: the ends, the neighbours, and None for each gap."""
    last = max(1, -(-total // page_size))
    shown = sorted({1, last, *range(max(1, page - around), min(last, page + around) + 1)})
    return [x for a, b in zip([0, *shown], shown) for x in ([None, b] if b - a > 1 else [b])]


def find_document(docs: DataFrame, key: str, id_col: str = "id", name_col: str = "filename") -> DataFrame:
    """The document of that id, or else of that file name."""
    hit = docs.where((F.col(id_col) == key) | (F.col(name_col) == key)).withColumn("_kind", (F.col(id_col) != key).cast("int"))
    return hit.orderBy("_kind", id_col).limit(1).drop("_kind")


def search_names(docs: DataFrame, text: str, role: str) -> DataFrame:
    return visible_documents(docs, role).where(F.contains(F.lower("filename"), F.lower(F.lit(text))))


def recent_sessions(sessions: DataFrame, docs: DataFrame, n: int = 9) -> DataFrame:
    """The ``n`` newest sessions with the name to show for their document."""
    newest = sessions.orderBy(F.desc("updated_at"), "id").limit(n)
    names = docs.select(F.col("id").alias("doc_id"), "filename")
    return newest.join(names, "doc_id", "left").withColumn("name", F.when(F.col("doc_id") == GLOBAL_DOC, ASKED_GLOBALLY).otherwise(F.coalesce("filename", "doc_id")))


def owned_session(sessions: DataFrame, users: DataFrame, session_id: str, username: str) -> DataFrame:
    user = users.where(F.col("username") == username).select(F.col("id").alias("user_id"))
    return sessions.where(F.col("id") == session_id).join(user, "user_id", "left_semi")


def allowed_route(path: Column, role: Column, rules: list[tuple[str, list[str]]] = ROUTES) -> Column:
    """Whether a role may open a path; paths under no rule are open to all."""
    return reduce(lambda rest, rule: F.when(path.startswith(rule[0]), role.isin(rule[1])).otherwise(rest), reversed(rules), F.lit(True))


def dense_counts(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """(key, n) of every value of the domain, zeros kept, others left out."""
    keys = rows.sparkSession.createDataFrame([(x,) for x in domain], "key string")
    return keys.join(rows.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("c")), "key", "left").select("key", F.coalesce("c", F.lit(0)).alias("n"))


def sessions_by_role(users: DataFrame, sessions: DataFrame) -> DataFrame:
    """(key, n): sessions of the users of each role; roles without any are left out."""
    both = users.select(F.col("id").alias("user_id"), "role").join(sessions.select("user_id", F.col("id").alias("sid")), "user_id", "left")
    return both.groupBy(F.col("role").alias("key")).agg(F.count("sid").alias("n")).where("n > 0")


def questions_by_role(users: DataFrame, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(key, n): user messages in the sessions of each role's users, counted per session first."""
    asked = messages.where("role = 'user'").groupBy(F.col("session_id").alias("sid")).agg(F.count("*").alias("asked"))
    per_user = sessions.select("user_id", F.col("id").alias("sid")).join(asked, "sid").groupBy("user_id").agg(F.sum("asked").alias("asked"))
    both = users.select(F.col("id").alias("user_id"), "role").join(per_user, "user_id")
    return both.groupBy(F.col("role").alias("key")).agg(F.sum("asked").alias("n")).where("n > 0")


def feature_usage(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(key, n): user questions to all documents, and all the others."""
    every = sessions.where(F.col("doc_id") == GLOBAL_DOC).select(F.col("id").alias("session_id"))
    asked = messages.where("role = 'user'").groupBy("session_id").agg(F.count("*").alias("c"))
    total = asked.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"))
    globally = asked.join(every, "session_id", "left_semi").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("g"))
    pairs = F.array(F.struct(F.lit(ASKED_GLOBALLY).alias("key"), F.col("g").alias("n")), F.struct(F.lit(ASKED_OF_DOCUMENT).alias("key"), (F.col("total") - F.col("g")).alias("n")))
    return total.crossJoin(F.broadcast(globally)).select(F.explode(pairs).alias("p")).select("p.key", "p.n")


def admin_statistics(docs: DataFrame, users: DataFrame, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(section, key, n): all the figures of the overview page as one long table."""

    def count(rows: DataFrame, key: str) -> DataFrame:
        return rows.agg(F.lit(key).alias("key"), F.count("*").alias("n"))

    parts = {
        "total": reduce(DataFrame.unionByName, (count(docs, "documents"), count(users, "users"), count(sessions, "sessions"), count(messages.where("role = 'user'"), "questions"))),
        "documents_by_status": dense_counts(docs, "status", STATUSES), "users_by_role": dense_counts(users, "role", ROLES), "sessions_by_role": sessions_by_role(users, sessions),
        "questions_by_role": questions_by_role(users, sessions, messages), "feature_usage": feature_usage(sessions, messages),
    }
    return reduce(DataFrame.unionByName, (p.select(F.lit(s).alias("section"), "key", F.col("n").cast("long").alias("n")) for s, p in parts.items()))


def change_role(users: DataFrame, user_id: str, role: str) -> DataFrame:
    """``users`` with one role changed; admins keep theirs, unknown roles are refused."""
    if role not in ROLES:
        raise ValueError(f"unknown role: {role}")
    return users.withColumn("role", F.when((F.col("id") == user_id) & (F.col("role") != "admin"), role).otherwise(F.col("role")))


def rename_document(docs: DataFrame, doc_id: str, name: str) -> DataFrame:
    if not name.strip():
        raise ValueError("a name must not be empty")
    return docs.withColumn("filename", F.when(F.col("id") == doc_id, name.strip()).otherwise(F.col("filename")))


def titled_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """``sessions`` whose empty titles become the first 100 characters of their first question."""
    first = messages.where("role = 'user'").groupBy(F.col("session_id").alias("id")).agg(F.min_by("content", F.struct("created_at", "id")).alias("q"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.substring("q", 1, 100))
    return sessions.join(first, "id", "left").withColumn("title", title).drop("q")


def newest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def known_progress(tables: list[DataFrame]) -> DataFrame:
    """(document_id, payload): the newest entry of the first table that knows a document."""
    found = None
    for i, table in enumerate(tables):
        now = newest(table, "document_id", "updated_at").select("document_id", F.col("payload").alias(f"p{i}"))
        found = now if found is None else found.join(now, "document_id", "full")
    return found.select("document_id", F.coalesce(*(f"p{i}" for i in range(len(tables)))).alias("payload"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def catalogue_summaries(docs: DataFrame, catalogue: DataFrame, default: str = "") -> DataFrame:
    """``docs`` (id, ...) with the ``summary`` that the catalogue (doc_id, summary) has, else ``default``."""
    known = catalogue.select(F.col("doc_id").alias("id"), "summary").dropDuplicates(["id"])
    return docs.join(known, "id", "left").withColumn("summary", F.coalesce("summary", F.lit(default)))
