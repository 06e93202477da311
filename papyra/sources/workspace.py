"""A workspace of indexed documents: a JSON file for each, and a light manifest of all.

The manifest is a Parquet table in versions.  A refresh lists the files' times and
sizes, reads the contents of those only that are newer than the manifest or not in
it, and writes the next version; readers take the last whole one.  A file that is
no JSON object stays in the manifest with what is wrong, and does not stop the
others.  Heavy fields (structure, pages) are read when they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table_or_empty

MANIFEST = "path string, doc_id string, type string, doc_name string, doc_description string, page_count int, line_count int, modified timestamp, size long, error string"
_LISTED = "path string, modificationTime timestamp, length bigint, content binary"


def _files(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true")
    found = found.option("modifiedAfter", since) if since else found
    return found.schema(_LISTED).load(f"{folder}/documents")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The last version of the manifest, empty where there is none."""
    versions = table_or_empty(spark, f"{folder}/manifest", f"{MANIFEST}, version int")
    last = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == (-1 if last is None else last)).drop("version")


def entries(files: DataFrame) -> DataFrame:
    """Manifest rows of files (path, modificationTime, length, content).

    The id is the file's own, else its name; a PDF counts pages, others lines.  What
    is no JSON object, or has no readable structure, has an error and no fields."""
    text = F.decode("content", "UTF-8")
    # one object, read to its end
    whole = F.try_parse_json(text).isNotNull() & F.trim(text).startswith("{")
    light = "id string, type string, doc_name string, doc_description string, page_count int, line_count int"
    rows = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), whole.alias("_whole"), F.from_json(F.when(whole, text), light).alias("d"), F.get_json_object(F.when(whole, text), "$.structure").alias("_structure"))
    name = F.regexp_extract("path", r"([^/]*)\.json$", 1)
    error = F.when(~F.coalesce("_whole", F.lit(False)), "not a JSON object").when(F.col("_structure").isNull(), "no structure")
    good = lambda c: F.when(error.isNull(), c)
    return rows.select(
        "path", F.coalesce(good(F.col("d.id")), name).alias("doc_id"), good(F.col("d.type")).alias("type"), good(F.coalesce("d.doc_name", F.lit(""))).alias("doc_name"), good(F.coalesce("d.doc_description", F.lit(""))).alias("doc_description"),
        good(F.when(F.col("d.type") == "pdf", F.col("d.page_count"))).alias("page_count"), good(F.when(F.col("d.type") == "pdf", None).otherwise(F.col("d.line_count"))).cast("int").alias("line_count"), "modified", "size", error.alias("error"),
    )


def refresh(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of what is in ``folder`` now, as its next version.

    Rows of files that have the time and size of the last version are taken over
    unread; files that are gone lose their row.  Where nothing has changed there is
    no new version.  A workspace without files has an empty manifest."""
    known = manifest(spark, folder)
    listed = _files(spark, folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    kept = known.join(listed, ["path", "modified", "size"], "left_semi")
    fresh = listed.join(known.select("path", "modified", "size"), ["path", "modified", "size"], "left_anti")
    first, n_fresh = fresh.agg(F.min("modified"), F.count("*")).first()
    if not n_fresh and kept.count() == known.count():
        return known
    # files older than all that is new are not opened
    zone = spark.conf.get("spark.sql.session.timeZone")
    since = None if first is None else fresh.agg(F.date_format(F.min("modified") - F.expr("interval 2 seconds"), "yyyy-MM-dd'T'HH:mm:ss")).first()[0]
    opened = _files(spark, folder, since) if zone in ("UTC", "Etc/UTC") else _files(spark, folder)
    changed = opened.join(F.broadcast(fresh.select("path")) if n_fresh < 100_000 else fresh.select("path"), "path", "left_semi") if n_fresh else opened.limit(0)
    last = table_or_empty(spark, f"{folder}/manifest", f"{MANIFEST}, version int").agg(F.max("version")).first()[0]
    version = 0 if last is None else last + 1
    kept.unionByName(entries(changed)).write.mode("overwrite").parquet(f"{folder}/manifest/version={version}")
    return manifest(spark, folder)


def documents(spark: SparkSession, folder: str, asked: Column) -> DataFrame:
    """(doc_id, doc_name, structure, pages): the heavy fields, as JSON, of the manifest's
    readable documents for which ``asked`` holds; only their files are opened."""
    rows = manifest(spark, folder).where(F.col("error").isNull() & asked).select("path", "doc_id", "doc_name")
    paths = [r.path for r in rows.select("path").collect()]  # of the documents asked for
    if not paths:
        return spark.createDataFrame([], "doc_id string, doc_name string, structure string, pages string")
    contents = spark.read.format("binaryFile").schema(_LISTED).load(paths)
    text = F.decode("content", "UTF-8")
    return contents.join(rows, "path").select("doc_id", "doc_name", F.get_json_object(text, "$.structure").alias("structure"), F.get_json_object(text, "$.pages").alias("pages"))
