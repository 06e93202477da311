"""Tables in files: readers, keyed replacement, cascading deletion.

Everything goes through Spark's readers and writers, so any store that Spark
can open will do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..operators.lines import ordered_text

#: Extensions and media types that uploads may have.
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp"}
MEDIA_TYPES = {"pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", **IMAGE_TYPES}

CHUNKS = "id string, doc_id string, text string, line_num int, end_line_num int, vector array<double>"
CATALOGUE = "doc_id string, filename string, summary string, node_count int, top_headings string, summary_vector array<double>, created_at timestamp_ntz"


def raw_files(spark: SparkSession, folder: str, pattern: str = "*", content: bool = True) -> DataFrame:
    """(path, filename, extension, media_type, length, content) of all files below a folder;
    without ``content`` only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    types = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    columns = ["path", name.alias("filename"), extension.alias("extension"), F.coalesce(F.element_at(types, extension), F.lit("application/octet-stream")).alias("media_type"), "length"]
    return files.select(*columns, *(["content"] if content else []))


def upload_rows(files: DataFrame) -> DataFrame:
    """A documents row, pending, for each raw file; ids follow from the paths, so a rerun adds none."""
    return files.select(F.sha2("path", 256).substr(1, 32).alias("id"), "filename", F.col("path").alias("raw_file_path"), F.when(F.col("extension").isin("pdf", *IMAGE_TYPES), "pending").otherwise("skipped").alias("status"))


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, page, text) of files ``doc_id/page_N.txt``, pages numbered densely in the order of N."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "page_*.txt").text(folder)
    path = F.col("_metadata.file_path")
    rows = files.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("doc_id"), F.regexp_extract(path, r"page_(\d+)[^/]*$", 1).cast("int").alias("n"), F.col("value").alias("text"))
    return rows.withColumn("page", F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))).select("doc_id", "page", "text")


def raw_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, text): pages one after the other, each under its mark."""
    marked = F.concat(F.lit("=== PAGE "), F.col("page").cast("string"), F.lit(" ===\n"), t.strip("text"))
    return pages.groupBy("doc_id").agg(ordered_text(marked, F.col("page"), "\n\n").alias("text"))


def markdown_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, text): pages' markdown, a blank line between."""
    return pages.groupBy("doc_id").agg(ordered_text(F.col("text"), F.col("page"), "\n\n").alias("text"))


def page_report(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, native_text, ocr_text) with the text taken, the method and its reason."""
    reason = t.recognition_reason(F.coalesce("native_text", F.lit("")))
    rows = pages.withColumn("reason", reason).withColumn("_t", t.choose_text(F.col("native_text"), F.when(F.col("reason") != "native_text_enough", F.col("ocr_text")), F.col("reason")))
    return rows.select("doc_id", "page", F.col("_t.text").alias("text"), F.col("_t.method").alias("method"), "reason", F.length(F.coalesce("native_text", F.lit(""))).alias("native_chars"), F.length(F.coalesce("ocr_text", F.lit(""))).alias("ocr_chars"), F.length("_t.text").alias("selected_chars"))


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet table, or an empty one where nothing is stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def catalogue_json(spark: SparkSession, path: str, schema: str = CATALOGUE) -> DataFrame:
    """Catalogue entries as JSON lines; a malformed line is left out."""
    declared = T._parse_datatype_string(schema).add("_corrupt_record", "string")
    rows = spark.read.schema(declared).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with all rows of the keys in ``new`` replaced by those of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_replacing(new: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of the keys in ``new``, others stay as they are."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def insert_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key is not there yet, one a key."""
    fresh = new.dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh.select(old.columns))


def delete_cascading(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """``tables`` (documents, sessions, messages, chunks, catalogue) without what belongs to
    the documents in ``doc_ids`` (doc_id)."""
    gone = doc_ids.select("doc_id").distinct()
    sessions = tables["sessions"].join(gone, "doc_id", "left_semi").select(F.col("id").alias("session_id"))
    out = {name: tables[name].join(gone, "doc_id", "left_anti") for name in ("sessions", "chunks", "catalogue") if name in tables}
    out["messages"] = tables["messages"].join(sessions, "session_id", "left_anti")
    out["documents"] = tables["documents"].join(gone.select(F.col("doc_id").alias("id")), "id", "left_anti")
    return out


def write_report(rows: DataFrame, path: str) -> None:
    """An audit or metadata report as JSON lines."""
    rows.write.mode("overwrite").json(path)
