"""Boilerplate lines by their frequency relative to their site.

A line is boilerplate on a host if the pages of the host that hold it are more
than a ratio of the host's pages.  Counting moves hashes only: a host's hot
lines are summed where they are read, and (host, line) keys spread even a host
with a third of all pages over all tasks.  The lines to drop come back to the
pages as a broadcast table while they are few; beyond that the pages are
shuffled once, by host and a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, at_most, looked_up, materialise, shielded

#: Fixed patterns: what comes after "://", and what separates lines in HTML.
HOST = r"(?s)^.*?://([^/?#]*)"
INVISIBLE = r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->"
TAG = r"<[^>]*>"
#: Lines to drop, of all hosts, that are broadcast (8 bytes each), and hosts that have any.
BROADCAST_LINES, BROADCAST_HOSTS = 2_000_000, 100_000


def host_of(url: Column | str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def html_lines(html: Column | str) -> Column:
    """Non-empty trimmed text runs between tags and line breaks, in order."""
    text = F.regexp_replace(F.regexp_replace(html, INVISIBLE, "\n"), TAG, "\n")
    lines = F.transform(F.split(text, "[\n\r]+"), lambda x: F.btrim(x, F.lit(" \t\n\v\f\r")))
    return F.coalesce(F.filter(lines, lambda x: x != ""), F.array().cast("array<string>"))


def site_line_dedup(pages: DataFrame, ratio: float = 0.3, min_pages: int = 3) -> DataFrame:
    """``pages`` (page_id, url, html) with ``host``, ``clean_text`` (the lines kept,
    in order), ``n_lines`` and ``n_dropped``.

    A line is dropped from a page if at least ``min_pages`` pages of its host hold
    it and they are more than ``ratio`` of the host's pages; a page counts once
    however often it repeats the line.  Every row is a page, also where page_id
    repeats or is null.  Null and empty html has no lines and an empty text;
    a null url, or one without ``://``, is on the host "".  Columns named like
    the added ones are replaced."""
    pages, own = shielded(pages.drop("host", "clean_text", "n_lines", "n_dropped"), "url", "html")
    rows = pages.withColumn("host", host_of("url")).withColumn("_lines", html_lines("html"))
    hashes = rows.select("host", F.array_distinct(F.transform("_lines", lambda x: F.xxhash64(x))).alias("hs"))
    totals = hashes.groupBy("host").agg(F.count("*").alias("total"))
    counts = hashes.select("host", F.explode("hs").alias("h")).groupBy("host", "h").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    # A host has few lines above the ratio (each page holds them), so its list travels as one array.
    common = counts.join(totals, "host").where(F.col("pages") > ratio * F.col("total"))
    drop = materialise(common.groupBy("host").agg(F.sort_array(F.collect_list("h")).alias("_drop")), "boilerplate")
    few = at_most(drop, BROADCAST_HOSTS) and drop.agg(F.coalesce(F.sum(F.size("_drop")), F.lit(0))).first()[0] <= BROADCAST_LINES
    rows = looked_up(rows, drop, ["host"], F.xxhash64("url", "html"), few).withColumn("_drop", F.coalesce("_drop", F.array().cast("array<bigint>")))
    kept = F.filter("_lines", lambda x: ~F.array_contains("_drop", F.xxhash64(x)))
    rows = rows.withColumn("_kept", kept)
    return rows.select(*own, "host", F.array_join("_kept", "\n").alias("clean_text"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"))
