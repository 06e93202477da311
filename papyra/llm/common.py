"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space, the set bytes.split() cuts at.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHINGLE_WORDS = 5


#: Scan tasks up to which a table of texts counts as small: some hundred MB each at most.
SMALL_SCAN = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.  A small table of texts, which may be one row group and
    so one task, is dealt over all cores; larger ones have tasks enough."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in ("documents", "pages"):
        return rows
    n, cores = rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if n <= min(SMALL_SCAN, cores) else rows


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Only where the setting is absent and everything runs in this one process
    (tests, a laptop) a local temporary folder takes its place; a cluster
    without the setting is an error, as its machines share no such folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="papyra-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        shared = f"file://{shared}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/papyra-scratch"


#: Scratch tables of this process that release_scratch() has not deleted.
_written: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor then
    costs a re-read, never a rerun of what came before."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    # zstd works on heap buffers; many small files cost no direct memory
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_scratch(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the scratch tables written from number ``since`` on, but for the last
    ``keep``; nothing that is still to be computed may read them."""
    gone = _written[since : len(_written) - keep]
    for each in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(each)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(each)


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` returns, materialised, without the scratch tables on its way."""
    since = len(_written)
    out = materialise(build(), name)
    release_scratch(out.sparkSession, since, keep=1)
    return out


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with the totals of ``sums`` over all rows before each, in a total order.

    Ranges of the order are summed on their own and begin where those before
    them end, so no task holds more than a range, or one row a range."""
    dealt = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(*(F.sum(x).alias(f"_{n}") for n, x in sums.items()))
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    out = dealt.join(F.broadcast(starts), "_range")
    return out.withColumns({n: F.coalesce(F.sum(x).over(within), F.lit(0)) + F.col(f"_{n}") for n, x in sums.items()}).drop("_range", *(f"_{n}" for n in sums))


#: Ways in which a table too large to broadcast is repeated, so that a hot key meets as many tasks.
SALTS = 32


def at_most(table: DataFrame, rows: int) -> bool:
    return table.limit(rows + 1).count() <= rows


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], salt: Column, few: bool) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key; nulls where it has none).

    A table of ``few`` rows, as the caller has checked, is broadcast; any other is
    repeated under salts, so that a key with a third of all rows is spread."""
    if few:
        return rows.join(F.broadcast(table), on, "left")
    table = table.withColumn("_salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salted", F.pmod(salt, F.lit(SALTS)).cast("int")).join(table, [*on, "_salted"], "left").drop("_salted")


def shielded(rows: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """``rows`` with all columns but the ``needed`` ones under names that no operator
    uses, and the columns that give them their names back."""
    names = {c: c if c in needed else f"_own{i}" for i, c in enumerate(rows.columns)}
    return rows.toDF(*names.values()), [F.col(n).alias(c) for c, n in names.items()]


def ascii_lower(col: Column | str) -> Column:
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased and nothing else changed."""
    return text.encode().lower().split() if text else []


def shingle_set(words: list[bytes], n: int = SHINGLE_WORDS) -> set:
    """Distinct n-word shingles; a shorter text is one shingle, no words none."""
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n))))


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them well."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles (n up to 5)."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    ids = np.fromiter(map(digest, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out += mix64(ids[i : len(ids) - k + 1 + i] + _ODD[i]) * _ODD[i]
    return np.unique(mix64(out))

