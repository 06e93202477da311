"""A training corpus from raw documents: quality filter, near-duplicate removal,
benchmark decontamination, mixing by source, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
it kept, and all but the last return the columns of documents.  A stage's own
docstring says what it does with nulls, ties and repeated rows; an empty table
gives an empty result in each, and further columns of docs pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import decontaminate, minhash, mixing, quality, sharding
from papyra.llm.common import settled, table
from papyra.llm.queries import KEEP_SCORE, quality_model

SHARDS = 16


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at least KEEP_SCORE.

    Null and empty texts have the score of a text without n-grams; rows without a
    doc_id are scored, but teach nothing; equal rows have equal scores."""
    scored = quality.score(docs.select("text", F.struct(docs.columns).alias("_row")), quality_model(spark, docs, sf_dir))
    return scored.where(F.col("quality_score") >= KEEP_SCORE).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each near-duplicate group.

    Texts without words are like nothing and stay, as do rows without a doc_id;
    rows that share the kept doc_id all stay."""
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Null and empty texts hold none; rows without a doc_id cannot be reported and
    stay; of rows that share a doc_id, one that holds an item takes all away."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them (0 to 2 times), laid out by the
    shards that drew them and in their local shuffles.

    Null texts have no words, and go where their source goes; a null source is one
    of its own; equal rows are taken together."""
    return mixing.mix(docs, shards=SHARDS).select(docs.columns)


def shard_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with the shard each belongs to.

    Null and empty texts weigh a byte; equal texts share a shard if it holds them."""
    return sharding.shard(docs, shards=SHARDS)


STAGES = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("sharding", shard_corpus),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read
    again; what a stage wrote on its way is deleted when its result is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: The stages learn, hash and draw at random, which SQL cannot state; tests compare with brute force.
ORACLE_SQL = None
