"""Model-backed steps as prompts, calls and parsed rows; the model is the caller's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.replies import json_object
from .lines import in_order
from .retrieval import with_model
from .rules import normalise_model_rows

CHUNKS_A_CALL, PROMPT_CHARS, DESCRIPTION_CHARS = 4, 7500, 8000
SUMMARY_TOKENS = {"short": 512, "medium": 1024, "long": 1500}
ANSWER_ROW = "struct<chunk_id:string,role:string,decision:string,level:string,risk_flags:array<string>,is_node:boolean,header:string,summary:string,reason:string>"


def chunk_payload() -> Column:
    """What a model is told of a chunk_signals() row."""
    signals = ("has_numbering", "numbering_level", "is_all_caps", "is_short", "ends_period", "is_continuation", "char_count")
    clipped = [t.clip(name, n).alias(name) for name, n in (("candidate_header", 80), ("text", 150), ("context_before", 30), ("context_after", 30))]
    return F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), "source_block_ids", *clipped, F.struct(*signals).alias("python_signals"))


def recognition_prompts(chunks: DataFrame, instructions: str = "") -> DataFrame:
    """(doc_id, batch, chunk_ids, prompt): four chunks a call, in order; a prompt that is
    too long raises."""
    batch = F.floor((F.row_number().over(in_order("chunk_id")) - 1) / CHUNKS_A_CALL).cast("int")
    rows = chunks.select("doc_id", "chunk_id", chunk_payload().alias("p")).withColumn("batch", batch)
    calls = rows.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "p"))).alias("rows"))
    payload = F.to_json(F.struct(F.transform("rows", lambda r: r["p"]).alias("chunks")))
    prompt = F.concat(F.lit(f"{instructions}\n"), payload)
    guarded = F.when(F.length(prompt) <= PROMPT_CHARS, prompt).otherwise(F.raise_error(F.lit("a prompt is too long")))
    return calls.select("doc_id", "batch", F.transform("rows", lambda r: r["chunk_id"]).alias("chunk_ids"), guarded.alias("prompt"))


def recognise(chunks: DataFrame, model: Callable[[], Callable[[str], str]], instructions: str = "") -> DataFrame:
    """Normalised rows of a model's answers (doc_id, chunk_id, role, decision, ...).

    A call that fails or answers without JSON gives no rows; to
    validate_decisions() its chunks are then up for review."""
    told = with_model(recognition_prompts(chunks, instructions), "prompt", model, "reply")
    parsed = told.withColumn("x", F.from_json(json_object("reply"), f"chunks array<{ANSWER_ROW}>"))
    rows = parsed.select("doc_id", "chunk_ids", F.explode("x.chunks").alias("r")).select("doc_id", "chunk_ids", "r.*")
    kind = dict(chunks.dtypes)["chunk_id"]
    own = rows.withColumn("chunk_id", F.regexp_replace("chunk_id", "^c(?=[0-9]+$)", "").try_cast(kind)).where(F.array_contains("chunk_ids", F.col("chunk_id")))
    return normalise_model_rows(own.drop("chunk_ids"))


def descriptions(nodes: DataFrame, limit: int = DESCRIPTION_CHARS) -> DataFrame:
    """(doc_id, structure): titles and ids of a document's upper nodes as JSON, one flat
    list in order with depths, summaries at the top only; of depths 2, 1 and 0 the
    first that fits, else cut off."""
    node = F.struct("title", "node_id", "depth", F.when(F.col("depth") == 0, F.col("summary")).alias("summary"))
    rows = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), node.alias("n")))).alias("rows"))

    def upto(depth: int) -> Column:
        return F.to_json(F.transform(F.filter("rows", lambda r: r["n"]["depth"] <= depth), lambda r: r["n"]))

    fitting = [F.when(F.length(upto(d)) <= limit, upto(d)) for d in (2, 1, 0)]
    return rows.select("doc_id", F.coalesce(*fitting, F.concat(F.substring(upto(0), 1, limit), F.lit("..."))).alias("structure"))


def node_summaries(nodes: DataFrame, model: Callable[[], Callable[[str], str]], tokens: Column, least: int = 200) -> DataFrame:
    """``nodes`` (text, is_leaf) with summary for leaves and prefix_summary for others: the
    text itself below ``least`` tokens, else the model's."""
    asked = with_model(nodes.withColumn("_p", F.when(tokens >= least, F.col("text"))), "_p", model, "_s")
    summary = F.when(tokens < least, F.col("text")).otherwise(F.col("_s"))
    return asked.withColumn("summary", F.when(F.col("is_leaf"), summary)).withColumn("prefix_summary", F.when(~F.col("is_leaf"), summary)).drop("_p", "_s")


def document_summaries(docs: DataFrame, model: Callable[[], Callable[[str, int], str]], length: str = "medium", instructions: str = "") -> DataFrame:
    """``docs`` (doc_id, text) with a model's ``summary`` and the ``max_tokens`` it had for it.

    A length that is not known counts as medium; long texts are given by head and
    tail, empty ones get an empty summary."""
    size = length if length in SUMMARY_TOKENS else "medium"
    tokens = SUMMARY_TOKENS[size]

    def make() -> Callable[[str], str]:
        ask = model()
        return lambda prompt: ask(prompt, tokens)

    prompt = F.when(t.strip("text") != "", F.concat(F.lit(f"{instructions}\n"), t.truncate_context("text")))
    return with_model(docs.withColumn("_prompt", prompt), "_prompt", make, "summary").withColumn("max_tokens", F.lit(tokens)).drop("_prompt")


def reviewed_texts(segments: DataFrame, model: Callable[[], Callable[[str], str]], instructions: str = "") -> DataFrame:
    """``segments`` (text, ...) with ``reviewed``: a model's corrected text if it has between
    half and twice the length, else the text; ``review_error`` says why it failed."""
    told = with_model(segments.withColumn("_prompt", F.concat(F.lit(f"{instructions}\n"), "text")), "_prompt", model, "_said", error="review_error")
    said, n = t.strip("_said"), F.length("text")
    fits = (said != "") & (F.length(said) >= n * 0.5) & (F.length(said) <= n * 2)
    return told.withColumn("reviewed", F.when(fits, said).otherwise(F.col("text"))).drop("_prompt", "_said")


def split_large(spans: DataFrame, find_large: Callable[[DataFrame], DataFrame], split: Callable[[DataFrame], DataFrame], rounds: int = 50) -> DataFrame:
    """Split spans (doc_id, ord, ...) until none is too large: ``find_large`` picks the
    large ones, ``split`` gives the parts that replace them.  Spans that are still
    too large after ``rounds`` rounds, as a split makes no progress, are an error."""
    for _ in range(rounds):
        large = find_large(spans)
        if large.isEmpty():
            return spans
        spans = spans.join(large.select("doc_id", "ord"), ["doc_id", "ord"], "left_anti").unionByName(split(large).select(spans.columns))
    raise ValueError(f"spans are too large after {rounds} rounds of splitting")
