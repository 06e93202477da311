"""Retrieval: hybrid vector and keyword ranking, catalogue search, conversation history."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vectors as v
from ..functions.replies import first_object
from .lines import cited_blocks, ordered_text

TOP_K, KEYWORD_WEIGHT, ACCEPT, CATALOGUE_TOP, CATALOGUE_MOST, HISTORY = 5, 0.5, 0.35, 5, 3, 5
GLOBAL_DOC = "__global__"


def vector_column(query: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in query))


def scored(chunks: DataFrame, query: list[float], question: str, weight: float = KEYWORD_WEIGHT) -> DataFrame:
    """``chunks`` (vector, text, ...) with ``score``: cosine plus weighted keyword share.

    The query is part of the plan, so scoring is a map over the chunks; those
    without a vector are left out."""
    usable = chunks.where("vector is not null and size(vector) > 0")
    return usable.withColumn("score", v.cosine(F.col("vector"), vector_column(query)) + weight * v.keyword_overlap(v.query_words(question), F.col("text")))


def top_chunks(ranked: DataFrame, k: int = TOP_K, tie: str = "chunk_id") -> DataFrame:
    """The ``k`` best of all: each task keeps k rows and one merges them."""
    return ranked.orderBy(F.desc("score"), tie).limit(k)


def top_per_document(ranked: DataFrame, k: int = TOP_K, tie: str = "chunk_id", by: str = "doc_id") -> DataFrame:
    """The ``k`` best of each document with ``rank``; groups are cut before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), tie))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k)


def rank_documents(ranked: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, doc_score, accepted): documents by their best chunk, best first; only the
    best one is answered from, if its score is at least ``accept``."""
    best = ranked.groupBy("doc_id").agg(F.max("score").alias("doc_score"))
    # one row: the first of the highest scores
    top = best.orderBy(F.desc("doc_score"), "doc_id").limit(1).select(F.col("doc_id").alias("_top"))
    joined = best.crossJoin(F.broadcast(top))
    return joined.select("doc_id", "doc_score", ((F.col("doc_id") == F.col("_top")) & (F.col("doc_score") >= accept)).alias("accepted")).orderBy(F.desc("doc_score"), "doc_id")


def answer_context(chunks: DataFrame) -> DataFrame:
    """(doc_id, context) of ranked chunks (doc_id, rank, text, line_num, end_line_num, filename)."""
    blocks = cited_blocks(chunks)
    return blocks.groupBy("doc_id").agg(ordered_text(F.col("block"), F.col("rank"), "\n\n---\n\n").alias("context"))


def search_catalogue(catalogue: DataFrame, query: list[float], accept: float = ACCEPT, most: int = CATALOGUE_MOST) -> DataFrame:
    """(doc_id, filename, summary, score, rank): entries above ``accept`` by cosine, at
    most ``most``, or the best one if none is; what holds where no model chooses."""
    score = F.coalesce(F.when(F.size("summary_vector") > 0, v.cosine(F.col("summary_vector"), vector_column(query))), F.lit(0.0))
    best = catalogue.select("doc_id", "filename", "summary", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(most)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    return ranked.where((F.col("score") > accept) | (F.col("rank") == 1))


def catalogue_candidates(catalogue: DataFrame, query: list[float], k: int = CATALOGUE_TOP) -> DataFrame:
    """The ``k`` nearest entries as a model's choice list: (doc_id, score, entry)."""
    score = F.coalesce(F.when(F.size("summary_vector") > 0, v.cosine(F.col("summary_vector"), vector_column(query))), F.lit(0.0))
    topics = F.when(F.coalesce("top_headings", F.lit("")) != "", F.concat(F.lit(" (Chủ đề chính: "), F.col("top_headings"), F.lit(")"))).otherwise("")
    entry = F.concat(F.lit("- ["), F.col("doc_id").cast("string"), F.lit("] "), F.col("filename"), F.lit(": "), F.col("summary"), topics)
    return catalogue.select("doc_id", score.alias("score"), entry.alias("entry")).orderBy(F.desc("score"), "doc_id").limit(k)


def last_turns(messages: DataFrame, n: int = HISTORY, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``n`` messages of each conversation, with ``back`` from 1 for the newest."""
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return messages.withColumn("back", back).where(F.col("back") <= n)


def history_prompts(messages: DataFrame, n: int = HISTORY, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conversation, history): its last turns, oldest first, one ``role: text`` a line."""
    turns = last_turns(messages, n, by, order)
    return turns.groupBy(by).agg(ordered_text(F.concat_ws(": ", "role", "text"), -F.col("back")).alias("history"))


def final_sources(answers: DataFrame) -> DataFrame:
    """``answers`` (answer, filename, lines) with the citation that the answer names, else
    the one retrieved, and the answer without tags."""
    cited = t.citation("answer")
    return answers.select("*", F.coalesce(cited["file"], F.col("filename")).alias("source_file"), F.coalesce(cited["lines"], F.col("lines")).alias("source_lines"), t.without_citations("answer").alias("plain_answer"))


def ask_document(chunks: DataFrame, doc_id: str | int, query: list[float], question: str, model: Callable[[], Callable[[str], str]], fallback: str = "") -> DataFrame:
    """One row (doc_id, answer, source_file, source_lines): the answer from a document's best
    chunks (chunk_id, doc_id, text, vector, line_num, end_line_num, filename)."""
    best = top_per_document(scored(chunks.where(F.col("doc_id") == doc_id), query, question))
    first = best.where("rank = 1").select("doc_id", "filename", F.concat_ws("-", F.col("line_num").cast("string"), F.col("end_line_num").cast("string")).alias("lines"))
    prompt = F.concat(t.truncate_context("context"), F.lit(f"\n\n{question}"))
    answered = with_model(answer_context(best).withColumn("prompt", prompt), "prompt", model, "answer", fallback)
    told = final_sources(answered.join(first, "doc_id"))
    return told.select("doc_id", F.col("plain_answer").alias("answer"), "source_file", "source_lines")


def with_model(rows: DataFrame, prompt: str, model: Callable[[], Callable[[str], str]], out: str, fallback: str = "", error: str | None = None, tries: int = 3, wait: float = 0.0) -> DataFrame:
    """``rows`` with ``out``, a text model's reply to ``prompt``; empty prompts and calls that
    fail ``tries`` times get ``fallback``.  ``model`` makes the callable once a task.

    After a failure the next call waits ``wait`` seconds, then twice as long, and so
    on.  A column named ``error`` says why a row has the fallback, null where a
    model has answered."""

    def call(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reply = model()

        def safe(p: str | None) -> tuple[str, str | None]:
            if not p or not p.strip():
                return fallback, "empty prompt"
            why = None
            for k in range(tries):
                if k and wait:
                    time.sleep(wait * 2 ** (k - 1))
                try:
                    said = reply(p)
                    return (said, None) if said else (fallback, "empty reply")
                except Exception as e:
                    why = f"{type(e).__name__}: {e}"
            return fallback, why

        for frame in frames:
            yield pd.DataFrame([safe(p) for p in frame], columns=["reply", "error"], index=frame.index)

    reply_of = F.pandas_udf(call, "reply string, error string")  # type: ignore[call-overload]
    told = rows.withColumn("_told", reply_of(F.col(prompt)))
    return told.withColumns({out: F.col("_told.reply")} | ({error: F.col("_told.error")} if error else {})).drop("_told")


def with_json_model(rows: DataFrame, prompt: str, model: Callable[[], Callable[[str, str | None], str]], schema: str, out: str, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """``rows`` with ``out``, the JSON object of a model's reply to (prompt, schema), null
    where there is none, and ``{out}_error``.

    A model that cannot keep to the schema (it raises, or replies without an
    object) is asked once more without one before the next try."""

    def make() -> Callable[[str], str]:
        ask = model()

        def reply(p: str) -> str:
            for asked in (schema, None):
                try:
                    found = first_object(ask(p, asked))
                except Exception:
                    if asked is None:
                        raise
                    continue
                if found:
                    return found
            raise ValueError("no JSON object in the reply")

        return reply

    told = with_model(rows, prompt, make, out, "", f"{out}_error", tries, wait)
    return told.withColumn(out, F.nullif(out, F.lit("")))


def condensed_questions(messages: DataFrame, questions: DataFrame, model: Callable[[], Callable[[str], str]], n: int = HISTORY, by: str = "conv_id", order: str = "turn", instructions: str = "") -> DataFrame:
    """``questions`` (conversation, question) with ``condensed``: the question put so that it
    stands without the last ``n`` messages; itself where there are none or the
    model fails."""
    asked = questions.join(history_prompts(messages, n, by, order), by, "left")
    prompt = F.when(F.col("history").isNotNull(), F.concat(F.lit(f"{instructions}\n"), "history", F.lit("\n\n"), "question"))
    told = with_model(asked.withColumn("_prompt", prompt), "_prompt", model, "_said")
    return told.withColumn("condensed", F.when(t.strip("_said") != "", t.strip("_said")).otherwise(F.col("question"))).drop("history", "_prompt", "_said")


def embed(rows: DataFrame, text: str, model: Callable[[], Callable[[list[str]], list[list[float]]]], out: str = "vector") -> DataFrame:
    """``rows`` with the vectors of a batch embedder, loaded once a task."""

    def call(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for frame in frames:
            yield pd.Series(encode([x or "" for x in frame]), index=frame.index)

    vector_of = F.pandas_udf(call, "array<float>")  # type: ignore[call-overload]
    return rows.withColumn(out, vector_of(F.col(text)))
