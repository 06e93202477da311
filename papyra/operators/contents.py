"""Tables of contents by a text model whose replies may break off.

A contents of many entries does not fit one reply.  Each row then keeps a
conversation: what has been replied so far, a judgement whether that is all,
and the next prompt, up to a number of turns.  The turns of a row happen inside
the task that holds it, so a lost executor repeats its own rows only, and rows
that are done cost no further round over the others.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.replies import loose_json
from .lines import ordered_text
from .retrieval import with_json_model

#: Turns after the first reply: plain text has one at once and five more, JSON has five.
TEXT_TURNS, JSON_TURNS = 6, 5
_ENTRY = "struct<structure:string,title:string,page:string,physical_index:string>"

Ask = Callable[[], Callable[[str, list[dict]], tuple[str, bool]]]
Judge = Callable[[], Callable[[str, str], bool]]


@dataclass(frozen=True)
class Turns:
    """How a broken-off reply goes on: ``again`` makes (what to keep, the next prompt, the
    messages before it) of (source, first prompt, reply so far); ``join`` adds what comes."""

    again: Callable[[str, str, str], tuple[str, str, list[dict]]]
    join: Callable[[str, str], str]
    most: int


def _text_again(source: str, prompt: str, reply: str) -> tuple[str, str, list[dict]]:
    before = [{"role": "user", "content": prompt}, {"role": "assistant", "content": reply}]
    return reply, "Go on with the table of contents: give only what is still missing.", before


def upto_last_entry(reply: str) -> str:
    """Unfinished JSON up to its last closed object, with the comma that the next one needs."""
    at = reply.rfind("}")
    return reply if at < 0 else reply[: at + 1] + ","


def fenced(reply: str) -> str:
    """What a reply holds behind its first json fence and before the last closing one; all of it without a fence."""
    body = re.sub(r"(?s)<think>.*?</think>", "", reply).strip()
    _, mark, inside = body.partition("```json")
    return (inside.rpartition("```")[0] or inside if "```" in inside else inside).strip() if mark else body


def _json_again(source: str, prompt: str, reply: str) -> tuple[str, str, list[dict]]:
    kept = upto_last_entry(fenced(reply))
    return kept, f"Continue this JSON of a table of contents; reply with the rest only, fenced as json.\n\nRaw contents:\n{source}\n\nJSON so far:\n{kept}", []


def _json_join(kept: str, more: str) -> str:
    # a rest that is not fenced is talk, not JSON
    return kept + fenced(more) if more.lstrip().startswith("```json") else kept


TEXT = Turns(_text_again, lambda kept, more: kept + more, TEXT_TURNS)
JSON = Turns(_json_again, _json_join, JSON_TURNS)


def conversed(rows: DataFrame, source: str, prompt: Column, ask: Ask, judge: Judge, turns: Turns, out: str) -> DataFrame:
    """``rows`` with ``out``, a struct (reply, turns, complete, error).

    ``ask`` makes, once a task, a callable of (prompt, messages before) that gives
    (reply, whether it ended by itself); ``judge`` one of (source, reply) that says
    whether the reply is all.  A row goes on until both hold or its turns are used
    up; then it is not complete and keeps what it has.  An error ends a row with
    what it had before.  Null and blank sources are not asked: they are complete
    and empty, with no turns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        say, whole = ask(), judge()

        def talk(text: str | None, first: str) -> tuple[str, int, bool, str | None]:
            reply, used = "", 0
            if not text or not text.strip():
                return "", 0, True, None
            try:
                reply, ended = say(first, [])
                used = 1
                while not (ended and whole(text, reply)):
                    if used > turns.most:
                        return reply, used, False, None
                    kept, prompt_, before = turns.again(text, first, reply)
                    more, ended = say(prompt_, before)
                    reply, used = turns.join(kept, more), used + 1
                return reply, used, True, None
            except Exception as e:
                return reply, used, False, f"{type(e).__name__}: {e}"

        for frame in frames:
            yield pd.DataFrame([talk(*r) for r in zip(frame["source"], frame["prompt"])], columns=["reply", "turns", "complete", "error"], index=frame.index)

    told = F.pandas_udf(run, "reply string, turns int, complete boolean, error string")  # type: ignore[call-overload]
    return rows.withColumn(out, told(F.struct(F.col(source).alias("source"), prompt.alias("prompt"))))


def raw_contents(pages: DataFrame) -> DataFrame:
    """(doc_id, contents): the contents pages (doc_id, page, text) of each document in order,
    dot leaders as colons.  Null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    return pages.groupBy("doc_id").agg(t.dot_leaders(ordered_text(text, F.col("page"), "")).alias("contents"))


def extracted_contents(docs: DataFrame, ask: Ask, judge: Judge, instructions: str = "Give the full table of contents of this text, dots as colons, and nothing else.") -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``contents``, ``turns``, ``complete`` and
    ``contents_error``: the table of contents that a model finds in each text."""
    told = conversed(docs, "text", F.concat(F.lit(f"{instructions}\n\n"), "text"), ask, judge, TEXT, "_told")
    return told.select(*docs.columns, F.col("_told.reply").alias("contents"), F.col("_told.turns").alias("turns"), F.col("_told.complete").alias("complete"), F.col("_told.error").alias("contents_error"))


def has_page_numbers(docs: DataFrame, model: Callable[[], Callable[[str, str | None], str]], contents: str = "contents") -> DataFrame:
    """``docs`` with ``numbered``: whether a model sees page numbers in the contents; false where it says nothing."""
    prompt = F.concat(F.lit('Are page numbers given in this table of contents? Reply with JSON {"numbered": "yes" or "no"}.\n\n'), F.col(contents))
    told = with_json_model(docs.withColumn("_prompt", prompt), "_prompt", model, '{"numbered": "string"}', "_said")
    said = F.lower(F.get_json_object("_said", "$.numbered"))
    return told.withColumn("numbered", F.coalesce(said == "yes", F.lit(False))).select(*docs.columns, "numbered")


def transformed_contents(docs: DataFrame, ask: Ask, judge: Judge, instructions: str = 'Turn this table of contents into JSON {"table_of_contents": [{"structure": "x.x.x" or null, "title": "...", "page": number or null}]}.') -> DataFrame:
    """``docs`` (doc_id, contents, ...) with ``entries``, ``turns``, ``complete`` and
    ``contents_error``: the contents as (structure, title, page) structs in order.

    A reply that breaks off goes on behind its last whole entry.  Entries of a
    contents that is not complete are those that it has; a page that is no whole
    number is null."""
    told = conversed(docs, "contents", F.concat(F.lit(f"{instructions}\n\n"), "contents"), ask, judge, JSON, "_told")
    body = F.col("_told.reply")
    # what is left open is closed behind its last whole entry
    at = F.length(body) - F.length(F.substring_index(body, "}", -1))
    closed = F.when(F.col("_told.complete"), body).when(F.instr(body, "}") > 0, F.concat(F.substring(body, F.lit(1), at), F.lit("]}")))
    parsed = F.from_json(loose_json(closed), f"struct<table_of_contents:array<{_ENTRY}>>")["table_of_contents"]
    entries = F.transform(F.coalesce(parsed, F.array().cast(f"array<{_ENTRY}>")), lambda e: F.struct(e["structure"].alias("structure"), e["title"].alias("title"), e["page"].try_cast("int").alias("page")))
    return told.select(*docs.columns, entries.alias("entries"), F.col("_told.turns").alias("turns"), F.col("_told.complete").alias("complete"), F.col("_told.error").alias("contents_error"))


def contents_items(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, structure, title, page) of transformed_contents(), ord from 1; documents without entries give none."""
    rows = docs.select("doc_id", F.posexplode("entries").alias("ord", "e"))
    return rows.select("doc_id", (F.col("ord") + 1).alias("ord"), "e.structure", "e.title", "e.page")


def located_items(items: DataFrame, pages: DataFrame, model: Callable[[], Callable[[str, str | None], str]]) -> DataFrame:
    """``items`` (doc_id, ord, structure, title, ...) with ``physical_index``: the page on which
    a model finds each title among ``pages`` (doc_id, page, text), shown to it with
    tags; null for entries that it does not place, or whose tag names no page of these."""
    shown = F.concat(F.lit("<physical_index_"), F.col("page").cast("string"), F.lit(">\n"), F.coalesce("text", F.lit("")), F.lit("\n<physical_index_"), F.col("page").cast("string"), F.lit(">"))
    texts = pages.groupBy("doc_id").agg(ordered_text(shown, F.col("page"), "\n\n").alias("_pages"), F.collect_set("page").alias("_numbers"))
    listed = items.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", "structure", "title"))), lambda e: F.struct(e["structure"].alias("structure"), e["title"].alias("title")))).alias("_toc"))
    ask = F.concat(F.lit('Add "physical_index" to the entries of this contents that begin on one of the pages, as the page\'s tag. Reply with JSON {"entries": [...]}.\n\nContents:\n'), "_toc", F.lit("\n\nPages:\n"), "_pages")
    told = with_json_model(texts.join(listed, "doc_id").withColumn("_prompt", ask), "_prompt", model, '{"entries": "array"}', "_said")
    found = told.select("doc_id", "_numbers", F.explode(F.from_json("_said", f"struct<entries:array<{_ENTRY}>>")["entries"]).alias("e"))
    number = F.regexp_extract("e.physical_index", r"physical_index_([0-9]+)", 1).try_cast("int")
    placed = found.where(F.array_contains("_numbers", number)).groupBy("doc_id", F.col("e.title").alias("title")).agg(F.min(number).alias("physical_index"))
    return items.drop("physical_index").join(placed, ["doc_id", "title"], "left")
