"""JSON out of text models' replies."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Fixed value: what starts a log line after a reply.
LOG_STARTS = ["INFO:", "ERROR:", "WARNING:", "Traceback", "[GIN]", "127.0.0.1:"]


def reply_body(c: Column | str) -> Column:
    """A reply without code fence, thinking blocks and log lines after it."""
    s = strip(c)
    fenced = s.startswith("```")
    s = F.when(fenced, F.regexp_replace(F.regexp_replace(s, r"^```(?:json|JSON)?\s*", ""), r"\s*```\s*$", "")).otherwise(s)
    s = F.regexp_replace(s, r"(?s)<think>.*?</think>", "")
    logs = "|".join(re.escape(x) for x in LOG_STARTS)
    return strip(F.regexp_replace(strip(s), rf"(?s)\n(?:{logs}).*$", ""))


_STRING = r'"(?:[^"\\]|\\.)*"'
_DECODER = json.JSONDecoder()


def first_object(text: str | None) -> str | None:
    """The first JSON object in a text, as JSON; stray characters outside strings and
    commas before a closing bracket are overlooked, None where there is no object."""
    if not text:
        return None
    strings_or = lambda outside: re.compile(rf"({_STRING})|{outside}")
    no_commas = strings_or(r",(?=\s*[}\]])").sub(lambda m: m[1] or "", text)
    clean = strings_or(r"[^{}\[\]:,.+\-0-9 \t\r\ntruefalsn]").sub(lambda m: m[1] or "", no_commas)
    for candidate in (text, no_commas, clean):
        for at in (m.start() for m in re.finditer(r"\{", candidate)):
            try:
                return json.dumps(_DECODER.raw_decode(candidate, at)[0], ensure_ascii=False)
            except ValueError:
                continue
    return None


def json_object(c: Column | str) -> Column:
    """The JSON object that a reply holds, else null."""

    @F.pandas_udf("string")
    def found(bodies: pd.Series) -> pd.Series:
        return bodies.map(first_object)

    return found(reply_body(c))


def loose_json(c: Column | str) -> Column:
    """The fenced or whole reply with None as null and blanks collapsed; ``{}`` if it is no JSON."""
    s = strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(s, r"(?s)```json(.*)```", 1)
    body = strip(F.regexp_replace(F.replace(F.when(fenced != "", fenced).otherwise(s), F.lit("None"), F.lit("null")), r"(?U)\s+", " "))
    repaired = F.regexp_replace(body, r",([\]}])", "$1")

    def valid(x: Column) -> Column:
        return F.try_parse_json(x).isNotNull()

    return F.when(valid(body), body).when(valid(repaired), repaired).otherwise("{}")
