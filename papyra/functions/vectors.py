"""Scores of vectors and words as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the length that both arrays have."""
    n = F.least(F.size(a), F.size(b))
    return _sum(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, 0 where either vector is zero."""
    sizes = norm(a) * norm(b)
    return F.when(sizes == 0, 0.0).otherwise(dot(a, b) / sizes)


def query_words(question: str) -> list[str]:
    """Distinct lower-case words of two characters or more, sorted."""
    import re

    return sorted({w for w in re.findall(r"\w+", question.lower()) if len(w) >= 2})


def keyword_overlap(words: list[str] | Column, text: Column) -> Column:
    """Share of the words that occur in ``text``, also inside longer words."""
    if isinstance(words, list):
        words = F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")
    low = F.lower(text)
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: F.contains(low, w))) / F.size(words))
