"""Licence scans: a trained paragraph classifier, confirmed by templates.

A multinomial logistic regression over indicators of word 2- and 3-grams says
for each paragraph which licence family it states, or none: the class "unknown"
is learnt from the corpus's own paragraphs.  How far a family is ahead of
"unknown" becomes a probability by a curve calibrated on all paragraphs of the
corpus, and what the classifier finds is compared with the family's templates.
Everything that touches the corpus is built-in functions.  A paragraph is read
once: of its words only those of the templates count, and only the templates'
n-grams leave the scan.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, materialise

UNKNOWN = "unknown"

#: Public licence notices, by family.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
}

_WORD = "a-z0-9À-\U0010ffff"
#: Margins of the same quarter are one row of the calibration, from -CLIP to CLIP.
QUARTER, CLIP = 4, 40


def paragraphs(text: Column | str) -> Column:
    """The paragraphs of a text: lines, where a line that ends within a sentence goes
    on in the next one, unless that is blank.  Blank ones count as paragraphs too."""
    return F.split(F.regexp_replace(text, r"(?<=[^.!?:;\s])[ \t\r]*\n(?=[ \t]*[^\s])", " "), "\n")


def paragraph_words(paragraph: Column) -> Column:
    """Lower-cased words without outer dots and hyphens; empty strings do not occur."""
    plain = F.regexp_replace(F.lower(paragraph), f"(?<![{_WORD}.-])[.-]+|[.-]+(?![{_WORD}.-])", " ")
    return F.filter(F.split(plain, f"[^{_WORD}.-]+"), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    """Runs of n words; none where a word is null, or of a shorter paragraph."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.concat(F.get(words, i), *(part for j in range(1, n) for part in (F.lit(" "), F.get(words, i + j))))), lambda g: g.isNotNull())


def ngrams(words: Column) -> Column:
    return F.array_distinct(F.concat(_grams(words, 2), _grams(words, 3)))


def shingles(words: Column, sizes: tuple[int, ...] = (SHINGLE_WORDS,)) -> Column:
    """Distinct shingles of each of the sizes."""
    return F.array_distinct(F.concat(*(_grams(words, n) for n in sizes)))


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table that is part of the plan."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def templates_table(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """(family, template, words) of the templates that have words."""
    rows = [{"family": f, "template": i, "text": t} for f, texts in sorted(templates.items()) for i, t in enumerate(texts)]
    return literal_table(spark, rows, "family:string,template:int,text:string").select("family", "template", paragraph_words(F.col("text")).alias("words")).where(F.size("words") > 0)


@dataclass(frozen=True)
class Classifier:
    """Weights of the templates' n-grams, one a class, whatever the corpus; and what
    the scan keeps: the templates' words, n-grams and shingle sizes."""

    classes: list[str]
    weights: dict[str, list[float]]
    intercepts: list[float]
    words: list[str]
    sizes: tuple[int, ...]

    def table(self, spark: SparkSession) -> DataFrame:
        return literal_table(spark, [{"gram": g, "w": w} for g, w in sorted(self.weights.items())], "gram:string,w:array<double>")


def _examples(stated: DataFrame, frames: DataFrame) -> DataFrame:
    """(family, words): templates, their overlapping halves, and each of them between corpus words."""
    half, third = F.floor(F.size("words") / 2).cast("int"), F.floor(F.size("words") / 3).cast("int")
    first, second = F.slice("words", 1, F.greatest(half + third, F.lit(4))), F.slice("words", F.greatest(F.least(half - third, F.size("words") - 4), F.lit(0)) + 1, 10_000)
    cuts = stated.select("family", F.explode(F.array(F.col("words"), first, second)).alias("words"))
    framed = cuts.crossJoin(F.broadcast(frames)).select("family", F.concat("frame", "words", "frame").alias("words"))
    return cuts.union(framed)


def background_paragraphs(docs: DataFrame, stated: DataFrame, background: int) -> DataFrame:
    """(k, words) of one paragraph of each of at most ``background`` documents, by hash
    order, less those that hold a shingle of a template.  Ids are chosen first, so
    no other text moves."""
    with_text = docs.where("doc_id is not null and trim(text) != ''")
    some = with_text.select("doc_id").distinct().select("doc_id", F.xxhash64("doc_id", F.lit(9)).alias("k")).orderBy("k", "doc_id").limit(background)
    texts = with_text.join(F.broadcast(some), "doc_id").groupBy("k").agg(F.min("text").alias("text"))
    lines = F.filter(paragraphs("text"), lambda x: F.trim(x) != "")
    picked = texts.select("k", lines.alias("lines")).where(F.size("lines") > 0).select("k", paragraph_words(F.get("lines", F.pmod("k", F.size("lines")).cast("int"))).alias("words"))
    told = stated.agg(F.array_distinct(F.flatten(F.collect_list(shingles(F.col("words"))))).alias("told"))
    none = materialise(picked, "background").crossJoin(F.broadcast(told))
    return none.where(~F.arrays_overlap(shingles(F.col("words")), "told")).drop("told")


def train(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, background: int = 3000) -> tuple[Classifier, DataFrame]:
    """The classifier, and (family, words) of examples that it has not seen.

    Examples of a family are its templates whole, their halves, and each of them
    between corpus words; those of "unknown" are at most ``background``
    paragraphs of the corpus.  Half of these and of the framed examples are kept
    back.  Null and empty texts teach nothing; without any text "unknown" is
    learnt from an empty paragraph."""
    spark = docs.sparkSession
    stated = templates_table(spark, templates)
    rows = stated.select("words", ngrams(F.col("words")).alias("grams")).collect()
    vocabulary = sorted({g for r in rows for g in r.grams})
    classes = [UNKNOWN, *sorted(templates)]
    none = materialise(background_paragraphs(docs, stated, background), "unknown")
    seen = F.pmod(F.col("k"), F.lit(2)) == 0
    frames = none.where(F.size("words") > 0).groupBy(seen.alias("seen")).agg(F.slice(F.sort_array(F.collect_list(F.struct("k", F.slice("words", 1, 12).alias("frame")))), 1, 4).alias("f"))
    frames = frames.select("seen", F.explode("f.frame").alias("frame"))
    empty = spark.range(1).select(F.lit(UNKNOWN).alias("family"), F.array().cast("array<string>").alias("words"))
    number = F.coalesce(*(F.when(F.col("family") == c, float(i)) for i, c in enumerate(classes)))
    rows_seen = _examples(stated, frames.where("seen").select("frame")).union(none.where(seen).select(F.lit(UNKNOWN), "words")).union(empty)
    examples = materialise(rows_seen.select(number.alias("label"), ngrams(F.col("words")).alias("grams")), "example")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", minTF=1.0)
    model = LogisticRegression(maxIter=60, regParam=1e-3, elasticNetParam=0.0, family="multinomial", standardization=False).fit(vectors.transform(examples))
    matrix = model.coefficientMatrix.toArray()
    weights = {g: [round(float(x), 9) for x in matrix[:, i]] for i, g in enumerate(vocabulary)}
    sizes = tuple(sorted({min(len(r.words), SHINGLE_WORDS) for r in rows}))
    unseen = _examples(stated, frames.where("not seen").select("frame")).union(none.where(~seen).select(F.lit(UNKNOWN), "words")).union(empty)
    return Classifier(classes, weights, [float(x) for x in model.interceptVector], sorted({w for r in rows for w in r.words}), sizes), unseen


def _known(words: Column, model: Classifier) -> Column:
    """The words with null for those that no template has."""
    return F.transform(words, lambda w: F.when(w.isin(model.words), w))


def _vocabulary_grams(known: Column, model: Classifier) -> Column:
    return F.filter(ngrams(known), lambda g: g.isin(list(model.weights)))


def _scored(found: DataFrame, keys: list[str], model: Classifier) -> DataFrame:
    """``keys`` and has, with family, margin and share: the likeliest family of each
    row (keys, grams, has), how far its logit is above "unknown" and its share among families."""
    # the weights have one row an n-gram of the templates, whatever the corpus
    each = found.select(*keys, "has", F.explode("grams").alias("gram")).join(F.broadcast(model.table(found.sparkSession)), "gram")
    sums = each.groupBy(*keys).agg(F.first("has").alias("has"), *(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(model.classes))))
    logits = [F.col(f"s{i}") + F.lit(b) for i, b in enumerate(model.intercepts)]
    most = F.greatest(*logits[1:], F.lit(float("-inf")))
    total = sum((F.exp(x - most) for x in logits[2:]), F.exp(logits[1] - most))
    best = F.greatest(*(F.struct(x.alias("x"), F.lit(c).alias("family")) for x, c in zip(logits[1:], model.classes[1:])))
    return sums.select(*keys, "has", best["family"].alias("family"), (best["x"] - logits[0]).alias("margin"), (1 / total).alias("share"))


def _curve(scored: DataFrame, unseen: DataFrame, percent: int) -> tuple[float, float]:
    """Slope and offset of the probability that a margin means a licence.

    Learnt from all paragraphs of the corpus that hold an n-gram of the templates (any
    other has the same margin, that of no evidence): those that a template confirms are
    licences, those that share less than half as much with one are none, and what
    lies between says nothing.  Examples that the classifier has not seen are
    added, each as one paragraph.  The fit is on counts by quarters of a margin."""
    told = F.when(F.col("similarity") * 100 >= percent, 1.0).when(F.col("similarity") * 200 < percent, 0.0)
    at = (F.round(F.greatest(F.least("margin", F.lit(float(CLIP))), F.lit(-float(CLIP))) * QUARTER) / QUARTER).alias("m")
    counts = scored.select(at, told.alias("label")).union(unseen.select(at, "label")).where("label is not null").groupBy("m", "label").agg(F.count("*").cast("double").alias("n"))
    counts = materialise(VectorAssembler(inputCols=["m"], outputCol="features").transform(counts), "margin")
    if counts.select("label").distinct().count() < 2:
        return 1.0, 0.0
    curve = LogisticRegression(maxIter=100, regParam=1e-6, weightCol="n", standardization=False).fit(counts)
    return float(curve.coefficients[0]), float(curve.intercept)


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """(row, doc_id, paragraph, grams, has) of the paragraphs with any of the templates'
    n-grams: those n-grams, and the shingles that are words of templates throughout."""

    def read(p: Column, i: Column) -> Column:
        known = F.transform(F.array(_known(paragraph_words(p), model)), lambda w: F.struct(i.alias("paragraph"), _vocabulary_grams(w, model).alias("grams"), w.alias("known")))
        return F.get(known, F.lit(0))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.transform(paragraphs("text"), read)).alias("p"))
    rows = rows.where(F.size("p.grams") > 0)
    return rows.select("row", "doc_id", "p.paragraph", "p.grams", shingles(F.col("p.known"), model.sizes).alias("has"))


def license_scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, percent: int = 75) -> DataFrame:
    """(doc_id, paragraph, family, probability, template_similarity, confirmed) of each
    paragraph that states a licence family, as the classifier finds it at a
    calibrated probability of one half, or below if a template confirms the family.

    A paragraph is a line, or several where a line ends within a sentence,
    numbered from 0 in its document, blank ones included.  Similarity is the
    largest share of a template of that family whose five-word shingles (all
    words of a shorter template) are in the paragraph, confirmed if it reaches
    ``percent`` hundredths.

    Null and empty texts and blank lines yield nothing.  Rows without a doc_id
    are left out.  Rows that repeat a doc_id are scanned each; equal findings are
    one row, with the highest figures.  Other columns are ignored; an empty table
    gives an empty result."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    model, unseen = train(docs, templates)
    keys = ["row", "doc_id", "paragraph"]
    scored = _scored(scan(docs, model), keys, model)
    size = F.least(F.size("words"), F.lit(SHINGLE_WORDS))
    told = F.coalesce(*(F.when(size == n, F.array_distinct(_grams(F.col("words"), n))) for n in model.sizes))
    # some thirty rows: the templates
    stated = templates_table(spark, templates).groupBy("family").agg(F.collect_list(told).alias("told"))
    share = F.array_max(F.transform("told", lambda t: F.size(F.array_intersect(t, F.col("has"))) / F.size(t)))
    scored = materialise(scored.join(F.broadcast(stated), "family").select("doc_id", "paragraph", "family", "margin", "share", share.alias("similarity")), "licence")
    held = unseen.select(F.monotonically_increasing_id().alias("row"), (F.col("family") != UNKNOWN).cast("double").alias("label"), _vocabulary_grams(F.col("words"), model).alias("grams"), F.array().cast("array<string>").alias("has"))
    slope, offset = _curve(scored, _scored(held, ["row", "label"], model), percent)
    licence = 1 / (1 + F.exp(-F.greatest(F.least(F.col("margin") * slope + offset, F.lit(30.0)), F.lit(-30.0))))
    confirmed = F.col("similarity") * 100 >= percent
    # of this family: that it is a licence, and this one of all
    out = scored.withColumn("probability", licence * F.col("share")).where((F.col("probability") >= 0.5) | confirmed)
    out = out.groupBy("doc_id", "paragraph", "family").agg(F.max("probability").alias("probability"), F.max("similarity").alias("template_similarity"))
    return out.withColumn("confirmed", F.col("template_similarity") * 100 >= percent)
