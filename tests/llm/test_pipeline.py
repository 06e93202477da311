"""The corpus pipeline, stage by stage, against brute force on a small corpus."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import pytest
from test_linking import brute

from papyra.llm import quality
from papyra.llm.common import materialise
from papyra.llm.queries import KEEP_SCORE, quality_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "the result follows from careful work and method because reason shows that measured values agree".split()
BAD = "buy now free click cheap win offer best deal today only order fast prize money bonus".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = tmp_path_factory.mktemp("corpus")
    filler = [f"term{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(filler) + str(i) for _ in range(30))) for i in range(8)]
    docs, labels, leaks = [], [], {}
    for i in range(700):
        y = i % 4 > 0
        words = [rng.choice(GOOD if y else BAD) if rng.random() < 0.6 else rng.choice(filler) for _ in range(rng.randrange(30, 120))]
        if i % 25 == 1:
            leaks[i] = i % 8
            words += items[i % 8][1].split()
        docs.append((i, " ".join(words), "en", rng.choice(["a", "b", None])))
        labels.append((i, int(y), 0))
    for i in range(700, 760):  # copies, exact and with one changed word
        words = docs[rng.randrange(1, 600)][1].split()
        if i % 2:
            words[-1] = "changed"
        docs.append((i, " ".join(words), "de", "c"))
    docs += [(760, None, None, None), (761, "", None, "a")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, items


def test_stages(spark, corpus):
    folder, _, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "minhash near-dedup", "benchmark decontamination", "source mixing", "sharding"]
    after = [docs]
    for _, stage in corpus_pipeline.STAGES:
        after.append(materialise(stage(spark, after[-1], folder), "test"))
    assert all(a.columns == docs.columns for a in after[:-1])
    ids = [[r.doc_id for r in a.select("doc_id").collect()] for a in after]
    texts = {r.doc_id: r.text for r in docs.collect()}

    model = quality_model(spark, docs, folder)
    assert set(ids[1]) == {i for i, x in texts.items() if model.score(quality.features(x)) >= KEEP_SCORE}
    clean = [i for i in texts if i < 700 and i % 4]
    assert len(set(clean) & set(ids[1])) >= 0.97 * len(clean) and len([i for i in ids[1] if i < 700 and not i % 4]) <= 20

    groups = brute([(i, texts[i]) for i in ids[1]])
    assert sorted(ids[2]) == sorted(i for i, (_, _, kept) in groups.items() if kept)

    dirty = {i for i in ids[2] if any(t in (texts[i] or "") for _, t in items)}
    assert dirty and sorted(ids[3]) == sorted(set(ids[2]) - dirty)

    assert set(ids[4]) <= set(ids[3]) and max(Counter(ids[4]).values()) <= 2
    words = {i: len((texts[i] or "").split()) for i in ids[3]}
    total, taken = sum(words.values()), sum(words[i] for i in ids[4])
    assert abs(taken - 1.5 * total) <= 3 * max(words.values())

    assert sorted(ids[5]) == sorted(ids[4]) and {r.shard for r in after[5].collect()} == set(range(16))


def test_run_is_the_stages(spark, corpus):
    folder, docs, _ = corpus
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"]
    assert {r.doc_id for r in out.collect()} <= {d[0] for d in docs}


def test_run_over_empty_tables(spark, corpus, tmp_path):
    folder, _, _ = corpus
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
