"""Hard negatives against brute force over all rows."""

from __future__ import annotations

import random

import numpy as np

from papyra.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, k=5, positives=5, every=100):
    rows = [(i, label, v) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    out = []
    for a, la, va in rows:
        if a % every:
            continue
        own = [(-dot(va, v), i, label == la) for i, label, v in rows if i != a and len(v) == len(va)]
        near = sorted((s, i) for s, i, same in own if same)[:positives]
        for p, pid in near:
            window = sorted((s, i) for s, i, same in own if not same and 80 * -p <= 100 * -s <= 100 * -p)[:k]
            out += [(a, pid, r, i, -p, -s) for r, (s, i) in enumerate(window, 1)]
    return sorted(out)


def test_matches_brute_force(spark, rows):
    rng = random.Random(1)
    vectors = [(i, rng.randrange(4), [float(rng.randrange(-40, 60)) for _ in range(6)]) for i in range(700)]
    vectors += [(700 + i, 2, vectors[100][2]) for i in range(60)] + [(800 + i, 3, vectors[100][2]) for i in range(30)]  # ties on either side
    frame = spark.createDataFrame(vectors, SCHEMA).repartition(6)
    assert rows(negatives.hard_negatives(frame)) == sorted(brute(vectors), key=repr)


def test_many_blocks_and_small_products(spark, rows, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 8 * 8 * 10)
    monkeypatch.setattr(negatives, "PRODUCT", 40)
    rng = random.Random(2)
    vectors = [(i, rng.randrange(3), [float(rng.randrange(-9, 9)) for _ in range(4)]) for i in range(260)]
    frame = spark.createDataFrame(vectors, SCHEMA).repartition(3)
    assert rows(negatives.hard_negatives(frame, every=20)) == sorted(brute(vectors, every=20), key=repr)


def test_edge_cases(spark, rows):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (0, 1, [2.0, 1.0]), (1, 1, [2.0, 1.0]), (2, 2, [2.0, 0.0]), (3, None, [9.0, 9.0]), (4, 2, None), (5, 2, [nan, 1.0]), (6, 1, [inf, 1.0]), (7, 1, [None, 1.0]), (None, 1, [1.0, 1.0]),
        (8, 2, [2.0, 1.0, 5.0]), (9, 2, []), (100, 1, []), (101, 1, []), (10, 2, [-5.0, 0.0]), (200, 5, [1.0, 1.0]),
    ]
    frame = spark.createDataFrame([(*v, 1) for v in vectors], SCHEMA + ", rank int")
    assert rows(negatives.hard_negatives(frame)) == sorted(brute(vectors), key=repr) == [(0, 1, 1, 2, 5, 4), (100, 101, 1, 9, 0, 0)]
    assert negatives.hard_negatives(frame.where("false")).count() == 0
    assert negatives.hard_negatives(frame.where("vec_id = 1")).count() == 0


def test_repeated_rows_are_one_pair_and_several_negatives(spark, rows):
    vectors = [(0, 1, [3.0]), (1, 1, [2.0]), (1, 1, [2.0]), (2, 2, [2.0]), (2, 2, [2.0]), (0, 1, [3.0])]
    got = rows(negatives.hard_negatives(spark.createDataFrame(vectors, SCHEMA)))
    assert got == [(0, 1, 1, 2, 6, 6), (0, 1, 2, 2, 6, 6)]


def test_large_products_stay_exact(spark, rows):
    big = float(2**27)
    vectors = [(0, 1, [big, big + 1]), (1, 1, [big, big - 1]), (2, 2, [big, big - 3]), (3, 2, [big - 1, big - 1]), (4, 2, [big, big]), (5, 2, [1e200, 1e200]), (6, 1, [-1e200, 1.0])]
    got = rows(negatives.hard_negatives(spark.createDataFrame(vectors, SCHEMA)))
    assert [r for r in got if r[1] == 1] == [r for r in brute(vectors) if r[1] == 1] and len(got) >= 2
    y = np.array([[2.0**53, 1.0], [3.0, 4.0], [1e300, 0.0]])
    assert negatives.Anchors(np.array([0]), np.array([0]), np.array([[1.0, 3.0]])).scores(y).tolist() == [[2**53 + 3, 15, 2**63 - 1]]


def test_quantised(spark):
    frame = spark.createDataFrame([([0.5, -0.001, 1e300, None],)], "v array<double>")
    assert frame.select(negatives.quantised("v").alias("q")).first().q == [128.0, -1.0, 256e300, None]
    assert spark.createDataFrame([(None,)], "v array<double>").select(negatives.quantised("v").alias("q")).first().q is None
