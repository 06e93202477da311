"""Near-duplicates, decontamination and neighbours against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from papyra.llm import ann, decontaminate, minhash
from papyra.llm.components import connected_components

DOCS = "doc_id long, text string"


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs, percent=75):
    sets = [(i, shingles(x)) for i, x in docs]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (a, s) in enumerate(sets):
        for b, u in sets[:k]:
            both = len(s & u)
            if s and u and 100 * both >= percent * (len(s) + len(u) - both):
                low, high = sorted((top(a), top(b)))
                up[high] = low
    return {i: (len(s), top(i), top(i) == i) for i, s in sets}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10_000)}"
    return " ".join(out)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    docs, base = [], [f"w{rng.randrange(10_000)}" for _ in range(120)]
    for i in range(150):  # a chain of near copies around the threshold
        docs.append((i, edited(rng, base, rng.randrange(0, 5))))
    docs += [(200 + i, edited(rng, [f"v{rng.randrange(400)}" for _ in range(rng.randrange(1, 60))], 0)) for i in range(60)]
    docs += [(300, None), (301, ""), (302, "  \n"), (303, "one two"), (304, "ONE\ttwo"), (305, "one two three"), (306, docs[0][1].upper()), (307, "É é"), (308, "é é")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(docs, DOCS).repartition(7)).collect()}
    assert got == brute(docs)


def test_near_duplicates_edge_cases(spark, rows):
    same = "a b c d e f g h"
    docs = spark.createDataFrame([(1, same, 9), (1, "x y z", 9), (5, "x y z", 9), (7, same, 9), (None, same, 9), (None, None, 9)], DOCS + ", component_id long")
    got = rows(minhash.near_duplicates(docs))
    assert [r for r in got if r[0] == 5] == [(5, 1, 1, False)] and [r for r in got if r[0] == 7] == [(7, 4, 1, False)]
    assert [r[2:] for r in got if r[0] is None] == [(None, True)] * 2
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 1]
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_circulant_signature_agrees_with_jaccard():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 100, 100))
    x, y = (minhash.signature(np.concatenate([common, own])) for own in (a, b))
    assert abs((x == y).mean() - 0.75) < 0.1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 900), (None, 3)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert roots == {i: 0 for i in range(301)} | {900: 900}
    assert connected_components(edges.where("false")).count() == 0


def test_decontamination_finds_items_in_long_texts(spark, rows):
    rng = random.Random(5)
    word = lambda: f"t{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "two words")]
    docs, planted = [], set()
    for d in range(60):
        body = [word() for _ in range(rng.randrange(5, 3000))]
        if d % 3 == 0:
            i, text = items[rng.randrange(30)]
            at = rng.randrange(len(body))
            body[at:at] = text.upper().split() if d % 2 else text.split()
            planted.add((d, i))
        docs.append((d, " ".join(body)))
    docs += [(100, None), (101, ""), (102, " ".join(items[3][1].split()[: len(items[3][1].split()) // 2])), (None, items[0][1])]
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(frame, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == planted
    clean = decontaminate.decontaminate(frame.selectExpr("*", "1 as item_id"), bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in planted} and clean.columns == ["doc_id", "text", "item_id"]
    assert decontaminate.contaminated(frame, bench.where("false")).count() == 0


def hidden_copies(items):
    """Documents that hold an item's words in reverse and, in two of three, a copy or near copy further on."""
    rng = random.Random(11)
    word = lambda: f"f{rng.randrange(3000)}"
    near = items[1][1].split()
    near[20] = "changed"
    docs = []
    for d, copy in enumerate((items[0][1].split(), near, [])):
        scattered = items[min(d, 1)][1].split()[::-1]
        docs.append((d, " ".join(scattered + [word() for _ in range(400)] + copy + [word() for _ in range(400)])))
    return docs


def test_scattered_words_do_not_hide_a_copy_further_on(spark):
    items = [(i, " ".join(f"i{i}x{k}" for k in range(40))) for i in range(3)]
    found = decontaminate.contaminated(spark.createDataFrame(hidden_copies(items), DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 0), (1, 1)}
    near = next(r for r in found if r.doc_id == 1)
    assert near.bm25 < 1 and near.item_overlap == 31 / 36


def test_passages_fit_items_beside_a_long_one(spark):
    items = [(i, " ".join(f"i{i}x{k}" for k in range(40))) for i in range(3)] + [(9, " ".join(f"long{k}" for k in range(5000)))]
    halves = items[2][1].split()
    apart = " ".join(halves[:18] + [f"g{k}" for k in range(600)] + halves[18:])  # no passage of the item's size holds it
    docs = [*hidden_copies(items), (3, items[3][1]), (4, apart)]
    found = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 0), (1, 1), (3, 9)}


def test_wand_scores_what_a_full_scan_scores():
    rng = random.Random(2)
    words = [[f"t{rng.randrange(80)}".encode() for _ in range(rng.randrange(3, 30))] for _ in range(50)]
    df = {w: sum(w in row for row in words) for row in words for w in row}
    index = decontaminate.Index(list(range(50)), words).weigh(50, 15.0, df)
    for _ in range(50):
        terms = sorted({index.vocabulary[w] for w in rng.choice(words) + rng.choice(words)})
        full = {}
        for t in terms:
            for k in range(index.at[index.blocks_of[t]], index.at[index.blocks_of[t + 1]]):
                full[int(index.item[k])] = full.get(int(index.item[k]), 0) + float(index.impact[k])
        got = {i: s for b in range(index.blocks) for i, s in index.wand(terms, b, 0.4)}
        assert got == pytest.approx({i: s for i, s in full.items() if s >= 0.4})


def test_many_short_items_take_little_memory():
    rng = random.Random(8)
    words = [[f"w{rng.randrange(200_000)}".encode() for _ in range(20)] for _ in range(20_000)]
    df: dict = {}
    for row in words:
        for w in set(row):
            df[w] = df.get(w, 0) + 1
    index = decontaminate.Index(list(range(len(words))), words).weigh(len(words), 20.0, df)
    arrays = sum(x.nbytes for x in (index.item, index.impact, index.at, index.block, index.top, index.blocks_of))
    assert arrays < 40 * 20 * len(words)  # 3 MB of items
    text = [f"w{rng.randrange(200_000)}".encode() for _ in range(400)]
    text[150:150] = words[777]
    assert set(index.confirmed(text, 0.6, 75, 50)) == {777}


def test_a_small_hold_of_bounds_finds_the_same(monkeypatch):
    rng = random.Random(9)
    words = [[f"t{rng.randrange(300)}".encode() for _ in range(rng.randrange(8, 40))] for _ in range(60)]
    df = {w: sum(w in row for row in words) for row in words for w in row}
    index = decontaminate.Index(list(range(60)), words).weigh(60, 20.0, df)
    texts = [[f"t{rng.randrange(300)}".encode() for _ in range(rng.randrange(0, 900))] for _ in range(20)]
    for k, text in enumerate(texts):
        text[len(text) // 2 : len(text) // 2] = words[k]
    whole = [sorted(index.search(text, 0.5)) for text in texts]
    monkeypatch.setattr(decontaminate, "BOUNDS", 1)
    assert [sorted(index.search(text, 0.5)) for text in texts] == whole and sum(map(len, whole)) >= 20
    # every passage that holds an item's words retrieves it
    for text, got in zip(texts, whole):
        for start in range(0, max(1, len(text) - index.passage // 2), index.passage // 2):
            have = set(text[start : start + index.passage])
            score = {i: sum(float(index.impact[np.flatnonzero(index.item[index.at[index.blocks_of[t]] : index.at[index.blocks_of[t + 1]]] == i) + index.at[index.blocks_of[t]]].sum()) for w, t in index.vocabulary.items() if w in have) for i in range(60)}
            assert {(i, start) for i, s in score.items() if s >= 0.5} == {(i, at) for i, _, at in got if at == start}


def test_all_items_against_all_passages(spark):
    rng = random.Random(31)
    word = lambda: f"q{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(3, 50)))) for i in range(25)] + [(25, "One, two three!")]
    docs = []
    for d in range(50):
        body = [word() for _ in range(rng.randrange(1, 500))]
        own = items[rng.randrange(26)][1].split()
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = word()
        at = rng.randrange(len(body))
        docs.append((d, " ".join(body[:at] + own + body[at:])))
    plain = {i: decontaminate.plain_words(x) for i, x in items}
    df: dict = {}
    for ws in plain.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    mean = sum(len(x.split()) for _, x in items) / len(items)
    want = set()
    for i, ws in plain.items():
        longest = max(len(v) for v in plain.values() if decontaminate.length_class(v) == decontaminate.length_class(ws))
        size, parts = max(128, 2 * longest), decontaminate.halves(ws)
        norm = 1.2 * (0.25 + 0.75 * len(ws) / mean)
        weight = {w: np.log1p((26 - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + norm) for w, n in Counter(ws).items()}
        for d, text in docs:
            have = decontaminate.plain_words(text)
            for start in range(0, max(1, len(have) - size // 2), size // 2):
                part = have[start : start + size]
                shingle = decontaminate.shingles_of(part, decontaminate.shingle_size(parts))
                whole, question, answer = decontaminate.shares(shingle, parts)
                if sum(weight[w] for w in weight if w in set(part)) >= 0.6 * sum(weight.values()) and whole >= 0.75 and min(question, answer) >= 0.5:
                    want.add((d, i))
    found = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and len(want) > 10


def neighbours(x, ids, k, every):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        keep = np.flatnonzero(ids != ids[i])
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in keep[np.lexsort((ids[keep], d[keep]))][:k]]
    return out


def test_neighbours_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 32))
    x = (centres[rng.integers(0, 20, 3000)] + 0.4 * rng.standard_normal((3000, 32))).astype(np.float32)
    x[100:400] = x[7]
    ids = np.arange(3000)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.nearest(frame, 10, 100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    exact = neighbours(x.astype(float), ids, 10, 100)
    assert got.keys() == exact.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in exact[q]}) for q in exact)
    assert hits >= 0.9 * 10 * len(exact)
    assert got[100] == exact[100] and [i for i, _ in got[200]] == [7, *range(100, 109)]


def test_neighbours_edge_cases(spark, rows):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (9, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, rank int")
    assert [(r[0], r[1], r[2], round(r[3], 9)) for r in rows(ann.nearest(frame, 10, 100))] == [(0, 1, 1, 0.0), (0, 2, 2, round(5**0.5, 9))]
    assert ann.nearest(frame.where("false")).count() == 0


def test_distances_of_large_and_small_numbers():
    x = np.array([[1e200, 0.0], [3e200, 4e200], [-1.7e308, 1.7e308], [3e-200, 4e-200], [1.0, 2.0]])
    assert ann.distances(x, np.array([0.0, 0.0])) == pytest.approx([1e200, 5e200, float("inf"), 5e-200, 5**0.5])
    assert ann.distances(np.array([[1e200, 5.0], [1e200, 1e200]]), np.array([1e200, 2.0])) == pytest.approx([0.0, 1e200], abs=1e185)


def test_neighbours_of_large_numbers_do_not_tie(spark):
    vectors = [(i, [1e200 * (1 + i % 37), 1e180 * i]) for i in range(120)] + [(500, [1.0, 2.0])]
    got = [r.vec_id for r in ann.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), 5, 100).where("query_id = 100").orderBy("rank").collect()]
    assert got[:2] == [63, 26] and len(got) == 5


def test_neighbours_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_BYTES", 8 * 8 * 40)  # forty vectors a block
    draw = np.random.default_rng(4)
    x = draw.standard_normal((600, 8))
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    found = ann.nearest(frame, 10, 50).collect()
    assert len(found) == 12 * 10
    hits = 0
    for q in range(0, 600, 50):
        gap = np.sqrt(((x - x[q]) ** 2).sum(1))
        gap[q] = np.inf
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [s for _, _, s in mine] == pytest.approx([gap[i] for _, i, _ in mine])
        hits += len({i for _, i, _ in mine} & set(np.argsort(gap)[:10].tolist()))
    assert hits >= 0.9 * 120


def test_repeated_items_and_documents_are_one_pair(spark):
    rng = random.Random(21)
    item = " ".join(f"i{rng.randrange(900)}" for _ in range(40))
    filler = " ".join(f"f{rng.randrange(900)}" for _ in range(300))
    docs = [(1, f"{item} {filler} {item}"), (1, f"{filler} {item}"), (2, filler), (3, f"{item} {item}")]
    bench = [(7, item), (7, item), (8, item)]
    found = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 7), (1, 8), (3, 7), (3, 8)] and all(r.item_overlap == 1.0 for r in found)


def test_verified_pairs_edge_cases(spark, rows):
    same = "a b c d e f g h"
    texts = spark.createDataFrame([(1, same), (2, same), (3, None), (4, ""), (5, "x"), (5, same), (None, same)], DOCS)
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (3, 4), (1, 5), (1, 99), (None, 1), (2, None)], "a long, b long")
    assert rows(minhash.verified(pairs, texts, 75)) == [(1, 2), (1, 5)] and minhash.verified(pairs.where("false"), texts, 75).count() == 0
