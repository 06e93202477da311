"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from papyra.llm import variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, times=2):
    form, out = {}, []
    for w, n in counts.items():
        found = [x for x in counts if near(w, x)]
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
        out.append((w, len(found)))
    for i, (w, k) in enumerate(out):
        root = w
        while form[root]:
            root = form[root]
        out[i] = (w, form[w], root, counts[w], k, counts[form[w]] if form[w] else None)
    return out


def variant_counts(rng, alphabet, words, length):
    counts = {}
    for _ in range(words):
        w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(*length)))
        counts[w] = rng.choice([3, 3, 5, 20, 300])
        for _ in range(rng.randrange(4)):
            at, c = rng.randrange(len(w) + 1), rng.choice(alphabet)
            w = rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
            counts.setdefault(w, rng.choice([3, 4, 9, 50]))
            w = w or "e"
    counts.pop("", None)
    return counts


@pytest.mark.parametrize(("alphabet", "length", "most"), [("abé", (1, 7), 2000), ("abcdefÿß", (5, 12), 2000), ("ab", (4, 9), 5), ("abc", (6, 20), 3)])
def test_groups_match_brute_force(spark, rows, monkeypatch, alphabet, length, most):
    monkeypatch.setattr(variants, "CELL_WORDS", most)  # down to cells of a single place
    counts = variant_counts(random.Random(6), alphabet, 250, length)
    frame = spark.createDataFrame(list(counts.items()), "word string, n int").repartition(4)
    assert rows(variants.spelling_groups(frame)) == sorted(brute(counts), key=repr)


def test_long_chains_of_forms_and_long_words(spark, rows):
    chain = {"w" * (5 + i): 3 * 2**i for i in range(12)} | {"x" * 3000: 5, "x" * 2999 + "y": 50}
    frame = spark.createDataFrame(list(chain.items()), "word string, n long")
    assert rows(variants.spelling_groups(frame)) == sorted(brute(chain), key=repr)


def test_near_terminals_of_a_trie():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(6))) for _ in range(200)})
    found = sorted(variants.near_terminals(variants.trie(words)))
    assert found == [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)]


def counted(docs, every):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return sorted((w, n) for w, n in out.items() if len(w) >= 5 and n >= 3)


def test_vocabulary_matches_a_plain_count(spark, rows, monkeypatch):
    monkeypatch.setattr(variants, "HELD_WORDS", 20)
    rng = random.Random(8)
    some = ["Éclair", "éclair", "école", "naïve", "straße", "Über×mut", "abcde", "ABCDE", "abcdef", "word", "a1bcdef", "çağdaş"]
    docs = [(i, " ".join(rng.choice(some) + rng.choice(["", ".", "-", "\n", "x"]) for _ in range(rng.randrange(80)))) for i in range(90)]
    docs += [(90, None), (91, ""), (None, "abcde éclair naïve"), (5, docs[5][1])]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int").repartition(3)
    for every in (3, 97):
        assert rows(variants.vocabulary(frame, every=every)) == counted(docs, every)


def test_empty(spark, rows):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rows(variants.spelling_groups(variants.vocabulary(none))) == []
    alone = spark.createDataFrame([("single", 4), ("words", 9)], "word string, n long")
    assert rows(variants.spelling_groups(alone)) == [("single", None, "single", 4, 0, None), ("words", None, "words", 9, 0, None)]
    odd = spark.createDataFrame([("", 4), (None, 9), ("a", 3), ("b", 7)], "word string, n long")
    assert rows(variants.near_words(odd)) == [("a", "b", 3, 7), ("b", "a", 7, 3)]
