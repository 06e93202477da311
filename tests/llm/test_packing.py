"""Packing: ids against whole texts, plans against bounds and best fit, sequences without gaps."""

from __future__ import annotations

import bisect
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from papyra.llm import bestfit, queries, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(queries.TOKENIZER)


@pytest.fixture(scope="module")
def whole():
    """Ids of a text by the tokenizer alone."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = [
    None, "", " ", "\n\t ", "it's, I'M --'s a's 'S' don't!! x...y (a) [b]-", "é ́ é É ß ẞ İi Σς σΣ ﬁ ½ ² Ⅷ", "a0b 10 00 0", "naïve. Ab.,. AB... a.-b", "<|endoftext|> a<|startoftext|>b",
    "\x0b\x0c\x1c\x85  x​y", "日本語テキスト mixed 中文, 12", "tail.*** \"quoted,\" (in) u.s.a. it',", "x" * 3000, "Å Á. K Ω ǅ",
]


def test_ids_are_those_of_whole_texts(whole):
    rng = random.Random(1)
    letters = "abcdefgéñüABCÉ0123.,;'\"-!?* \n\t"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(200)]
    t = tokens.Tokens(PATH)
    for _ in range(2):  # met for the first time, then remembered
        ids, starts = t.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [whole(x) for x in texts]


def test_memory_of_chunks_is_bounded(whole, monkeypatch):
    monkeypatch.setattr(tokens, "GENERATION", 50)
    t, rng = tokens.Tokens(PATH), random.Random(2)
    for _ in range(20):
        texts = [" ".join(f"w{rng.choice('abcdef')}{rng.choice('xyz')}{rng.randrange(60)}" for _ in range(30)) for _ in range(4)]
        ids, starts = t.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [whole(x) for x in texts]
        assert len(t.young) + len(t.old) < 1000


def sequences_of_best_fit(lengths, capacity):
    free, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(free, x)
        if i < len(free):
            left = free.pop(i) - x
        else:
            n, left = n + 1, capacity - x
        bisect.insort(free, left)
    return n


def placed(plan, counts):
    length = np.repeat(np.arange(len(counts)), counts)
    rank = np.concatenate([np.arange(k) for k in counts])
    sequence, offset = plan.place(length, rank)
    return length, sequence, offset


def check(counts, capacity):
    plan = bestfit.plan_sequences(counts)
    length, sequence, offset = placed(plan, counts)
    order = np.lexsort((offset, sequence))
    length, sequence, offset = length[order], sequence[order], offset[order]
    same = sequence[1:] == sequence[:-1]
    assert (offset[1:][same] == (offset + length)[:-1][same]).all() and (offset[1:][~same] == 0).all() and offset[0] == 0
    assert (offset + length).max() <= capacity and len(set(sequence.tolist())) == plan.sequences >= plan.bound
    return plan


@pytest.mark.parametrize(("name", "slack"), [("lognormal", 1.001), ("uniform", 1.015), ("thirds", 1.015), ("ones", 1.03)])
def test_plans_are_near_the_bound(name, slack):
    rng, capacity = np.random.default_rng(3), 512
    lengths = {
        "lognormal": np.clip(rng.lognormal(4.3, 1, 20_000), 1, capacity).astype(int),
        "uniform": rng.integers(1, capacity + 1, 20_000),
        "thirds": np.repeat([171, 170, 256, 255], [3000, 6000, 500, 1500]),
        "ones": np.concatenate([np.ones(20_000, int), rng.integers(1, capacity + 1, 5000)]),
    }[name]
    plan = check(np.bincount(lengths, minlength=capacity + 1), capacity)
    assert plan.sequences <= slack * plan.bound + 2
    assert plan.sequences <= 1.015 * sequences_of_best_fit(lengths.tolist(), capacity) + 2


def test_small_plans_and_the_program_itself():
    assert check(np.bincount([3, 8, 8, 1], minlength=9), 8).sequences == 3
    assert bestfit.plan_sequences(np.zeros(9, np.int64)).sequences == 0
    counts = np.bincount(np.repeat([3, 4, 5], [600, 600, 600]), minlength=13)
    used, bound = bestfit.linear_program(counts)
    assert bound <= 600 and all(sum(c * k for c, k in config) <= 12 for config in used)
    for c in (3, 4, 5):
        assert sum(x * dict(config).get(c, 0) for config, x in used.items()) <= 600 + 1e-6
    value = np.full(13, -np.inf)
    value[[3, 4, 5]] = [3.0, 4.5, 5.0]
    best, take = bestfit.knapsack(value)
    assert best[12] == 13.5 and take[12] == 4 and best[2] == 0 and best[7] == 7.5


def test_best_fill_is_the_fullest():
    rng = random.Random(4)
    for _ in range(200):
        counts = [0] + [rng.choice([0, 0, 1, 2, 5]) for _ in range(12)]
        room = rng.randrange(1, 30)
        sums = {0}
        for length, k in enumerate(counts):
            sums = {s + i * length for s in sums for i in range(k + 1) if s + i * length <= room}
        fill = bestfit._best_fill(counts, room)
        assert sum(c * k for c, k in fill.items()) == max(sums) and all(k <= counts[c] for c, k in fill.items())


def test_pack_keeps_every_token(spark, whole):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(["alpha", "beta,", "gamma.", "delta", "ünder"]) for _ in range(rng.randrange(120))) for _ in range(150)] + ["same text here"] * 40
    docs = [(i, x, 7) for i, x in enumerate(texts)] + [(None, "no id", 7), (3, "again", 7), (3, "again", 7)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, length int").repartition(5)
    packed = bestfit.pack(frame, PATH, capacity=64, end_id=1, with_ids=True)
    got = packed.collect()
    want = {}
    for d, text, _ in docs:
        ids = [*whole(text), 1]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4")
            key = (d, k // 64, k, len(part), zlib.crc32(part.tobytes()), tuple(part.tolist()))
            want[key] = want.get(key, 0) + 1
    found = {}
    for r in got:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids))
        found[key] = found.get(key, 0) + 1
    assert found == want
    for s in bestfit.sequences(packed).collect():
        assert len(s.ids) <= 64 and s.ids == [i for r in sorted((r for r in got if r.sequence_id == s.sequence_id), key=lambda r: r.offset) for i in r.ids]
        assert [d.offset for d in s.documents] == [sum(e.length for e in s.documents[:i]) for i in range(len(s.documents))]
    assert len({r.sequence_id for r in got}) <= 1.02 * sum(r.length for r in got) / 64 + 2


def test_pack_of_no_rows(spark):
    assert bestfit.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
