"""Compounds of flagged tokens and their neighbours, against a plain restatement."""

from __future__ import annotations

import random
import re
import unicodedata

from papyra.operators import spell

TERMS = [("thành phố", 90), ("thánh phố", 7), ("hợp đồng", 50), ("quyền hạn", 30), ("phố cổ", 20), ("đô thị", 10), ("xyz", 5)]


def base(word):
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c)).replace("đ", "d")


def restated(texts, flagged):
    known: dict[str, list] = {}
    for term, freq in TERMS:
        known.setdefault(base(term), []).append((-freq, term))
    letters = re.compile(r"[^\W\d_]+$")
    out = []
    for doc_id, text in texts:
        own = sorted((p, tok) for d, tok, p in flagged if d == doc_id)
        skip = False
        for i, (at, tok) in enumerate(own):
            if skip:
                skip = False
                continue
            end, tries = at + len(tok), []
            if i + 1 < len(own) and re.fullmatch(r"\s?", text[end : own[i + 1][0]]):
                tries.append((1, own[i + 1][1], f"{base(tok)} {base(own[i + 1][1])}", at, own[i + 1][0] + len(own[i + 1][1])))
            m = re.match(r"(\s{0,2})(\S+)", text[end:])
            if m and letters.match(m[2]):
                tries.append((2, m[2], f"{base(tok)} {base(m[2])}", at, end + len(m[0])))
            m = re.search(r"(?:^|\s)(\S+?)(\s{0,2})$", text[:at])
            if m and letters.match(m[1]):
                tries.append((3, m[1], f"{base(m[1])} {base(tok)}", at - len(m[2]) - len(m[1]), end))
            for kind, other, key, start, stop in tries:
                if key in known:
                    out.append((doc_id, tok, at, other, start, stop, [x for _, x in sorted(known[key])]))
                    skip = kind == 1
                    break
    return sorted(out, key=repr)


def test_compounds_match_a_plain_restatement(spark, rows):
    rng, words = random.Random(3), ["thanh", "pho", "hop", "dong", "quyen", "han", "co", "đo", "thi", "khac", "12", "Thanh"]
    texts, flagged = [], []
    for d in range(120):
        parts = [rng.choice(words) for _ in range(rng.randrange(1, 14))]
        text, places = "", []
        for p in parts:
            text += rng.choice(["", " ", "  ", "   ", "\n", ", "]) if text else ""
            if text and text[-1].isalnum():
                text += " "
            places.append((p, len(text)))
            text += p
        texts.append((d, text))
        # as tokens() does, a word is flagged at its first place only
        first: dict[str, int] = {}
        for p, at in places:
            first.setdefault(p, at)
        flagged += [(d, p, at) for p, at in first.items() if p.isalpha() and rng.random() < 0.6]
    frame = spark.createDataFrame([(d, tok, at, base(tok)) for d, tok, at in flagged], "doc_id long, token string, position int, base_form string").repartition(3)
    docs = spark.createDataFrame([*texts, (999, None)], "doc_id long, text string")
    terms = spark.createDataFrame(TERMS, "term string, freq long")
    got = rows(spell.compound_fixes(frame, docs, terms))
    assert got == restated(texts, flagged) and len(got) > 20
    assert spell.compound_fixes(frame.where("false"), docs, terms).count() == 0


def test_one_fix_replaces_both_words(spark):
    docs = spark.createDataFrame([(1, "ky hop  dong o do thi"), (2, "thanh pho co")], "doc_id long, text string")
    flagged = spark.createDataFrame([(1, "dong", 8, "dong"), (1, "do", 15, "do"), (2, "pho", 6, "pho")], "doc_id long, token string, position int, base_form string")
    terms = spark.createDataFrame(TERMS, "term string, freq long")
    found = spell.compound_fixes(flagged, docs, terms)
    assert {r.doc_id: (r.text, r.n_fixes) for r in spell.apply_compounds(docs, found).collect()} == {1: ("ky hợp đồng o đô thị", 2), 2: ("thanh phố cổ", 1)}
