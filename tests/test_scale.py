"""Steps whose work or memory once grew faster than their input."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.functions import text as t
from papyra.operators import geometry, navigate, packing, spell, tables, toc, tree
from papyra.plans import derived, model_queries, tree_queries, value_queries


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_large_sections_sends_no_pages_to_every_task(spark, rows):
    pages = spark.range(3).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("page")).withColumn("token_len", F.lit(50))
    spans = spark.createDataFrame([(0, 1, 2, 30), (1, 1, 2, 9), (2, 1, 5, 20)], "doc_id long, ord int, start_index int, end_index int")
    got = toc.large_sections(spans, pages, least_tokens=801)
    assert rows(got.select("doc_id", "ord", "tokens")) == [(0, 1, 1450)]
    assert "Broadcast" not in plan(got)


BOX = "page int, box_id int, x0 double, x1 double, top double, bottom double"


def test_copies_of_boxes_meet_once(spark, monkeypatch):
    met, real = [], geometry.overlapping
    monkeypatch.setattr(geometry, "overlapping", lambda a, b, *more: (met.append((a.count(), b.count())), real(a, b, *more))[1])
    boxes = spark.createDataFrame([(1, i, 0.0, 10.0, 0.0, 10.0) for i in range(20)] + [(1, 20, None, 10.0, 0.0, 10.0)], BOX)
    regions = spark.createDataFrame([(1, i, 0.0, 8.0, 0.0, 10.0) for i in range(30)], BOX)
    late = {r.box_id: r.region_id for r in geometry.best_overlap(boxes, regions).collect()}
    early = {r.box_id: r.region_id for r in geometry.first_overlap(boxes, regions).collect()}
    kinds = regions.withColumn("type", F.when(F.col("box_id") < 25, "text").otherwise("title"))
    tagged = {r.box_id: r.layoutno for r in geometry.tag_layouts(boxes, kinds).collect()}
    assert late == {i: 29 for i in range(20)} | {20: None} and early == {i: 0 for i in range(20)} | {20: None} and tagged == {i: "title-29" for i in range(20)} | {20: ""}
    assert all(a <= 2 and b <= 2 for a, b in met)


def test_tightest_fit_is_the_nearest_of_all(spark):
    rng = random.Random(5)
    side = lambda: None if rng.random() < 0.05 else float(rng.randrange(40))
    make = lambda n: [(rng.randrange(2), i, side(), side(), 0.0, 1.0, rng.choice(["a", "b", None, "0"])) for i in range(n)]
    boxes, columns = make(80), make(30)
    got = geometry.tightest_fit(*(spark.createDataFrame(x, BOX + ", layoutno string") for x in (boxes, columns)))
    want = {}
    for b in boxes:
        near = []
        for c in columns:
            if c[0] == b[0] and (c[6] or "0") == (b[6] or "0"):
                d = [abs(b[i] - c[i]) for i in (2, 3) if b[i] is not None and c[i] is not None]
                d += [abs(b[2] + b[3] - c[2] - c[3]) / 2] if None not in (*b[2:4], *c[2:4]) else []
                near += [(min(d), c[1])] if d else []
        want[b[1]] = min(near)[1] if near else None
    assert {r.box_id: r.column_id for r in got.collect()} == want
    assert "Window" in plan(got)  # neighbours in one order, no pairs of all with all


class Counted(float):
    """A number that counts how often it is compared."""

    n = 0

    def __lt__(self, other):
        Counted.n += 1
        return float.__lt__(self, other)

    def __gt__(self, other):
        Counted.n += 1
        return float.__gt__(self, other)


def test_settle_sorts_between_walls():
    rng = random.Random(3)
    items = [{"id": i, "n": rng.choice([None, 0, 0, 0, 1]) if i % 9 else 1, "x": Counted(rng.randrange(50))} for i in range(2000)]
    want = list(items)
    for end in range(1, 300):  # as it is told, on the first ones
        for j in range(end, 0, -1):
            a, b = want[j - 1], want[j]
            if None not in (a["n"], b["n"]) and (b["n"], float(b["x"])) < (a["n"], float(a["x"])):
                want[j - 1 : j + 1] = b, a
    assert [r["id"] for r in tables.settle(items[:300], "n", "x")] == [r["id"] for r in want[:300]]
    walls = [r | {"n": 0} for r in items]
    Counted.n = 0
    tables.settle(walls, "n", "x")
    assert Counted.n < 40 * len(walls)


def test_scanned_finds_places_by_halving():
    rng = random.Random(4)
    for _ in range(60):
        boxes = [{"box_id": i, "top": rng.choice([None] + [float(rng.randrange(40)) for _ in range(9)]), "x0": rng.choice([None] + [float(rng.randrange(9)) for _ in range(9)])} for i in range(60)]
        none_first = lambda v: (v is not None, v or 0.0)
        done = []
        for b in sorted(boxes, key=lambda r: (none_first(r["top"]), none_first(r["x0"]), r["box_id"])):
            at = len(done)
            while at and None not in (b["top"], b["x0"], done[at - 1]["top"], done[at - 1]["x0"]) and abs(b["top"] - done[at - 1]["top"]) < 7 and b["x0"] < done[at - 1]["x0"]:
                at -= 1
            done.insert(at, b)
        assert tables.scanned(boxes, 7) == [b["box_id"] for b in done]
    many = [{"box_id": i, "top": Counted(0), "x0": Counted(-i % 700)} for i in range(3000)]
    Counted.n = 0
    assert len(tables.scanned(many, 7)) == 3000 and Counted.n < 120 * 3000


def test_layouts_ahead_collects_no_boxes(spark):
    layouts = spark.createDataFrame([(1, i, "text", None, 0.0, 10.0 + i, 0.0, 10.0) for i in range(2)], "page int, box_id int, type string, score double, x0 double, x1 double, top double, bottom double")
    boxes = spark.createDataFrame([(1, i, 0.0, 20.0, 0.0, 10.0) for i in range(40)], BOX)
    got = tables.clean_ahead(layouts, boxes)
    assert [r.box_id for r in got.collect()] == [1]
    assert plan(tables.clean_ahead(layouts, boxes)).count("collect_list") <= 2  # the layouts' own list, by parts and whole


def test_safe_fixes_sql_has_the_spaced_markers(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ["+1 (477) 555-4197 x", "41.244.73.125 a b c", "1) a b c", "+ a b c", "a) b", "Điều 5 a b c d", "Mục 3 a b", "số: 12 a b", "a\u00a0b c d", "中国 a b", None, ""]
    frame = spark.createDataFrame([(12 * i + k, x) for i, x in enumerate(texts) for k in range(12)], "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = dict(map(tuple, value_queries.safe_fixes(spark, str(tmp_path)).collect()))
    assert got == dict(con.execute(value_queries.SQL["safe_fixes"]).fetchall())
    assert "structure" not in got[0] and "structure" in got[25]


def test_words_are_found_at_their_first_place(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("aabé1 . \n_") for _ in range(rng.randrange(80))) for _ in range(200)] + ["", "than an _an", "x1 1x"]
    for text in texts:
        words = list(dict.fromkeys(re.findall(r"[^\W_]+", text)))
        assert spell.first_places(text) == [(w, text.find(w)) for w in words if len(w) > 1 and any(c.isalpha() for c in w)]
    frame = spark.createDataFrame([(1, "than an"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in spell.tokens(frame).collect()] == [(1, "than", 0), (1, "an", 2)]
    assert "instr" not in plan(spell.tokens(frame))


def test_words_of_texts_are_not_shuffled(spark):
    texts = spark.createDataFrame([(1, "xin  chao ban. nhe"), (2, None)], "doc_id long, text string")
    flagged = spark.createDataFrame([(1, "chao", 5, "chao"), (2, "ab", 0, "ab")], "doc_id long, token string, position int, base_form string")
    found = spell.neighbours("xin  chao ban. nhe", [5, 10], [9, 13])
    assert found == [{"after": "ban.", "after_at": 10, "before": "xin", "before_at": 0}, {"after": None, "after_at": None, "before": "chao", "before_at": 5}]
    words = spark.createDataFrame([("xin chào", 4)], "term string, freq long")
    got = spell.compound_fixes(flagged, texts, words)
    assert [tuple(r) for r in got.collect()] == [(1, "chao", 5, "xin", 0, 9, ["xin chào"])]
    assert "posexplode" not in plan(spell.compound_fixes(flagged, texts, words))


def test_cells_and_parts_meet_by_their_table(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 10.0, 0.0, 10.0, "a"), (2, 1, 0.0, 10.0, 0.0, 10.0, "b")], BOX + ", text string")
    parts = spark.createDataFrame([(1, "row", 0, 0.0, 9.0, 0.0, 10.0), (1, "row", 1, 9.0, 20.0, 0.0, 10.0), (1, "column", 3, 5.0, 12.0, 0.0, 9.0)], "page int, kind string, number int, x0 double, x1 double, top double, bottom double")
    got = tables.placed_cells(boxes, parts)
    assert sorted((r.page, r.text, r.row, r.column, r.header) for r in got.collect()) == [(1, "a", 0, 3, None), (2, "b", None, None, None)]
    assert "_bx" not in plan(got)


def test_contents_meet_their_pages_few_times(spark, rows):
    pages = spark.createDataFrame([(d, p, f"T{p}") for d in (1, 2, 3) for p in (1, 2, 3)], "doc_id long, page int, text string")
    entries = [(1, 1, "T1", 1), (1, 2, "T2", 2), (1, 3, "T3", 3), (2, 1, "T1", 1), (2, 2, "T2", 2), (2, 3, "T3", 2), (3, 1, "zz", 3)]
    first = spark.createDataFrame(entries, "doc_id long, ord int, title string, physical_index int")
    second = spark.createDataFrame([(3, 1, "T2", 2), (1, 1, "T2", 2), (3, 2, "T3", 9)], first.schema)
    # right at once, mended, the second contents without the entry beyond the last page
    want = [(1, 0, 1, "T1", 1), (1, 0, 2, "T2", 2), (1, 0, 3, "T3", 3), (2, 0, 1, "T1", 1), (2, 0, 2, "T2", 2), (2, 0, 3, "T3", 3), (3, 1, 1, "T2", 2)]
    got = toc.settled_toc([first, second], pages)
    assert rows(got) == want
    # 466 where each mode and round met the pages by itself
    assert plan(toc.settled_toc([first, second], pages)).count("Join ") < 60
    spans = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 7, 7), (1, 3, 3, 3), (1, 4, None, 3)], "doc_id long, ord int, start_index int, end_index int")
    shown = tree.span_texts(spans, pages.withColumn("text", F.when(F.col("page") < 3, F.col("text"))))
    assert plan(shown).count("Join ") == 1
    assert rows(shown.select("ord", "text")) == [(1, "T1T2"), (2, None), (3, ""), (4, None)]


def test_nodes_meet_no_nodes_on_the_way_down(spark, rows):
    nodes = spark.createDataFrame([(1, 1, "0", None, "A", None), (1, 2, "1", 1, "B", None), (2, 1, "0", None, "A", None)], "doc_id long, ord int, node_id string, parent_ord int, title string, summary string")
    asked = spark.createDataFrame([(7, 1, "q")], "question_id long, doc_id long, question string")
    model = lambda: lambda p: '{"node_list": ["0", "1"]}'
    got = navigate.chosen_nodes(asked, nodes, model)
    assert plan(got).count("Join ") == 1
    assert rows(got) == [(7, 1, 1, "1")]
    bounds = tree.line_bounds(spark.createDataFrame([(1, 1, 3), (1, 2, 3), (1, 3, 9)], "doc_id long, ord int, line_num int"))
    assert rows(bounds.select("ord", "start_line", "end_line")) == [(1, 3, 8), (2, 3, 8), (3, 9, None)]
    assert "Join" not in plan(bounds)


def test_groups_of_lines_are_slices(spark, rows):
    lines = spark.createDataFrame([(1, 1, "Điều 1. abc"), (1, 2, "còn lại"), (1, 3, "a) mục"), (2, 1, None), (2, 2, "x")], "doc_id long, line_id int, text string")
    got = packing.blocks(lines)
    assert rows(got.select("doc_id", "block_id", "text", "first_line", "start_line", "end_line", "line_count")) == [
        (1, 1, "Điều 1. abc\ncòn lại", "Điều 1. abc", 1, 2, 2), (1, 2, "a) mục", "a) mục", 3, 3, 1), (2, 1, "", None, 1, 1, 1), (2, 2, "x", "x", 2, 2, 1),
    ]
    # one aggregate a document, none a group
    assert "min_by" not in plan(got) and "min_by" not in plan(packing.sentence_segments(lines))
    chunks = packing.chunk_signals(packing.semantic_chunks(got))
    assert "min_by" not in plan(chunks) and "bool_or" not in plan(chunks)
    assert rows(chunks.where("doc_id = 1").select("text", "candidate_header", "has_numbering", "numbering_level", "block_count"))[0][0].startswith("Điều 1. abc")


def test_lines_without_faults_are_searched_once(spark):
    rng = random.Random(8)
    bits = [" ", "  ", "\t", "﻿", " ", "\n", ",", ".", ";", ":", "/", "-", " - ", "a", "Số", "so", "ngay 5 tháng", "thang 12", "nam 2020", "_", "1", "IV.", "Điều 3", "é", "\x0b", "Mục 2 "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(3000)] + ["", None, "plain words only"]
    frame = spark.createDataFrame([(x,) for x in texts], "x string")

    def in_full(c):
        return t._spaced(t._ruled(t._spaced(c)))

    wrong = frame.where(~(t.spacing("x").eqNullSafe(t._spaced(F.col("x")))) | ~(t.rule_corrections("x").eqNullSafe(in_full(F.col("x")))))
    assert wrong.collect() == []
    for spaced in (False, True):
        kinds = [t.is_marker("x", k, spaced) for k in t.MARKERS] + [t.strip("x").rlike(t.CHAPTER_NUMBERED if spaced else t.CHAPTER)]
        each = F.greatest(*kinds)
        assert frame.where(~t.any_marker("x", spaced).eqNullSafe(each)).collect() == []
    assert plan(frame.select(t.any_marker("x"))).count("RLIKE") <= 2


def test_outlines_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(derived, "ROWS_A_TASK", 500)
    got = tree_queries.sibling_levels(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() + spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert "hashpartitioning(doc_id" in plan(got) and f", {-(-rows // 500)}), REPARTITION_BY_NUM" in plan(got)


def test_region_markdown_sends_a_table_once(spark):
    got = model_queries.region_markdown(spark, "/root/testdata/sf0.001")
    # items for the boxes and for the parts; cells, lines and captions are not dealt again
    assert plan(got).count("Exchange hashpartitioning") == 2


def test_boxes_lie_in_the_parts_that_cover_most(spark, monkeypatch):
    rng = random.Random(9)
    side = lambda: None if rng.random() < 0.05 else float(rng.randrange(60))
    boxes = [(rng.randrange(4), i, side(), side(), side(), side()) for i in range(150)]
    parts = [(page, kind, i, *(float(rng.randrange(60)) for _ in range(4))) for page in range(3) for kind in tables.PART_LABELS for i in range(9)]
    want = {}
    for page, i, x0, x1, top, bottom in boxes:
        best, lines = {}, []
        for q, kind, number, u0, u1, v0, v1 in parts:
            if q != page:
                continue
            if kind == "column":
                d = [abs(a - b) for a, b in ((x0, u0), (x1, u1)) if a is not None] + ([] if None in (x0, x1) else [abs(x0 + x1 - u1 - u0) / 2])
                lines.append((min(d, default=-1.0), number))
            elif None not in (x0, x1, top, bottom) and x0 < x1 and top < bottom and u0 < u1 and v0 < v1:
                shared = max(min(x1, u1) - max(x0, u0), 0.0) * max(min(bottom, v1) - max(top, v0), 0.0)
                share = shared / ((x1 - x0) * (bottom - top))
                if share >= 0.3:
                    best[kind] = max(best.get(kind, (0.0,)), (share, shared / ((u1 - u0) * (v1 - v0)), number))
        want[i] = tuple(best[k][-1] if k in best else None for k in ("row", "header", "span")) + (min(lines)[1] if lines else None,)
    frames = spark.createDataFrame(boxes, BOX), spark.createDataFrame(parts, "page int, kind string, number int, x0 double, x1 double, top double, bottom double")
    got = {r.box_id: (r.row, r.header, r.span, r.column) for r in tables.placed_cells(*frames).collect()}
    assert got == want and len({x[0] for x in want.values()}) > 3
    # however few pairs are looked at at once
    array = lambda rows, at: np.array([r[at] for r in rows], float)
    own = {s: array(sorted(boxes), 2 + k) for k, s in enumerate(tables.SIDES)}, np.array([b[0] for b in sorted(boxes)])
    others = {s: array(parts, 3 + k) for k, s in enumerate(tables.SIDES)} | {"kind": np.array([tables.KINDS[r[1]] for r in parts]), "number": np.array([r[2] for r in parts])}
    whole = tables.meet(*own, others, np.array([36, 36, 36, 0]))
    monkeypatch.setattr(tables, "PAIRS", 50)
    few = tables.meet(*own, others, np.array([36, 36, 36, 0]))
    assert all((whole[k] == few[k]).all() for k in whole)


def test_table_spans_and_cells_are_the_steps_together(spark, rows):
    for query in (model_queries.table_spans, model_queries.table_cells):
        assert plan(query(spark, "/root/testdata/sf0.001")).count("Exchange hashpartitioning") == 2
    rng = random.Random(2)
    boxes = [(p, 10 * i + j, 100.0 * j + rng.randrange(9), rng.choice([100.0 * j + 60, 100.0 * j + 130, None]), 20.0 * i + rng.randrange(3), 20.0 * i + 15, rng.choice(["a", "7", "", None])) for p in range(12) for i in range(5) for j in range(4)]
    parts = [(p, 10 * k + i, kind, score, 0.0 if kind != "table column" else 100.0 * i, 400.0 if kind != "table column" else 100.0 * i + 95, 20.0 * i if kind != "table column" else 0.0, 20.0 * i + 18 if kind != "table column" else 100.0)
             for p in range(11) for k, kind in enumerate(["table row", "table column", "table row", "table spanning cell"]) for i in range(5) if rng.random() < (0.9 if k < 2 else 0.2) for score in [rng.choice([0.9, 0.5, None])]]
    b, p = spark.createDataFrame(boxes, BOX + ", text string"), spark.createDataFrame(parts, "page int, part_id int, label string, score double, x0 double, x1 double, top double, bottom double")
    cells = tables.placed_cells(b, tables.table_parts(p, b))
    assert rows(tables.recognised_cells(b, p)) == rows(cells) and cells.columns == tables.recognised_cells(b, p).columns
    grid = rows(tables.recognised_tables(b, p))
    assert grid == rows(tables.built_tables(cells)) and any(r[-1] > 1 for r in grid)


def test_flagged_tokens_are_judged_by_the_vocabulary(spark, rows, monkeypatch):
    rng = random.Random(13)
    bits = ["là", "la", "cafe", "café", "Café", "caffe", "cafés", "straße", "ñu", "a1", "1b2", "số: xé", "năm:\nxé", "xé", "éx", "12", "_", "thé", "the", "tho", "Éa", "đa", "da", "ĐA"]
    texts = spark.createDataFrame([(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(14)))) for i in range(150)] + [(900, None), (901, "")], "doc_id long, text string").repartition(3)
    words = spark.createDataFrame([("café", 5000), ("cafe", 30), ("thé", 900), ("the", 80), ("cafés", 7), ("đa", 40), ("tho", 3), ("straße", 4)], "term string, freq long")
    want = rows(spell.candidates(spell.in_context(spell.flag_errors(texts, words), texts), words).select("doc_id", "token", "position", "base_form", "reasons", "candidates"))
    got = spell.flagged_in_context(texts, words)
    assert rows(got) == want and len({r[1] for r in want}) > 8
    assert "ArrowEvalPython" not in plan(got)  # no text is sent to its tokens
    monkeypatch.setattr(spell, "MOST_BASES", 1)
    assert rows(spell.flagged_in_context(texts, words)) == want


def test_near_terms_meet_by_long_keys(spark, rows):
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    terms = sorted({word(rng.randrange(1, 17)) for _ in range(400)})
    asked = sorted({word(rng.randrange(1, 17)) for _ in range(150)} | {w[: len(w) // 2] + "b" + w[len(w) // 2 + 1 :] for w in terms[::9]} | set(terms[::50]))
    words = spark.createDataFrame([(w, i) for i, w in enumerate(terms)], "term string, freq long")
    tokens = spark.createDataFrame([(w,) for w in asked], "token string")
    for edits in (0, 1, 2):
        pairs = tokens.crossJoin(words).withColumn("distance", F.levenshtein("token", "term")).where(F.col("distance") <= edits)
        least = pairs.groupBy("token").agg(F.min("distance").alias("distance"))
        assert rows(spell.near_terms(tokens, words, edits).select("token", "term", "distance", "freq")) == rows(pairs.join(least, ["token", "distance"]).select("token", "term", "distance", "freq"))
    # terms that begin alike are no pairs
    alike = spark.createDataFrame([("abcdefg" + x * 5, 1) for x in "hijklm"], "term string, freq long")
    assert spell.near_terms(spark.createDataFrame([("abcdefgzzzzz",)], "token string"), alike).count() == 0
    assert f", 1, {spell.KEY_LETTERS})" in plan(spell.near_terms(tokens, words))


def test_compounds_are_found_where_the_text_is(spark, rows, monkeypatch):
    rng = random.Random(15)
    words = ["than", "thank", "pho", "hop", "dong", "Pho", "12", "co", "phố"]
    texts = spark.createDataFrame([(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "  ", "   ", "\n", ", ", "-"]) for _ in range(rng.randrange(14)))) for i in range(150)] + [(900, None), (901, "")], "doc_id long, text string").repartition(3)
    terms = spark.createDataFrame([("thán phố", 5), ("thản phố", 9), ("hợp dong", 3), ("phố cỏ", 2), ("pho hop", 8), ("dong thàn", 1)], "term string, freq long")
    flagged = spell.tokens(texts).where(F.col("token").rlike("^[a-z]{3,}$")).withColumn("base_form", F.col("token"))
    want = rows(spell.compound_fixes(flagged, texts, terms))
    got = spell.compound_fixes_of(texts, "[a-z]{3,}", terms)
    # what is dealt are hits; neither texts nor tokens are, and hits are found once
    assert "ArrowEvalPython" not in plan(got) and plan(got).count("MapInArrow") == 1
    assert rows(got) == want and len(want) > 20
    monkeypatch.setattr(spell, "MOST_HASHES", 1)
    assert rows(spell.compound_fixes_of(texts, "[a-z]{3,}", terms)) == want
    # of two words at one place the shorter one comes first
    both = spark.createDataFrame([(1, "thank pho than")], "doc_id long, text string")
    pair = spark.createDataFrame([("thánk pho", 1)], "term string, freq long")
    assert [tuple(r)[1:6] for r in spell.compound_fixes_of(both, "[a-z]{3,}", pair).collect()] == [("thank", 0, "pho", 0, 9)]
