"""Ordered operators against plain restatements of their rules, on random input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from papyra.operators import geometry, lines, packing, recognition, retrieval, rules, spell, stats, toc, tree
from papyra.sources import store
from papyra.streaming import ingest


def random_levels(seed, docs=30):
    rng = random.Random(seed)
    return [(d, o, rng.randrange(1, 7)) for d in range(docs) for o in range(1, rng.randrange(2, 60))]


def stack_parents(levels):
    out, stack, doc = {}, [], None
    for d, o, level in levels:
        if d != doc:
            doc, stack = d, []
        while stack and stack[-1][1] >= level:
            stack.pop()
        out[d, o] = (stack[-1][0] if stack else None, len(stack))
        stack.append((o, level))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_parents_depths_and_subtrees(spark, seed):
    levels = random_levels(seed)
    nodes = spark.createDataFrame(levels, "doc_id int, ord int, level int").withColumn("w", F.col("ord").cast("long"))
    want = stack_parents(levels)
    built = tree.with_subtree_sum(tree.with_depth(tree.with_parents(nodes)), "w", "sub").collect()
    assert {(r.doc_id, r.ord): (r.parent_ord, r.depth) for r in built} == want
    below: dict = {}
    for d, o, _ in levels:
        up = o
        while up is not None:
            below.setdefault((d, up), []).append(o)
            up = want[d, up][0]
    assert {(r.doc_id, r.ord): (r.last_ord, r.sub) for r in built} == {k: (max(x), sum(x)) for k, x in below.items()}


def test_headings_and_fences(spark):
    text = "intro\n# One\nbody\n```\n# not\n```\n  ## indented\n## Two\n####### seven\n#nospace\n```\n# open fence"
    nodes = tree.markdown_tree(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")).collect()
    assert [(r.doc_id, r.title, r.level, r.line_num, r.node_id, r.parent_ord) for r in sorted(nodes, key=lambda r: r.ord)] == [(1, "One", 1, 2, "0000", None), (1, "Two", 2, 8, "0001", 1)]
    assert {r.title: r.text for r in nodes}["One"] == "# One\nbody\n```\n# not\n```\n  ## indented"


def test_node_ids_grow_beyond_four_digits(spark):
    ids = tree.with_node_ids(spark.range(10_002).select(F.lit(1).alias("doc_id"), F.col("id").alias("ord"))).where("ord in (9999, 10000)").orderBy("ord").collect()
    assert [r.node_id for r in ids] == ["9999", "10000"]


def fold_chunks(text, most=1000, overlap=150):
    """Chunks of whole lines; every step keeps the open lines themselves."""
    out, held, size, first = [], [], 0, 1
    for number, line in enumerate(text.split("\n"), 1):
        if held and size + len(line) > most:
            out.append(("\n".join(held), first, first + len(held) - 1))
            tail, room = [], 0
            for x in held[::-1]:
                if room + len(x) >= overlap:
                    break
                tail, room = [x, *tail], room + len(x) + 1
            held = [*tail, line]
            size, first = len("\n".join(held)), number - len(tail)
        else:
            held.append(line)
            size += len(line) + 1
    return [*out, ("\n".join(held), first, first + len(held) - 1)]


def test_chunks(spark):
    rng = random.Random(4)
    texts = ["", "x" * 3000, "\n" * 400, "é" * 999 + "\nb", "a" * 149 + "\n" + "b" * 900] + ["\n".join("y" * rng.choice([0, 3, 40, 149, 150, 700, 1200]) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    got: dict = {}
    for r in packing.chunk_lines(spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "doc_id int, text string")).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.line_num, r.end_line_num))
    assert got == {i: fold_chunks(x) for i, x in enumerate(texts)}


def test_page_parts(spark):
    rng = random.Random(5)
    for _ in range(4):
        tokens = [rng.randrange(1, 90) for _ in range(60)]
        pages = spark.createDataFrame([(1, i, f"<{i}>", n) for i, n in enumerate(tokens)], "doc_id int, page int, text string, token_len int")
        total, most = sum(tokens), 300
        target = -(-(total / -(-total // most) + most) // 2)
        want, open_, size = [], [], 0
        for i, n in enumerate(tokens):
            if size + n > target:
                want.append(open_)
                open_, size = [i - 1], tokens[i - 1]
            open_, size = [*open_, i], size + n
        got = [r.text for r in packing.pack_pages(pages, most).orderBy("part").collect()]
        assert got == ["".join(f"<{i}>" for i in part) for part in [*want, open_]]


def test_blocks_and_sections_respect_caps(spark):
    rows = [(1, i + 1, f"continuing line number {i} goes on,") for i in range(40)] + [(1, 41, "12"), (1, 42, "Điều 1. Phạm vi"), (1, 43, "tiếp theo")]
    out = packing.blocks(spark.createDataFrame(rows, "doc_id int, line_id int, text string")).orderBy("block_id").collect()
    assert [r.line_count for r in out] == [12, 12, 12, 4, 1, 2] and out[4].text == "12"
    found = packing.sections(spark.createDataFrame(out)).orderBy("block_id").collect()
    assert [r.section_id for r in found] == [1, 1, 1, 1, 1, 2] and found[5].anchor == "MAIN_UNIT"


def test_segments(spark):
    rows = ["CHƯƠNG TRÌNH LỚN", "một dòng", "kết thúc.", "Câu hai", "1. điểm", "tiếp theo"]
    out = packing.sentence_segments(spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(rows)], "doc_id int, line_id int, text string")).orderBy("segment_id").collect()
    assert [(r.text, r.kind) for r in out] == [("CHƯƠNG TRÌNH LỚN", "STRUCTURAL_TITLE"), ("một dòng\nkết thúc.", "PARAGRAPH_OR_SENTENCE"), ("Câu hai", "BODY_CONTINUATION"), ("1. điểm", "STRUCTURAL_UNIT"), ("tiếp theo", "BODY_CONTINUATION")]


def test_paragraphs(spark):
    text = "Trang 1\nĐiều 1. Một quy\nđịnh dài\n\nNơi nhận:\n- Một\nCâu đầu tiên kết thúc.\nCâu thứ hai đủ dài để nối vào cùng đoạn văn trước\n12"
    out = lines.paragraphs(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("para").collect()
    assert [r.text for r in out] == ["### Điều 1. Một quy định dài", "## Nơi nhận:", "- Một Câu đầu tiên kết thúc. Câu thứ hai đủ dài để nối vào cùng đoạn văn trước"]


def test_first_law_title_is_demoted(spark):
    rows = [(1, 1, "# LUẬT ĐẤT ĐAI SỐ 1"), (1, 2, "# LUẬT ĐẤT ĐAI SỐ 2"), (1, 3, "## chương i"), (2, 1, "# Điều 3"), (2, 2, "##### a) x"), (2, 3, "text")]
    out = lines.correct_heading_levels(spark.createDataFrame(rows, "doc_id int, line_num int, line string")).orderBy("doc_id", "line_num").collect()
    assert [r.line for r in out] == ["LUẬT ĐẤT ĐAI SỐ 1", "# LUẬT ĐẤT ĐAI SỐ 2", "# chương i", "## Điều 3", "##### a) x", "text"]


def test_prepared_lines_carry_pages(spark):
    text = "a\n=== PAGE 4 ===\nUBND  CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM  Độc lập\n7\nSo: 5"
    out = lines.prepare_lines(lines.explode_lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))).orderBy("line_id").collect()
    assert [(r.line_id, r.text, r.page) for r in out] == [(1, "a", None), (2, "UBND", 4), (3, "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", 4), (4, "Độc lập", 4), (5, "Số: 5", 4)]


def test_offsets_take_the_first_of_equals(spark):
    pairs = spark.createDataFrame([(1, 1, 5, 7), (1, 2, 6, 9), (1, 3, 7, 10), (1, 4, 8, 10), (2, 1, None, 3)], "doc_id int, ord int, page int, physical_index int")
    assert [tuple(r) for r in toc.page_offsets(pairs).collect()] == [(1, 2)]


def test_dotted_codes_take_the_latest_parent(spark, rows):
    items = spark.createDataFrame([(1, 1, "1"), (1, 2, "1.1"), (1, 3, "1"), (1, 4, "1.2"), (1, 5, "2.3.1"), (1, 6, "1.1.9")], "doc_id int, ord int, code string")
    assert [(r[1], r[3]) for r in rows(tree.dotted_parents(items))] == [(1, None), (2, 1), (3, None), (4, 3), (5, None), (6, 2)]


def greedy(boxes, most):
    left, out = sorted(boxes, key=lambda b: (-b[6], b[0])), []
    area = lambda b: (b[3] - b[2]) * (b[5] - b[4])
    while left:
        a, *left = left
        out.append(a[0])
        both = lambda b: max(0, min(a[3], b[3]) - max(a[2], b[2]) + 1) * max(0, min(a[5], b[5]) - max(a[4], b[4]) + 1)
        left = [b for b in left if both(b) / (area(a) + area(b) - both(b)) <= most]
    return sorted(out)


def test_suppression(spark):
    rng = random.Random(6)
    boxes = [(i, 1, (x := rng.randrange(50) * 1.0), x + 20, (y := rng.randrange(50) * 1.0), y + 20, rng.randrange(9) / 9) for i in range(80)]
    frame = spark.createDataFrame([(1, "t", *b) for b in boxes], "page int, kind string, box_id int, n int, x0 double, x1 double, top double, bottom double, score double")
    assert sorted(r.box_id for r in geometry.suppress(frame).collect()) == greedy(boxes, 0.45)


def test_layout_tags(spark):
    schema = "page int, box_id int, type string, x0 double, x1 double, top double, bottom double"
    layouts = spark.createDataFrame([(1, 1, "text", 0.0, 100.0, 0.0, 50.0), (1, 2, "footer", 0.0, 100.0, 90.0, 100.0), (1, 3, "table", 0.0, 100.0, 0.0, 40.0)], schema)
    boxes = spark.createDataFrame([(1, 1, "", 1.0, 9.0, 1.0, 9.0), (1, 2, "", 1.0, 9.0, 91.0, 99.0), (1, 3, "", 1.0, 9.0, 60.0, 70.0)], schema).drop("type")
    assert {r.box_id: (r.layout_type, r.layoutno) for r in geometry.tag_layouts(boxes, layouts).collect()} == {1: ("table", "table-3"), 3: ("", "")}


def test_thin_tree_takes_whole_subtrees(spark):
    levels = [(1, 1), (2, 2), (3, 3), (4, 2), (5, 1)]
    nodes = spark.createDataFrame([(1, o, k, f"t{o}", 10) for o, k in levels], "doc_id int, ord int, level int, text string, tokens long")
    out = packing.thin_tree(tree.with_subtree_sum(nodes, "tokens", "subtree_tokens"), 25).orderBy("ord").collect()
    assert [(r.ord, r.text) for r in out] == [(1, "t1"), (2, "t2\n\nt3"), (4, "t4"), (5, "t5")]


def test_model_rows_are_normalised(spark):
    rows = [("c1", " Header ", "STAY", "9", ["odd", "possible_body"], None), ("c2", "title", "nope", "x", None, False), ("c3", "footer", "remove", "2", [], True), ("c4", None, None, None, None, True)]
    frame = spark.createDataFrame(rows, "chunk_id string, role string, decision string, level string, risk_flags array<string>, is_node boolean")
    got = [(r.role, r.decision, r.level, r.risk_flags, r.is_node) for r in rules.normalise_model_rows(frame).orderBy("chunk_id").collect()]
    assert got == [("HEADING", "KEEP", 4, ["possible_body"], True), ("TITLE", "REVIEW", 1, [], True), ("NOISE", "MARK_NOISE", 0, [], False), ("REVIEW", "REVIEW", 3, [], True)]


def test_roles_below_a_footer(spark):
    first = ["QUYẾT ĐỊNH LỚN", "Số: 12", "Điều 1. x", "- mục", "Nơi nhận:", "- Như trên", "một đoạn văn dài"]
    frame = spark.createDataFrame([(1, i + 1, x, 3 if i == 6 else 1, i / 7) for i, x in enumerate(first)], "doc_id int, block_id int, first_line string, line_count int, position double")
    assert [r.role for r in rules.block_roles(frame).orderBy("block_id").collect()] == ["DOCUMENT_TITLE", "METADATA", "MAIN_CONTENT_UNIT", "LIST_ITEM", "FOOTER_SECTION", "FOOTER_ITEM", "BODY_DETAIL"]


def test_spelling(spark):
    words = spell.dictionary(spark.createDataFrame([("pháp", 900), ("phép", 50), ("luật", 800), ("thẩm quyền", 70), ("tranh", 500), ("tránh", 10), ("số", 990)], "term string, count int"))
    texts = spark.createDataFrame([(1, "Phap luật tham quyen số: phep\npháq 12a tránh")], "doc_id int, text string")
    flagged = spell.flag_errors(texts, words)
    assert {(r.token, *r.reasons) for r in flagged.collect()} == {("Phap", "MISSING_DIACRITICS"), ("phep", "MISSING_DIACRITICS"), ("pháq", "NOT_IN_DICT"), ("12a", "OCR_NOISE")}
    kept = spell.in_context(flagged, texts)
    assert {r.token for r in kept.collect()} == {"Phap", "pháq", "12a"}
    found = {r.token: r.candidates for r in spell.candidates(kept, words).collect()}
    assert found == {"Phap": ["pháp"], "pháq": ["pháp"], "12a": []}
    fixed = spell.apply_fixes(texts, spell.candidates(kept, words)).first()
    assert fixed.text == "Pháp luật tham quyen số: phep\npháp 12a tránh" and fixed.n_fixes == 2


def test_edit_neighbours_match_brute_force(spark):
    rng = random.Random(7)
    terms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9))) for _ in range(120)})
    asked = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9))) for _ in range(40)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = step(row, i, x, b)
        return row[-1]

    def step(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    want = set()
    for a in asked:
        near = {w: edits(a, w) for w in terms if edits(a, w) <= 2}
        want |= {(a, w, d) for w, d in near.items() if d == min(near.values())}
    words = spell.dictionary(spark.createDataFrame([(w, 1) for w in terms], "term string, count int"))
    assert {tuple(r)[:3] for r in spell.near_terms(spark.createDataFrame([(a,) for a in asked], "token string"), words).collect()} == want


def test_model_calls_fall_back(spark):
    def model():
        def reply(prompt):
            if "bad" in prompt:
                raise ValueError
            return prompt.upper()

        return reply

    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, " "), (4, None)], "id int, prompt string")
    assert [r.out for r in retrieval.with_model(rows, "prompt", model, "out", "none").orderBy("id").collect()] == ["OK", "none", "none", "none"]


def test_statistics_edge_cases(spark, rows):
    users = spark.createDataFrame([(1, "admin"), (2, "nguoi_dung"), (3, "odd")], "id int, role string")
    sessions = spark.createDataFrame([(10, 1, "__global__"), (11, None, "d"), (12, 3, "d")], "id int, user_id int, doc_id string")
    messages = spark.createDataFrame([(10, "user"), (10, "assistant"), (11, "user"), (12, "assistant")], "session_id int, role string")
    docs = spark.createDataFrame([("processed",), ("unheard of",)], "status string")
    got = {(s, k): n for s, k, n in rows(stats.admin_statistics(docs, users, sessions, messages))}
    assert got["users_by_role", "can_bo"] == 0 and ("users_by_role", "odd") not in got and got["documents_by_status", "pending"] == 0
    assert {k: n for (s, k), n in got.items() if s == "sessions_by_role"} == {"admin": 1, "odd": 1}
    assert {k: n for (s, k), n in got.items() if s == "questions_by_role"} == {"admin": 1}
    assert {k: n for (s, k), n in got.items() if s == "feature_usage"} == {stats.ASKED_GLOBALLY: 1, stats.ASKED_OF_DOCUMENT: 1}


def test_pages_to_show():
    assert stats.page_model(95, 10, 5) == [1, None, 4, 5, 6, None, 10] and stats.page_model(0, 10, 1) == [1]


def test_files_and_pages(spark, tmp_path, rows):
    for name, text in (("d/page_10.txt", "ten"), ("d/page_2.txt", "two"), ("e/page_1.txt", "one"), ("f/scan.PNG", "x"), ("f/a.bin", "y")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert rows(store.page_texts(spark, str(tmp_path))) == [("d", 1, "two"), ("d", 2, "ten"), ("e", 1, "one")]
    assert rows(store.raw_texts(store.page_texts(spark, str(tmp_path))))[0] == ("d", "=== PAGE 1 ===\ntwo\n\n=== PAGE 2 ===\nten")
    found = store.upload_rows(store.raw_files(spark, str(tmp_path / "f"), content=False))
    assert [(r.filename, r.status) for r in found.orderBy("filename").collect()] == [("a.bin", "skipped"), ("scan.PNG", "pending")]


def test_tables_that_are_missing_or_broken(spark, tmp_path, rows):
    assert store.table_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "c.json").write_text('{"doc_id": "a", "filename": "f"}\n{broken\n{"doc_id": "b"}\n')
    assert [r[0] for r in rows(store.catalogue_json(spark, str(tmp_path / "c.json")))] == ["a", "b"]


def test_replacing_partitions(spark, tmp_path, rows):
    path, schema = str(tmp_path / "chunks"), "text string, doc_id string"
    store.write_replacing(spark.createDataFrame([("x", "a"), ("y", "b")], schema), path, "doc_id")
    store.write_replacing(spark.createDataFrame([("z", "a")], schema), path, "doc_id")
    assert rows(spark.read.parquet(path)) == [("y", "b"), ("z", "a")]


def test_streams(spark, tmp_path, rows):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name in ("a.pdf", "b.xyz"):
        (inbox / name).write_bytes(b"1")
    for _ in range(2):
        ingest.append_uploads(ingest.arriving_files(spark, str(inbox)), str(tmp_path / "docs"), str(tmp_path / "c1")).awaitTermination(60)
    assert [r.status for r in spark.read.parquet(str(tmp_path / "docs")).orderBy("filename").collect()] == ["pending", "skipped"]
    updates = tmp_path / "updates"
    for k, batch in enumerate(([("d", "p1", "2024-01-01"), ("e", "p1", "2024-01-05")], [("d", "p2", "2024-01-02"), ("e", "p0", "2024-01-01")])):
        frame = spark.createDataFrame(batch, "document_id string, payload string, at string").selectExpr("document_id", "payload", "cast(at as timestamp) updated_at")
        frame.coalesce(1).write.mode("append").parquet(str(updates))
        stream = spark.readStream.schema(ingest.PROGRESS).parquet(str(updates))
        ingest.keep_newest(stream, str(tmp_path / "p"), str(tmp_path / "c2")).awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "p" / "1")).select("document_id", "payload")) == [("d", "p2"), ("e", "p1")]


def test_layout_cleanup_and_page_composition(spark):
    schema = "page int, box_id int, type string, score double, x0 double, x1 double, top double, bottom double"
    layouts = spark.createDataFrame([(1, 1, "text", 0.9, 0.0, 10.0, 0.0, 10.0), (1, 2, "text", 0.8, 0.0, 10.0, 1.0, 10.0), (1, 3, "table", 0.7, 0.0, 10.0, 0.0, 10.0), (1, 4, "text", 0.5, 50.0, 60.0, 0.0, 10.0)], schema)
    assert sorted(r.box_id for r in geometry.clean_layouts(layouts).collect()) == [1, 3, 4]
    texts = spark.createDataFrame([(1, 1, 0.0, 9.0, 50.0, 60.0, "below"), (1, 2, 0.0, 9.0, 1.0, 5.0, "in table"), (2, 1, 0.0, 9.0, 1.0, 5.0, "alone")], "page int, box_id int, x0 double, x1 double, top double, bottom double, text string")
    tables = spark.createDataFrame([(1, 1, 0.0, 10.0, 0.0, 10.0, "| a |")], "page int, box_id int, x0 double, x1 double, top double, bottom double, markdown string")
    assert {r.page: r.text for r in geometry.compose_pages(texts, tables).collect()} == {1: "| a |\n\nbelow", 2: "alone"}


def test_asking_one_document(spark):
    rows = [(1, "d", "luật đất đai\nđiều 1", [1.0, 0.0], 3, 4, "a.md"), (2, "d", "khác", [0.0, 1.0], 9, 9, "a.md"), (3, "e", "luật đất đai", [1.0, 0.0], 1, 1, "b.md")]
    chunks = spark.createDataFrame(rows, "chunk_id int, doc_id string, text string, vector array<double>, line_num int, end_line_num int, filename string")
    seen = lambda: lambda p: "[3] luật" in p and "yes" or "no"
    assert retrieval.ask_document(chunks, "d", [1.0, 0.1], "luật gì", seen).collect() == [("d", "yes", "a.md", "3-4")]
    cites = lambda: lambda p: "x [Nguồn: c.md, Dòng: 7-8]"
    assert retrieval.ask_document(chunks, "d", [1.0, 0.1], "luật gì", cites).collect() == [("d", "x", "c.md", "7-8")]
    assert retrieval.ask_document(chunks, "none", [1.0, 0.1], "luật gì", cites).count() == 0


def test_contents_are_repaired_or_fall_back(spark):
    pages = spark.createDataFrame([(d, p, f"page {p} Title{p}") for d in (1, 2, 3) for p in range(1, 9)], "doc_id int, page int, text string")
    # document 1: one wrong page of eight; 2: all wrong, right in the next table; 3: never right
    first = [(1, k, f"Title{k}", 5 if k == 4 else k) for k in range(1, 9)] + [(2, k, "none", k) for k in range(1, 9)] + [(3, 1, "none", 9)]
    second = [(2, 1, "Title1", 1), (2, 2, "Title7", 7), (3, 1, "none", 2)]
    tables = [spark.createDataFrame(x, "doc_id int, ord int, title string, physical_index int") for x in (first, second)]
    got = sorted((r.doc_id, r["mode"], r.ord, r.physical_index) for r in toc.settled_toc(tables, pages).collect())
    assert got == [(1, 0, k, k) for k in range(1, 9)] + [(2, 1, 1, 1), (2, 1, 2, 7)]
    spans = {(r.doc_id, r.title): (r.start_index, r.end_index, r.text) for r in toc.page_index(tables, pages).collect()}
    # a title that does not open its page shares the page with the section before
    assert spans[2, "Title1"][:2] == (1, 7) and spans[2, "Title7"] == (7, 8, "page 7 Title7page 8 Title8")


def test_failing_models_say_why(spark):
    def model():
        calls = []

        def reply(prompt):
            calls.append(prompt)
            if "late" in prompt and calls.count(prompt) < 3:
                raise TimeoutError("busy")
            if "bad" in prompt:
                raise ValueError("no")
            return prompt.upper()

        return reply

    rows = spark.createDataFrame([(1, "late"), (2, "bad"), (3, " ")], "id int, prompt string")
    told = retrieval.with_model(rows, "prompt", model, "out", "none", "why", wait=0.01).orderBy("id").collect()
    assert [(r.out, r.why) for r in told] == [("LATE", None), ("none", "ValueError: no"), ("none", "empty prompt")]


def test_fixes_go_to_their_places_in_order(spark):
    texts = spark.createDataFrame([(1, "phap luat Phap")], "doc_id int, text string")
    flagged = spark.createDataFrame([(1, "phap", 0, ["pháp", "phạp"]), (1, "Phap", 10, ["pháp", "phạp"]), (1, "luat", 5, ["luật"])], "doc_id int, token string, position int, candidates array<string>")
    answers = [(1, 1, "phap", "pháp", "pick"), (1, 2, "PHÁP", "[phạp]", "pick"), (1, 3, "luat", "nowhere", "suggest"), (1, 4, "Hà Nội", "x", "pick")]
    words = spark.createDataFrame([("luật", 9)], "term string, freq long")
    fixes = spell.reviewed_fixes(flagged, spark.createDataFrame(answers, "doc_id int, ord int, word string, chosen string, action string"), words)
    assert [r.text for r in spell.apply_fixes(texts, fixes).collect()] == ["pháp luat Phạp"]


def test_splitting_without_progress_is_an_error(spark):
    spans = spark.createDataFrame([(1, 0, 16)], "doc_id int, ord int, end int")
    with pytest.raises(ValueError):
        recognition.split_large(spans, lambda x: x.where("end - ord > 4"), lambda x: x, rounds=3)


def test_a_models_footer_opens_the_footer(spark):
    blocks = spark.createDataFrame([(1, i, line, 1, i / 10) for i, line in enumerate(["TITLE OF ALL", "Điều 1. one", "words", "more words", "- item", "Điều 2. two"])], "doc_id int, block_id int, first_line string, line_count int, position double")
    model = spark.createDataFrame([(1, 2, "FOOTER_SECTION"), (1, 1, "FOOTER_SECTION")], "doc_id int, block_id int, role string")
    plain = [r.role for r in rules.block_roles(blocks).orderBy("block_id").collect()]
    merged = [r.role for r in rules.block_roles(blocks, model).orderBy("block_id").collect()]
    assert plain == ["DOCUMENT_TITLE", "MAIN_CONTENT_UNIT", "BODY_DETAIL", "BODY_DETAIL", "LIST_ITEM", "MAIN_CONTENT_UNIT"]
    assert merged == ["DOCUMENT_TITLE", "MAIN_CONTENT_UNIT", "FOOTER_SECTION", "FOOTER_ITEM", "FOOTER_ITEM", "FOOTER_ITEM"]
