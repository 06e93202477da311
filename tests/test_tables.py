"""Orders with a tolerance, parts without doubles, grids: against plain restatements and planted tables."""

from __future__ import annotations

import itertools
import random

from papyra.operators import geometry, tables

BOX = "page int, box_id int, x0 double, x1 double, top double, bottom double, text string, layout_type string"
PART = "page int, part_id int, label string, score double, x0 double, x1 double, top double, bottom double"


def random_boxes(seed, pages=3, n=70):
    rng = random.Random(seed)
    return [(p, i, float(x := rng.randrange(0, 300)), float(x + rng.randrange(0, 90)), float(y := rng.randrange(0, 200)), float(y + rng.randrange(0, 40)), f"t{i}", "table") for p in range(pages) for i in range(n)]


def test_scan_order_is_an_insertion(spark):
    rows = random_boxes(1) + [(9, 1, 5.0, 9.0, 20.0, 21.0, "a", ""), (9, 2, 1.0, 2.0, 29.0, 30.0, "b", ""), (9, 3, 0.0, 2.0, 38.0, 39.0, "c", "")]
    want = {}
    for page, group in itertools.groupby(rows, key=lambda r: r[0]):
        done = []
        for b in sorted(group, key=lambda r: (r[4], r[2], r[1])):
            at = len(done)
            while at and abs(b[4] - done[at - 1][4]) < 10 and b[2] < done[at - 1][2]:
                at -= 1
            done.insert(at, b)
        want |= {(page, b[1]): i for i, b in enumerate(done, 1)}
    got = tables.scan_order(spark.createDataFrame(rows, BOX).repartition(4)).collect()
    assert {(r.page, r.box_id): r.position for r in got} == want and want[9, 3] == 3
    assert tables.scan_order(spark.createDataFrame([], BOX)).count() == 0
    odd = spark.createDataFrame([(1, 1, None, 1.0, None, 1.0, "x", ""), (1, 2, 0.0, 1.0, 0.0, 1.0, "y", "")], BOX)
    assert sorted((r.box_id, r.position) for r in tables.scan_order(odd).collect()) == [(1, 1), (2, 2)]


def test_tolerant_order_with_planted_ties(spark):
    # near in a chain: each is within the tolerance of the next, the ends are not
    rows = [(1, i, float(100 - 10 * i), 0.0, 4.0 * i, 0.0, "", "") for i in range(6)] + [(2, i, float(i % 3), 0.0, float(i // 3), 0.0, "", "") for i in range(9)]
    got = {(r.page, r.box_id): r.position for r in tables.tolerant_order(spark.createDataFrame(rows, BOX).repartition(3), 5.0).collect()}

    def inserted(items):
        """Binary insertion, as short lists are sorted, after the run that is in order already."""
        before = lambda a, b: (a[2] < b[2]) if abs(a[4] - b[4]) < 5 else a[4] < b[4]
        down, n = before(items[1], items[0]), 2
        while n < len(items) and before(items[n], items[n - 1]) == down:
            n += 1
        done = items[:n][::-1] if down else items[:n]
        for x in items[n:]:
            low, high = 0, len(done)
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if before(x, done[mid]) else (mid + 1, high)
            done.insert(low, x)
        return done

    for page in (1, 2):
        order = inserted([r for r in rows if r[0] == page])
        assert [got[page, r[1]] for r in order] == list(range(1, len(order) + 1))


def test_settle_moves_past_larger_numbers_only():
    items = [{"id": i, "n": n, "x": x} for i, (n, x) in enumerate([(2, 1), (None, 0), (1, 5), (1, 3), (0, 9)])]
    # the item without a number is a wall
    assert [r["id"] for r in tables.settle(items, "n", "x")] == [0, 1, 4, 3, 2]
    whole = [{"n": n, "x": x} for n, x in ((3, 0), (1, 2), (1, 1), (2, 0))]
    assert [(r["n"], r["x"]) for r in tables.settle(whole, "n", "x")] == [(1, 1), (1, 2), (2, 0), (3, 0)]


def test_order_by_number(spark):
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 1), (1, 2, 50.0, 1.0, 0), (1, 3, 9.0, 2.0, None), (1, 4, None, 0.0, 0)], "page int, box_id int, x0 double, top double, row int")
    got = tables.tolerant_order(boxes, 5.0, number="row").orderBy("position").collect()
    assert [r.box_id for r in got] == [1, 3, 2, 4]


def layout(i, x0, x1, top, bottom, score, kind="text", page=1):
    return (page, i, kind, score, float(x0), float(x1), float(top), float(bottom))


LAYOUT = "page int, box_id int, type string, score double, x0 double, x1 double, top double, bottom double"


def test_doubles_go_within_the_look_ahead(spark, rows):
    parts = [
        layout(1, 0, 10, 0, 10, 0.9), layout(2, 1, 10, 0, 10, 0.5), layout(3, 0, 10, 0, 9, 0.95),  # 2 goes, then 1
        layout(4, 100, 110, 0, 10, 0.4), layout(5, 200, 210, 0, 10, 0.4), layout(6, 100, 110, 0, 10, 0.3),  # too far apart
        layout(7, 300, 310, 0, 10, None), layout(8, 300, 320, 0, 10, None),  # no scores: the boxes decide
        layout(9, 400, 410, 0, 10, 0.1, "a"), layout(10, 400, 410, 0, 10, 0.1, "b"), (1, 11, "text", 0.1, None, 1.0, 0.0, 1.0), layout(1, 0, 10, 0, 10, 0.9, page=2),
    ]
    boxes = spark.createDataFrame([(1, 1, 311.0, 318.0, 1.0, 9.0, "", "")], BOX)
    frame = spark.createDataFrame(parts, LAYOUT)
    assert [r[:2] for r in rows(tables.clean_ahead(frame, boxes).select("page", "box_id"))] == sorted([(1, i) for i in (3, 4, 5, 6, 8, 9, 10, 11)] + [(2, 1)], key=repr)
    wider = tables.clean_ahead(frame, boxes, ahead=4).select("page", "box_id")
    assert (1, 6) not in {tuple(r) for r in wider.collect()} and wider.columns == ["page", "box_id"]
    assert tables.clean_ahead(frame.where("false"), boxes).count() == 0


def test_overlapping_pairs_once(spark):
    a, b = random_boxes(3, 2, 60), random_boxes(4, 2, 60)
    b += [(0, 900, -700.0, 900.0, -50.0, 800.0, "wide", "")]
    want = {(p, i, j) for p, i, x0, x1, top, bottom, *_ in a for q, j, u0, u1, t, u, *_ in b if p == q and min(x1, u1) > max(x0, u0) and min(bottom, u) > max(top, t)}
    for size in (7.0, 64.0):
        got = geometry.overlapping(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), size).select("page", "box_id", "b_box_id").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    odd = spark.createDataFrame([(0, 1, None, 1.0, 0.0, 1.0, "", ""), (0, 2, 3.0, 1.0, 0.0, 1.0, "", "")], BOX)
    assert geometry.overlapping(odd, spark.createDataFrame(b, BOX)).count() == 0


def planted(rows, columns, page=1, skip=(), extra=()):
    """Boxes and parts of a table of ``rows`` x ``columns`` cells, 100 wide and 20 high."""
    boxes, parts, n = [], [], 0
    for i in range(rows):
        parts.append((page, n := n + 1, "table column header" if i == 0 else "table row", 0.9, 0.0, 100.0 * columns, 20.0 * i, 20.0 * i + 18))
        for j in range(columns):
            if (i, j) not in skip:
                boxes.append((page, 100 * i + j, 100.0 * j + 5 + i % 3, 100.0 * j + 70, 20.0 * i + 2 + j % 2, 20.0 * i + 15, f"r{i}c{j}", "table"))
    for j in range(columns):
        parts.append((page, n := n + 1, "table column", 0.9, 100.0 * j, 100.0 * j + 90, 0.0, 20.0 * rows))
    return boxes, parts + list(extra)


def built(spark, boxes, parts):
    b, p = spark.createDataFrame(boxes, BOX).repartition(3), spark.createDataFrame(parts, PART)
    grid = tables.built_tables(tables.placed_cells(b, tables.table_parts(p, b))).collect()
    return {(r.row_no, r.col_no): r for r in grid}


def test_grid_of_a_plain_table(spark):
    double = (1, 90, "table row", 0.2, 0.0, 300.0, 41.0, 58.0)
    boxes, parts = planted(4, 3, extra=[double, (1, 91, None, 0.5, 0.0, 1.0, 0.0, 1.0), (1, 92, "table row", 0.5, None, 1.0, 0.0, 1.0)])
    grid = built(spark, boxes + [(1, 999, None, 1.0, 0.0, 1.0, "no side", "")], parts)
    assert {k: r.text for k, r in grid.items()} == {(i, j): f"r{i}c{j}" for i in range(4) for j in range(3)}
    assert all((r.row_span, r.col_span) == (1, 1) for r in grid.values())


def test_two_texts_of_a_cell_and_no_parts(spark):
    boxes, parts = planted(3, 2)
    boxes.append((1, 555, 40.0, 60.0, 2.0, 15.0, "more", "table"))
    assert built(spark, boxes, parts)[0, 0].text == "r0c0 more"
    bare = built(spark, boxes[:-1], [(7, 1, "table row", 1.0, 0.0, 1.0, 0.0, 1.0)])
    assert {k: r.text for k, r in bare.items()} == {(i, j): f"r{i}c{j}" for i in range(3) for j in range(2)}


def test_spans_stand_in_all_their_places(spark):
    span = (1, 80, "table spanning cell", 0.9, 0.0, 195.0, 0.0, 18.0)
    boxes, parts = planted(4, 3, skip={(0, 1)}, extra=[span])
    grid = built(spark, boxes, parts)
    assert grid[0, 0].text == grid[0, 1].text == "r0c0" and grid[0, 2].text == "r0c2"
    assert (grid[0, 0].row_span, grid[0, 0].col_span) == (1, 2) and (grid[0, 1].row_span, grid[0, 1].col_span) == (1, 1)
    tall = (1, 81, "table spanning cell", 0.9, 0.0, 95.0, 20.0, 58.0)
    boxes, parts = planted(4, 3, skip={(2, 0)}, extra=[tall])
    grid = built(spark, boxes, parts)
    assert grid[1, 0].text == grid[2, 0].text == "r1c0" and (grid[1, 0].row_span, grid[1, 0].col_span) == (2, 1)


def test_lone_cells_move_to_the_nearer_empty_side(spark):
    # column 1 holds one cell with empty places on either side
    skip = {(i, 1) for i in (0, 1, 3)} | {(2, 0), (2, 2)}
    boxes, parts = planted(4, 4, skip=skip)
    grid = built(spark, boxes, parts)
    assert max(j for _, j in grid) == 2 and grid[2, 0].text == "" and grid[2, 1].text == "r2c1" and grid[2, 2].text == "r2c3"
    boxes = [(*b[:3], b[3] - 10, *b[4:]) if b[6] == "r2c1" else b for b in boxes]
    grid = built(spark, boxes, parts)
    assert max(j for _, j in grid) == 2 and grid[2, 0].text == "r2c1" and grid[2, 1].text == "" and grid[2, 2].text == "r2c3"
    # with text on either side it stays
    boxes, parts = planted(4, 4, skip={(i, 1) for i in (0, 1, 3)})
    grid = built(spark, boxes, parts)
    assert max(j for _, j in grid) == 3 and grid[2, 1].text == "r2c1"
    # a row of one cell joins the nearer row, of equals the one below
    boxes, parts = planted(4, 4, skip={(1, 2), (2, 0), (2, 1), (2, 3), (3, 2)})
    grid = built(spark, boxes, parts)
    assert max(i for i, _ in grid) == 2 and grid[1, 2].text == "" and grid[2, 2].text == "r2c2"
    boxes = [(*b[:4], b[4] - 1, *b[5:]) if b[6] == "r2c2" else b for b in boxes]
    grid = built(spark, boxes, parts)
    assert max(i for i, _ in grid) == 2 and grid[1, 2].text == "r2c2" and grid[2, 2].text == ""


def test_numbers_below_words_make_headers_and_markdown(spark):
    boxes, parts = planted(3, 2)
    boxes = [(*b[:6], b[6] if b[1] < 100 else str(b[1]), b[7]) for b in boxes] + [(1, -1, 0.0, 90.0, -30.0, -10.0, "表 1：", "table caption")]
    b, p = spark.createDataFrame(boxes, BOX), spark.createDataFrame(parts, PART)
    body = b.where(~tables.is_caption(b.text, b.layout_type))
    grid = tables.built_tables(tables.placed_cells(body, tables.table_parts(p, b)))
    assert {r.row_no for r in grid.where("is_header").collect()} == {0}
    assert tables.tables_as_markdown(b, p).collect()[0].markdown == "**表 1：**\n\n| r0c0 | r0c1 |\n| --- | --- |\n| 100 | 101 |\n| 200 | 201 |\n"
    assert tables.tables_as_markdown(b.where("false"), p).count() == 0
