"""From questions through trees to lines."""

from __future__ import annotations

import json
import re
import sys

from pyspark import cloudpickle

from papyra.operators import navigate

cloudpickle.register_pickle_by_value(sys.modules[__name__])
NODES = "doc_id long, ord int, node_id string, parent_ord int, title string, summary string, line_num int"


def node(i, parent, title, summary=None):
    return {"node_id": f"{i:04d}", "parent_id": None if parent is None else f"{parent:04d}", "title": title, "summary": summary}


TREE = [node(0, None, "cats and dogs"), node(1, 0, "cats"), node(2, 0, "dogs"), node(3, 1, "big cats"), node(4, 1, "small"), node(5, None, "birds", "and cats"), node(6, 5, "owls")]


def by_word(prompt):
    """Chooses what names the question's last word, and an id that is not there."""
    word = re.search("Question: .*?([a-z]+)\n", prompt)[1]
    lines = re.findall(r"- \[([0-9]+)\] (.*)", prompt)
    return "sure: " + json.dumps({"node_list": [i for i, title in lines if word in title] + ["9999", "0001"]})


def test_descent_stops_where_nothing_is_chosen():
    assert navigate.descend("about cats", TREE, by_word) == ["0003", "0005"]
    assert navigate.descend("about dogs", TREE, by_word) == ["0002", "0001"]
    assert navigate.descend("about fish", TREE, by_word) == [] and navigate.descend("x", [], by_word) == []
    assert navigate.descend("x", TREE, lambda p: "no json") == [] and navigate.descend("x", TREE, lambda p: '{"node_list": "0000"}') == []


def test_large_frontiers_come_in_parts():
    seen = []

    def ask(prompt):
        seen.append(prompt)
        return by_word(prompt)

    wide = [node(i, None, f"title {'cats' if i % 50 == 0 else 'none'} {i}") for i in range(1, 201)]
    assert navigate.descend("about cats", wide, ask, limit=1000) == ["0001", "0050", "0100", "0150", "0200"]
    assert len(seen) > 3 and all(len(p) < 1400 for p in seen)


def test_rings_and_lost_parents_end():
    ring = [node(1, 2, "cats a"), node(2, 1, "cats b"), node(3, 99, "cats c")]
    assert navigate.descend("about cats", ring, by_word) == ["0003"]


def test_navigation_to_lines(spark, rows):
    nodes = [(1, i, n["node_id"], None if n["parent_id"] is None else int(n["parent_id"]), n["title"], n["summary"], 10 * i + 1) for i, n in enumerate(TREE)]
    frame = spark.createDataFrame(nodes, NODES)
    lines = spark.createDataFrame([(1, k, f"line {k}") for k in range(1, 71)], "doc_id long, line_num int, line string")
    names = spark.createDataFrame([(1, "pets.md")], "doc_id long, filename string")
    questions = spark.createDataFrame([(7, 1, "about cats"), (8, 1, "about owls"), (9, 1, " "), (10, 1, None), (11, 2, "about cats")], "question_id long, doc_id long, question string")
    picks = navigate.chosen_nodes(questions, frame, lambda: by_word)
    assert rows(picks) == [(7, 1, 1, "0003"), (7, 1, 2, "0005")]
    got = rows(navigate.navigate(questions, frame, lines, names, lambda: by_word))
    body = lambda a, b: "\n".join(f"line {k}" for k in range(a, b))
    assert got == [(7, 1, f"[Nguồn: pets.md, Dòng: 31-40]\n{body(31, 41)}\n\n---\n\n[Nguồn: pets.md, Dòng: 51-60]\n{body(51, 61)}")]
    last = spark.createDataFrame([(1, 1, 1, "0006")], "question_id long, doc_id long, pick int, node_id string")
    assert rows(navigate.contexts(last, frame, lines, names))[0][2].startswith("[Nguồn: pets.md, Dòng: 61-...]\nline 61")

    def failing():
        def ask(prompt):
            raise TimeoutError

        return ask

    assert rows(navigate.chosen_nodes(questions, frame, failing)) == []
