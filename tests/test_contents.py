"""Contents whose replies break off, against what the source says."""

from __future__ import annotations

import json
import re
import sys

from pyspark import cloudpickle

from papyra.operators import contents

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


def lines_of(text):
    return [m.groups() for m in re.finditer(r"^(\S+) (.+?): (\S+)$", text, re.M)]


def json_model(per_reply, finish=True, fence=True):
    """Gives ``per_reply`` entries a reply and breaks off in the middle of the next."""

    def make():
        def ask(prompt, before):
            head, _, so_far = prompt.partition("JSON so far:\n")
            entries = [json.dumps({"structure": s, "title": x, "page": p}) for s, x, p in lines_of(head)]
            done = so_far.count("}")
            part = entries[done : done + per_reply]
            rest = entries[done + per_reply :]
            text = ("" if so_far else '{"table_of_contents": [') + ", ".join(part)
            text += f", {rest[0][:12]}" if rest else "]}"
            if so_far and not fence:
                return text, not rest
            return (f"```json\n{text}\n```" if so_far else text), finish and not rest

        return ask

    return make


def whole(source, reply):
    return reply.count("}") > len(lines_of(source))


JUDGE = lambda: whole


def sources(n):
    return "\n".join(f"1.{i} Title {{{i}}}: {i * 3}".replace("{", "").replace("}", "") for i in range(1, n + 1))


def test_entries_are_stitched_over_turns(spark):
    docs = spark.createDataFrame([(1, sources(2)), (2, sources(7)), (3, sources(30)), (4, None), (5, " ")], "doc_id long, contents string")
    got = {r.doc_id: r for r in contents.transformed_contents(docs, json_model(3), JUDGE).collect()}
    for d, n, turns, complete in ((1, 2, 1, True), (2, 7, 3, True), (3, 18, 6, False)):
        r = got[d]
        assert [(e.structure, e.title, e.page) for e in r.entries] == [(f"1.{i}", f"Title {i}", i * 3) for i in range(1, n + 1)]
        assert (r.turns, r.complete, r.contents_error) == (turns, complete, None)
    assert all(got[d].entries == [] and got[d].turns == 0 and got[d].complete for d in (4, 5))
    items = contents.contents_items(contents.transformed_contents(docs.where("doc_id = 2"), json_model(3), JUDGE))
    assert [tuple(r) for r in items.orderBy("ord").collect()][:2] == [(2, 1, "1.1", "Title 1", 3), (2, 2, "1.2", "Title 2", 6)]


def test_rests_that_are_no_json_and_errors(spark):
    docs = spark.createDataFrame([(1, sources(5))], "doc_id long, contents string")
    r = contents.transformed_contents(docs, json_model(3, fence=False), JUDGE).first()
    assert len(r.entries) == 3 and r.turns == 6 and not r.complete

    def failing():
        def ask(prompt, before):
            if "JSON so far" in prompt:
                raise TimeoutError("gone")
            return '{"table_of_contents": [{"structure": "1", "title": "A", "page": "x"}, {"str', False

        return ask

    r = contents.transformed_contents(docs, failing, JUDGE).first()
    assert [tuple(e) for e in r.entries] == [("1", "A", None)] and (r.turns, r.complete, r.contents_error) == (1, False, "TimeoutError: gone")


def test_plain_contents_go_on_with_their_history(spark):
    def make():
        def ask(prompt, before):
            text = (before[0]["content"] if before else prompt).split("\n\n", 1)[1]
            said = before[1]["content"] if before else ""
            assert not before or (before[0]["role"], before[1]["role"]) == ("user", "assistant")
            part = text[len(said) : len(said) + 10]
            return part, len(said) + len(part) == len(text)

        return ask

    rows = [(1, "short"), (2, "x" * 35), (3, "y" * 200), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in contents.extracted_contents(docs, make, lambda: lambda source, reply: source == reply).collect()}
    assert [(got[d].contents, got[d].turns, got[d].complete) for d in (1, 2, 3, 4)] == [("short", 1, True), ("x" * 35, 4, True), ("y" * 70, 7, False), ("", 0, True)]


def test_helpers():
    assert contents.upto_last_entry('[{"a": 1}, {"b"') == '[{"a": 1},' and contents.upto_last_entry("[") == "["
    assert contents.fenced('talk <think>x</think> ```json\n{"a": "`"}\n``` more') == '{"a": "`"}' and contents.fenced(" [1] ") == "[1]" and contents.fenced("```json\n[1, ") == "[1,"


def test_pages_numbers_and_places(spark, rows):
    pages = spark.createDataFrame([(1, 2, "B.......... 9\n"), (1, 1, "A . . . . . . 4\n"), (2, 1, None)], "doc_id long, page int, text string")
    assert rows(contents.raw_contents(pages)) == [(1, "A : 4\nB:  9\n"), (2, "")]
    docs = spark.createDataFrame([(1, "A: 4"), (2, "A"), (3, None)], "doc_id long, contents string")
    said = contents.has_page_numbers(docs, lambda: lambda p, schema: '{"numbered": "YES"}' if re.search(r": \d", p) else "no idea")
    assert [(r[0], r[2]) for r in rows(said)] == [(1, True), (2, False), (3, False)]
    items = spark.createDataFrame([(1, 1, "1", "A"), (1, 2, "2", "B"), (1, 3, "3", "C")], "doc_id long, ord int, structure string, title string")

    def place():
        return lambda p, schema: json.dumps({"entries": [{"title": "A", "physical_index": "<physical_index_2>"}, {"title": "B", "physical_index": "<physical_index_99>"}, {"title": "Z", "physical_index": "<physical_index_1>"}]})

    assert [(r.ord, r.physical_index) for r in contents.located_items(items, pages, place).orderBy("ord").collect()] == [(1, 2), (2, None), (3, None)]
    assert contents.located_items(items.where("false"), pages, place).count() == 0
