"""Replies, prompts and model-backed steps with stand-in models."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from papyra.functions import replies
from papyra.operators import packing, recognition, rules, tree


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}), ('<think>{"x": 1}</think> {"a": "b, }"}', {"a": "b, }"}), ('Sure: {"a": {"b": "}"}} done', {"a": {"b": "}"}}),
        ('{"a": 1}\nINFO: served', {"a": 1}), ('{"a": 1 § , "b": 2}', {"a": 1, "b": 2}), ("no object", None), ("{broken", None), ("", None), (None, None),
    ],
)
def test_json_objects(spark, text, want):
    got = spark.createDataFrame([(text,)], "x string").select(replies.json_object("x")).first()[0]
    assert (got and json.loads(got)) == want


def test_loose_json(spark):
    frame = spark.createDataFrame([(0, '```json\n{"a": None,\n "b": [1,]}\n```'), (1, '{"a":  1}'), (2, "nothing")], "i int, x string")
    assert [json.loads(r[0]) for r in frame.orderBy("i").select(replies.loose_json("x")).collect()] == [{"a": None, "b": [1]}, {"a": 1}, {}]


def test_recognition_end_to_end(spark):
    lines = [(1, i + 1, x) for i, x in enumerate(["Điều 1. Phạm vi", "Điều 2. Đối tượng", "Điều 3. Khác", "Điều 4. Khác", "Điều 5. Khác"])]
    blocks = packing.blocks(spark.createDataFrame(lines, "doc_id int, line_id int, text string"))
    chunks = packing.chunk_signals(packing.semantic_chunks(blocks))
    prompts = recognition.recognition_prompts(chunks, "Rules").orderBy("batch").collect()
    assert [len(p.chunk_ids) for p in prompts] == [4, 1]

    def model():
        def reply(prompt):
            told = json.loads(prompt.split("\n", 1)[1])["chunks"]
            if len(told) < 4:
                raise ValueError("down")
            return "```json\n" + json.dumps({"chunks": [{"chunk_id": "c" + c["chunk_id"], "role": "header", "decision": "keep", "level": 1} for c in told]}) + "\n```"

        return reply

    checked = rules.validate_decisions(chunks, recognition.recognise(chunks, model, "Rules"))
    out = checked.orderBy("chunk_id").collect()
    assert {r.final_decision for r in out[:4]} == {"KEEP"} and all(r.final_decision == "REVIEW" for r in out[4:])
    assert out[1].final_level == 2
    nodes = rules.apply_decisions(checked).orderBy("block_id").collect()
    assert len(nodes) == 4 and {r.role for r in nodes} == {"HEADING"}


def test_descriptions_fit(spark):
    nodes = tree.with_depth(tree.with_node_ids(spark.createDataFrame([(1, o, 1 + o % 3, f"t{o}", "s") for o in range(1, 40)], "doc_id int, ord int, level int, title string, summary string")))
    whole = json.loads(recognition.descriptions(nodes).first().structure)
    assert len(whole) == 39 and all(("summary" in n) == (n["depth"] == 0) for n in whole)
    assert {n["depth"] for n in json.loads(recognition.descriptions(nodes, 1500).first().structure)} == {0, 1}
    assert recognition.descriptions(nodes, 10).first().structure.endswith("...")


def test_summaries_and_splitting(spark):
    frame = spark.createDataFrame([(1, "short", True), (2, "long " * 90, False)], "i int, text string, is_leaf boolean")
    out = recognition.node_summaries(frame, lambda: lambda p: "told", F.length("text")).orderBy("i").collect()
    assert [(r.summary, r.prefix_summary) for r in out] == [("short", None), (None, "told")]
    spans = spark.createDataFrame([(1, 0, 16), (1, 100, 104)], "doc_id int, ord int, end int")
    halves = lambda x: x.select("doc_id", F.explode(F.array(F.struct("ord", F.expr("(ord + end) div 2 end")), F.struct(F.expr("(ord + end) div 2 ord"), "end"))).alias("s")).select("doc_id", F.col("s.ord").cast("int").alias("ord"), F.col("s.end").cast("int").alias("end"))
    small = recognition.split_large(spans, lambda x: x.where("end - ord > 4"), halves)
    assert sorted((r.ord, r.end) for r in small.collect()) == [(0, 4), (4, 8), (8, 12), (12, 16), (100, 104)]
