"""From a question through a document's tree to the lines that answer it.

A model is shown the upper nodes of a tree, chooses some, is shown what stands
under those, and so on: however large the tree, a prompt holds one frontier.  The
levels of a question are walked in the task that holds it, on the document's
titles alone; texts join at the end, for the chosen nodes only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.replies import first_object
from .lines import ordered_text
from .tree import OPEN_ENDED_LINES, OUTLINE_CHARS, TITLE_CHARS, line_bounds

#: Levels that are walked at most.
LEVELS = 12


def _shown(nodes: list[dict], limit: int) -> list[str]:
    """Prompts for a frontier, a node a line: with summaries, without, or in several parts if neither fits ``limit``."""
    cut = lambda x: x if len(x) <= TITLE_CHARS else f"{x[:TITLE_CHARS]}..."
    plain = [f"- [{n['node_id']}] {cut(n['title'] or '')}" for n in nodes]
    told = [" ".join((n["summary"] or "").split()) for n in nodes]
    full = "\n".join(f"{p}: {cut(s)}" if s else p for p, s in zip(plain, told))
    if len(full) <= limit:
        return [full]
    parts, size = [[]], 0
    for line in plain:
        if parts[-1] and size + len(line) + 1 > limit:
            parts.append([])
            size = 0
        parts[-1].append(line)
        size += len(line) + 1
    return ["\n".join(p) for p in parts]


def descend(question: str, nodes: list[dict], ask: Callable[[str], str], limit: int = OUTLINE_CHARS, instructions: str = "") -> list[str]:
    """Ids of the nodes that a model leads to, in the order chosen.

    Of each frontier it names ids in ``{"node_list": [...]}``; ids that were not shown,
    and repeated ones, are dropped.  Chosen nodes give way to those chosen among their
    children, and stay where none is chosen or there are none."""
    known = {n["node_id"] for n in nodes}
    under: dict[str | None, list[dict]] = {}
    for n in nodes:
        under.setdefault(n["parent_id"] if n["parent_id"] in known else None, []).append(n)

    def chosen(frontier: list[dict]) -> list[str]:
        out: dict[str, None] = {}
        for part in _shown(frontier, limit):
            reply = first_object(ask(f"{instructions}\nQuestion: {question}\n\nNodes:\n{part}\n\nReply with JSON " + '{"node_list": [ids of the nodes most likely to hold the answer]}.'))
            told = json.loads(reply).get("node_list") if reply else None
            offered = {n["node_id"] for n in frontier}
            out |= dict.fromkeys(str(i) for i in (told if isinstance(told, list) else []) if str(i) in offered)
        return list(out)

    at = chosen(under.get(None, []))
    opened: set[str] = set()
    for _ in range(LEVELS):
        closed = [i for i in at if i in under and i not in opened]
        if not closed:
            break
        opened.update(closed)
        picked = chosen([n for i in closed for n in under[i]])
        parent = {n["node_id"]: i for i in closed for n in under[i]}
        below: dict[str, list[str]] = {}
        for p in picked:
            below.setdefault(parent[p], []).append(p)
        at = [x for i in at for x in below.get(i, [i])]
    return at


def chosen_nodes(questions: DataFrame, nodes: DataFrame, model: Callable[[], Callable[[str], str]], limit: int = OUTLINE_CHARS, instructions: str = "") -> DataFrame:
    """(question_id, doc_id, pick, node_id): the nodes that answer each of ``questions``
    (question_id, doc_id, question), pick from 1, by descend() through the document's
    ``nodes`` (doc_id, ord, node_id, parent_ord, title, summary).

    A model that fails, or a question that is null or blank, or about a document
    without nodes, gives no rows.  Repeated questions count each."""
    # parents are looked up among the document's own nodes where these are walked
    trees = nodes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "node_id", "parent_ord", "title", "summary"))).alias("_nodes"))
    asked = questions.where(t.strip("question") != "").join(trees, "doc_id")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        ask = model()

        def safe(question: str, tree: list) -> list[str]:
            try:
                known = [n if isinstance(n, dict) else n.asDict() for n in tree]
                ids = {n["ord"]: n["node_id"] for n in known}
                return descend(question, [n | {"parent_id": ids.get(n["parent_ord"])} for n in known], ask, limit, instructions)
            except Exception:
                return []

        for frame in frames:
            yield pd.Series([safe(q, n) for q, n in zip(frame["question"], frame["nodes"])], index=frame.index, dtype=object)

    picks = F.pandas_udf(walk, "array<string>")  # type: ignore[call-overload]
    told = asked.withColumn("_picks", picks(F.struct("question", F.col("_nodes").alias("nodes"))))
    return told.select("question_id", "doc_id", F.posexplode("_picks").alias("pick", "node_id")).withColumn("pick", F.col("pick") + 1)


def contexts(picks: DataFrame, nodes: DataFrame, lines: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, doc_id, context): the lines of each question's picks (question_id, doc_id,
    pick, node_id), in their order, each under its source and lines.

    A node has its lines up to the next heading, the last one of a document twenty.
    ``nodes`` (doc_id, node_id, line_num, ...), ``lines`` (doc_id, line_num, line) and
    ``names`` (doc_id, filename) are of all documents; picks without lines give nothing."""
    bounds = line_bounds(nodes).select("doc_id", "node_id", "start_line", "end_line")
    upto = F.coalesce("end_line", F.col("start_line") + OPEN_ENDED_LINES - 1)
    rows = picks.join(bounds, ["doc_id", "node_id"]).join(names, "doc_id")
    wide = rows.withColumn("line_num", F.explode(F.sequence("start_line", F.greatest(upto, F.col("start_line"))))).join(lines, ["doc_id", "line_num"])
    texts = wide.groupBy("question_id", "doc_id", "pick", "filename", "start_line", "end_line").agg(t.strip(ordered_text(F.col("line"), F.col("line_num"))).alias("body"))
    tag = F.format_string("[Nguồn: %s, Dòng: %s-%s]\n", "filename", F.col("start_line").cast("string"), F.coalesce(F.col("end_line").cast("string"), F.lit("...")))
    return texts.groupBy("question_id", "doc_id").agg(ordered_text(F.concat(tag, "body"), F.col("pick"), "\n\n---\n\n").alias("context"))


def navigate(questions: DataFrame, nodes: DataFrame, lines: DataFrame, names: DataFrame, model: Callable[[], Callable[[str], str]], limit: int = OUTLINE_CHARS) -> DataFrame:
    """(question_id, doc_id, context) from questions to the text that answers them; see
    chosen_nodes() and contexts().  Questions that lead nowhere have no row."""
    return contexts(chosen_nodes(questions, nodes, model, limit), nodes, lines, names)

