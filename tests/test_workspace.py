"""A workspace over refreshes: new, changed, broken and deleted files."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from papyra.sources import workspace


def put(folder, name, content, at):
    path = folder / "documents" / f"{name}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False), encoding="utf-8")
    os.utime(path, (at, at))


def versions(folder):
    return sorted(p.name for p in (folder / "manifest").glob("version=*"))


def test_workspace_refreshes(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").orderBy("page_id").limit(12).collect() if os.path.exists("/root/testdata/sf0.001") else []
    tree = [{"title": "A", "nodes": []}]
    for i, r in enumerate(pages):
        put(tmp_path, f"p{i}", {"id": f"d{i}", "type": "pdf" if i % 2 else "md", "doc_name": r.url, "doc_description": "x", "page_count": i, "line_count": 10 * i, "structure": tree, "pages": [{"page": 1, "content": r.html}]}, 1_700_000_000 + i)
    put(tmp_path, "broken", '{"id": "b", "structure": [', 1_700_000_100)
    put(tmp_path, "list", "[1, 2]", 1_700_000_100)
    put(tmp_path, "bare", {"id": "bare"}, 1_700_000_100)
    folder = f"file://{tmp_path}"
    assert workspace.manifest(spark, folder).count() == 0
    got = {r.doc_id: r for r in workspace.refresh(spark, folder).collect()}
    assert len(got) == len(pages) + 3 and (got["broken"].error, got["list"].error, got["bare"].error) == ("not a JSON object", "not a JSON object", "no structure")
    for i, r in enumerate(pages):
        e = got[f"d{i}"]
        assert (e.type, e.doc_name, e.page_count, e.line_count, e.error) == (("pdf", r.url, i, None, None) if i % 2 else ("md", r.url, None, 10 * i, None))
    assert versions(tmp_path) == ["version=0"]
    workspace.refresh(spark, folder)
    assert versions(tmp_path) == ["version=0"]
    # one changed, one mended, one gone, one new
    put(tmp_path, "p1", {"id": "d1", "type": "md", "doc_name": "new name", "line_count": 3, "structure": tree}, 1_700_000_200)
    put(tmp_path, "broken", {"id": "b", "type": "md", "doc_name": "mended", "structure": tree}, 1_700_000_200)
    os.remove(tmp_path / "documents" / "p2.json")
    put(tmp_path, "late", {"type": "md", "doc_name": "Ünicode", "structure": tree}, 1_600_000_000)
    now = {r.doc_id: r for r in workspace.refresh(spark, folder).collect()}
    assert versions(tmp_path) == ["version=0", "version=1"]
    assert (now["d1"].doc_name, now["d1"].line_count, now["b"].doc_name, now["b"].error) == ("new name", 3, "mended", None)
    assert now["late"].doc_name == "Ünicode" and "d2" not in now and "broken" not in now and len(now) == len(got)
    found = workspace.documents(spark, folder, F.col("doc_id").isin("d3", "bare", "late")).collect()
    heavy = {r.doc_id: (json.loads(r.structure), r.pages and json.loads(r.pages)[0]["content"]) for r in found}
    assert heavy == {"d3": (tree, pages[3].html), "late": (tree, None)}
    assert workspace.documents(spark, folder, F.lit(False)).count() == 0
