"""A folder from its files to its graph and exports."""

from __future__ import annotations

import json
import re

from loomgraph.operators import export
from loomgraph.plans import folder


def test_build_and_save(spark, tmp_path):
    root = tmp_path / "in"
    for path, body in {
        "src/store.py": '"""Keeps graphs in memory for all queries."""\n\n\nclass GraphStore:\n    def add(self, x):\n        return index_by(x)\n\n\ndef index_by(x):\n    return x\n',
        "src/user.py": "from store import GraphStore\n\n\nclass Reader(GraphStore):\n    pass\n",
        "java/Thing.java": "import java.util.List;\n\n/** A thing that is described. */\npublic class Thing {\n}\n",
        "docs/arch.md": "# Architecture\n\nThe GraphStore and index_by.\n\n## Storage\n\n[more](more.md)\n\n- **Cache Rule**: yes\n",
        "docs/more.md": "# Architecture\n\nmore\n", "img/d.png": "png", "build/x.py": "y = 1",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    graph = folder.build(spark, str(root))
    nodes = {r.id: r for r in graph.nodes.collect()}
    labels = {r.label for r in nodes.values()}
    assert {"store.py", "GraphStore", ".add()", "index_by()", "Reader", "Thing", "arch", "Architecture", "Storage", "Cache Rule", "more", "d"} <= labels
    assert all(r.community is not None for r in nodes.values())
    edges = {(nodes[r.src].label if r.src else nodes[r.a].label, r.relation) for r in graph.edges.collect()}
    assert {("store.py", "contains"), ("GraphStore", "method"), (".add()", "calls"), ("arch", "references"), ("arch", "defines"), ("Architecture", "same_concept")} <= edges
    assert any(r.relation == "mentions" for r in graph.edges.collect())
    assert [r.description for r in nodes.values() if r.label == "Thing"] == ["A thing that is described."]
    folder.save(graph, str(tmp_path / "out"))
    vault, wiki = tmp_path / "out/vault", tmp_path / "out/wiki"
    notes = {p.stem for p in vault.rglob("*.md")}
    assert len(notes) == graph.nodes.count() + 1 + len(list((vault / "communities").glob("_COMMUNITY_*.md")))
    linked = {m for p in vault.rglob("*.md") for m in re.findall(r"\[\[(.+?)\]\]", p.read_text())}
    assert linked and linked <= notes
    assert "# Vault Index" in (vault / "index.md").read_text()
    assert json.loads((vault / ".vault/graph.json").read_text())["colorGroups"][0]["color"]["a"] == 1
    index = (wiki / "index.md").read_text()
    assert index.startswith("# Knowledge Graph Index\n") and "## God Nodes" in index and index.endswith("*Auto-generated knowledge wiki*")
    assert (wiki / "GraphStore.md").read_text().startswith("# GraphStore\n")
    again = export.read_json(spark, str(tmp_path / "out/graph"))
    for part in ("nodes", "edges"):
        before, after = getattr(graph, part), getattr(again, part)
        kept = [c for c in before.columns if c != "confidence_score"]
        assert set(kept) <= set(after.columns)
        assert sorted(map(str, before.select(kept).collect())) == sorted(map(str, after.select(kept).collect()))
    report = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out/report")).collect())
    for part in ("# Knowledge Wiki Report", "## Summary", "## God Nodes", "## Surprising Connections", "## Communities", "## Knowledge Gaps", "## Suggested Questions"):
        assert part in report


def test_a_watched_folder_is_built_again(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.py").write_text("def first():\n    pass\n")

    def labels():
        folder.keep_built(spark, str(root), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
        built = sorted((tmp_path / "out").iterdir(), key=lambda p: int(p.name.split("-")[0]))
        lines = spark.read.text(str(built[-1] / "graph")).where("kind = 'node'").collect()
        return len(built), {json.loads(r.value)["label"] for r in lines}

    assert labels() == (1, {"a.py", "first()"})
    (root / "a.py").write_text("def second():\n    pass\n")
    assert labels() == (2, {"a.py", "second()"})
    assert labels()[0] == 2
