"""Headings, sections, concepts, stale references on hand-made notes."""

from __future__ import annotations

import pytest

from loomgraph.operators import build, code, docs, query

NODES = "id string, label string, file_type string, source_file string, community int, ord string"


def table(spark, names, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"{n} string" for n in names.split()))


@pytest.mark.parametrize(
    "text, expected",
    [
        ("**Kelp forests**\n\ntides\n\n**Ōtaki**\n\n**iv**\n", ["Kelp forests", "Ōtaki", "iv"]),
        ("**before**\n## Harbour\n**after**\n", ["Harbour"]),
        ("**ends.**\n**asks?**\n**lists:**\n**shouts!**\n**Bare words**\n", ["Bare words"]),
        ("a line with **bold** inside\n  **On its own**  \n", ["On its own"]),
        (f"**{'k' * 81}**\n**{'k' * 80}**\n", ["k" * 80]),
        ("```sh\n# comment\n```\n### Shown\n", ["Shown"]),
        ("# One\r\n```\r\n# hidden\r\n```\r\n# Two\r\n", ["One", "Two"]),
        ("# Open fence\n```\n# never closed\n", ["Open fence"]),
        ("##### too deep\n#no blank\n", []),
        ("", []),
    ],
)
def test_headings(spark, text, expected):
    found = docs.headings(table(spark, "source_file text", ("tide.md", text))).orderBy("line_no")
    assert [r.heading for r in found.collect()] == expected


def test_line_numbers_count_fenced_lines(spark):
    text = "# Pier\n```\nx\ny\n```\n\n## Dock\n```\n```\n## Quay\n"
    rows = docs.headings(table(spark, "source_file text", ("p.md", text))).collect()
    assert sorted((r.line_no, r.heading) for r in rows) == [(1, "Pier"), (7, "Dock"), (10, "Quay")]


def test_sections_hang_below_the_last_level_one(spark):
    df = table(spark, "source_file text file_type", ("sea/log.md", "## Loose\n# North\n## Reef\n### Sand\n# North\n## Bay\n", "document"))
    rows = {r.label: r for r in docs.sections(df).collect()}
    hub = docs.hubs(df).first().id
    assert {k: r.parent_id for k, r in rows.items()} == {"Loose": hub, "North": hub, "Reef": rows["North"].id, "Bay": rows["North"].id}


def test_links_are_resolved(spark):
    text = "[map](../maps/./coast.md#west) ![buoy](buoy.svg) [site](http://sea.test) [here](#here) [post](mailto:x@y) [map again](../maps/coast.md) [root](/log.md) [far](../../out.md)"
    rows = docs.links(table(spark, "source_file text", ("logs/day.md", text))).orderBy("nth").collect()
    assert [r.target for r in rows] == ["maps/coast.md", "logs/buoy.svg", "log.md", "../out.md"]


def test_definitions(spark):
    text = "- **Neap tide**: weak\n* **x = y**: noise\n- **Neap tide**: twice\n```\n- **Hidden**: no\n```\n- **2024**: number\n  - **Spring tide** strong\n"
    rows = docs.definitions(table(spark, "source_file text", ("t.md", text))).orderBy("nth").collect()
    assert [r.label for r in rows] == ["Neap tide", "Spring tide"]


def test_same_concept_across_documents(spark):
    df = table(spark, "source_file text file_type", ("a.md", "# Sông Hồng\n", "document"), ("b.md", "# sông hồng\n", "document"), ("c.md", "# Overview\n", "document"), ("d.md", "# Overview\n", "document"))
    nodes, _ = docs.extract(df)
    assert docs.same_concepts(build.upsert_nodes(nodes)).count() == 1


STALE = [
    (["Anchor"], "The [[Anchor]] held, the [[Rope]] did not.", [("Rope", 1)]),
    (["Anchor"], "Only [[Anchor]].", []),
    ([], "one\n\n[[Rope]]\n", [("Rope", 3)]),
    (["Anchor"], "[[Anchor]]\n```\n[[Quoted]]\n```\n\n[[Rope]]", [("Rope", 6)]),
    (["Anchor"], "[[Mast]], [[Anchor]], [[Sail]]", [("Mast", 1), ("Sail", 1)]),
    (["Anchor"], "[[Anchor#weight]] and [[Rope#length]]", [("Rope", 1)]),
]


@pytest.mark.parametrize("labels, text, expected", STALE)
def test_stale_references(spark, labels, text, expected):
    nodes = spark.createDataFrame([(f"n{i}", x, "code", "a.py", 0, f"{i}") for i, x in enumerate(labels)], NODES)
    assert sorted((r.label, r.line_no) for r in query.stale_refs(nodes, table(spark, "source_file text", ("v.md", text))).collect()) == expected


def orphan_graph(spark, images=False):
    rows = [("k1", "Keel", "code", 0), ("k2", "Hull", "code", 0), ("k3", "Oar", "code", 1), ("k4", "Chart", "document", 2)] + [("k5", "gull.png", "image", 3)] * images
    nodes = spark.createDataFrame([(i, x, t, "boat.py", c, i) for i, x, t, c in rows], NODES)
    edges = spark.createDataFrame([("k1", "k2", "calls", "EXTRACTED", "1")], "source string, target string, relation string, confidence string, ord string")
    return build.Graph.build(nodes, edges)


def test_orphans(spark):
    assert sorted(r.label for r in query.orphans(orphan_graph(spark)).collect()) == ["Chart", "Oar"]
    assert sorted(r.label for r in query.orphans(orphan_graph(spark, True)).collect()) == ["Chart", "Oar"]
    assert query.orphans(orphan_graph(spark, True), include_hubs=True).count() == 3


BRANCHES = """
try:
    import fast
except ImportError:
    import slow
    def helper(): pass
else:
    class Late: pass
finally:
    def last(): pass
if fast:
    pass
elif slow:
    def second(): pass
else:
    for x in y:
        pass
    else:
        def third(): pass
match fast:
    case 1:
        def fourth(): pass
"""


def test_python_code_in_every_branch_is_read():
    rows = code.parse_python("sea/boat.py", BRANCHES)
    labels = {r["label"] for r in rows if r["kind"] == "node"}
    assert labels == {"boat.py", "helper()", "Late", "last()", "second()", "third()", "fourth()"}
    assert {r["target"] for r in rows if r.get("relation") == "imports"} == {"fast", "slow"}


TWICE = """
@memo(start())
def outer(x=default()):
    @wrap(before())
    def inner(y):
        return hidden(y)
    class Local:
        def method(self):
            return hidden(self)
    return [shown(lambda z: also(z)) for _ in x]
def outer(x):
    return late(x)
class Box:
    @property
    def size(self): return 1
    @size.setter
    def size(self, to): reset(to)
"""


def test_calls_stay_in_their_function_and_names_count_once():
    rows = code.parse_python("sea/boat.py", TWICE)
    assert {(r["source"], r["name"]) for r in rows if r["kind"] == "call"} == {("boat_outer", x) for x in ("wrap", "before", "shown", "also", "late")} | {("boat_box_size", "reset")}
    nodes = [(r["id"], r["line"], r.get("signature")) for r in rows if r["kind"] == "node"]
    assert nodes == [("boat", 1, None), ("boat_outer", 3, "def outer(x=default())"), ("boat_box", 13, None), ("boat_box_size", 15, "def size(self)")]


def test_bases_of_the_same_file(spark):
    text = "class Kid extends Hull {\n}\nclass Hull {\n}\nclass Raft extends Float {\n}\n"
    nodes, edges = code.declared_records(table(spark, "source_file text", ("T.java", text)))
    assert {(r.source, r.target) for r in edges.where("relation = 'extends'").collect()} == {("t_kid", "t_hull"), ("t_raft", "float")}
    assert [r.id for r in nodes.where("source_file = ''").collect()] == ["float"]
