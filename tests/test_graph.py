"""Building, paths, centrality and communities against small models."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import build, centrality, community, export, metrics, paths, upkeep
from loomgraph.plans import kg
from loomgraph.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
NODES = "id string, label string, file_type string, source_file string, community int, ord string"
EDGES = "source string, target string, relation string, confidence string, ord string"


def graph(spark, pairs, extra=()):
    ids = sorted({x for p in pairs for x in p} | set(extra))
    nodes = spark.createDataFrame([(i, i, "code", f"src/{i}.py", 0, i) for i in ids], NODES)
    edges = spark.createDataFrame([(a, b, "calls", "EXTRACTED", f"{n:04d}") for n, (a, b) in enumerate(pairs)], EDGES)
    return build.Graph.build(nodes, edges)


def test_upsert_keeps_the_last_value_of_each_attribute(spark):
    rng = random.Random(3)
    rows, model, nodes = [], {}, {}
    for n in range(400):
        a, b = rng.choice("abcdef"), rng.choice("abcdef")
        relation, confidence = rng.choice([None, "x", "y"]), rng.choice([None, "", "z"])
        rows.append((a, b, relation, confidence, f"{n:05d}"))
        e = model.setdefault(tuple(sorted((a, b))), {"ord": f"{n:05d}"})
        e |= {k: v for k, v in (("src", a), ("tgt", b), ("relation", relation), ("confidence", confidence)) if v is not None}
        nodes.setdefault(a, {}).update({k: v for k, v in (("label", relation), ("file_type", confidence)) if v is not None})
    df = spark.createDataFrame(rows, EDGES).repartition(7)
    got = {(r.a, r.b): {k: v for k, v in r.asDict().items() if k not in "ab" and v is not None} for r in build.upsert_edges(df).collect()}
    assert got == model
    records = df.selectExpr("source as id", "relation as label", "confidence as file_type", "ord")
    assert {r.id: {k: v for k, v in (("label", r.label), ("file_type", r.file_type)) if v is not None} for r in build.upsert_nodes(records).collect()} == nodes


def test_dangling_edges_are_dropped(spark):
    nodes = spark.createDataFrame([("a", "a", "code", "a.py", 0, "1")], NODES)
    edges = spark.createDataFrame([("a", "b", "calls", "EXTRACTED", "1"), ("a", "a", "calls", "EXTRACTED", "2")], EDGES)
    built = build.Graph.build(nodes, edges)
    assert [(r.a, r.b) for r in built.edges.collect()] == [("a", "a")]
    assert built.degrees.first().degree == 2


def brute_betweenness(pairs, ids):
    near = {i: set() for i in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)

    def hops(s):
        d, order = {s: 0}, [s]
        for v in order:
            for w in near[v]:
                if w not in d:
                    d[w] = d[v] + 1
                    order.append(w)
        return d

    dist = {i: hops(i) for i in ids}

    def ways(s, t):
        if s == t:
            return 1
        return sum(ways(s, v) for v in near[t] if dist[s].get(v, 99) == dist[s][t] - 1)

    out = dict.fromkeys(ids, 0.0)
    for s, t in combinations(ids, 2):
        if t in dist[s]:
            for v in ids:
                if v not in (s, t) and dist[s].get(v, 99) + dist[v].get(t, 99) == dist[s][t]:
                    out[v] += ways(s, v) * ways(v, t) / ways(s, t)
    n, of_edges = len(ids), {}
    for a, b in pairs:
        total = 0.0
        for s, t in combinations(ids, 2):
            for x, y in ((a, b), (b, a)):
                if dist[s].get(x, 99) + 1 + dist[y].get(t, 99) == dist[s].get(t):
                    total += ways(s, x) * ways(y, t) / ways(s, t)
        of_edges[a, b] = round(2 * total / (n * (n - 1)), 6)
    return {k: round(2 * v / max((n - 1) * (n - 2), 1), 6) for k, v in out.items()}, of_edges


@pytest.mark.parametrize("held", [0, 100])
@pytest.mark.parametrize("seed", [None, "trees", "twins", 1, 2])
def test_betweenness(spark, monkeypatch, seed, held):
    monkeypatch.setattr(centrality, "HELD_EDGES", held)
    monkeypatch.setattr(centrality, "SOURCE_BLOCK", 5)
    if seed is None:
        pairs = [("A", "B"), ("B", "C"), ("C", "D")]
    elif seed == "trees":
        # A ring with trees on it, a tree of its own, and a pair.
        pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("a", "e"), ("e", "f"), ("e", "g"), ("b", "h"), ("h", "i"), ("i", "j"), ("h", "k"), ("s", "t"), ("s", "u"), ("s", "v"), ("v", "w"), ("y", "z")]
    elif seed == "twins":
        # Twins of one weight and of others, twins beside twins, and twins that carry trees.
        pairs = [(x, y) for x in "abc" for y in "pqr"] + [("a", "l"), ("b", "m"), ("c", "n"), ("p", "z"), ("q", "z"), ("r", "z"), ("w", "z"), ("w", "x"), ("x", "y"), ("v", "y"), ("v", "w"), ("u", "w"), ("u", "y")]
        pairs = sorted({tuple(sorted(p)) for p in pairs})
    else:
        rng = random.Random(seed)
        pairs = sorted({tuple(sorted(rng.sample("abcdefghi", 2))) for _ in range(13)})
    g = graph(spark, pairs)
    nodes, edges = centrality.betweenness(g)
    ids = sorted({x for p in pairs for x in p})
    of_nodes, of_edges = brute_betweenness(pairs, ids)
    assert {r.id: round(r.betweenness, 6) for r in nodes.collect()} == of_nodes
    assert {(r.a, r.b): round(r.betweenness, 6) for r in edges.collect()} == of_edges
    if seed in ("trees", "twins") and held:
        told = centrality.effort(g)
        assert (told["nodes"], told["edges"]) == (len(ids), len(pairs)) and told["visits"] <= 2 * told["sources"] * told["edges_left"]
        assert (told["sources"], told["edges_left"]) == ((6, 4) if seed == "trees" else (6, 5))


def test_paths_of_the_whole_graph(spark):
    g = kg.graph(spark, SF)
    near = defaultdict(set)
    for r in g.edges.select("a", "b").collect():
        near[r.a].add(r.b)
        near[r.b].add(r.a)

    def search(start):
        best, frontier = {start: [start]}, [start]
        while frontier:
            step = {}
            for v in frontier:
                for w in near[v] - {v}:
                    if w not in best:
                        step[w] = min(step.get(w, [chr(0x10FFFF)]), best[v] + [w])
            best |= step
            frontier = list(step)
        return best

    want = search("region:0")
    assert {(r.id, r.hops, r.path) for r in QUERIES["e8_hops"](spark, SF).collect()} == {(i, len(p) - 1, " > ".join(p)) for i, p in want.items()}
    assert [r.id for r in QUERIES["f6_path"](spark, SF).orderBy("hop").collect()] == search("customer:0")["supplier:1"]
    component = {}
    for i in sorted(r.id for r in g.nodes.select("id").collect()):
        if i not in component:
            component |= dict.fromkeys(search(i), i)
    assert {r.id: r.component for r in QUERIES["e8_components"](spark, SF).collect()} == component
    every = QUERIES["e7_edge_betweenness"](spark, SF)
    assert every.count() == g.edges.where("a <> b").select("a", "b").distinct().count() == every.where("betweenness > 0").count()



def test_shortest_path_is_the_smallest(spark):
    g = graph(spark, [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y")])
    assert [r.id for r in paths.shortest_path(g, "a", "e").orderBy("hop").collect()] == ["a", "b", "d", "e"]
    assert paths.shortest_path(g, "a", "y").count() == 0
    assert {r.id: r.component for r in paths.components(g).collect()} == dict.fromkeys("abcde", "a") | dict.fromkeys("xy", "x")


def test_paths_go_on_and_components_raise(spark):
    g = graph(spark, [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(22)])
    with pytest.raises(RuntimeError):
        paths.components(g, max_rounds=1)
    assert paths.shortest_path(g, "n00", "n22").count() == 23


def test_communities(spark):
    cliques = [[f"{c}{i}" for i in range(6)] for c in "pqr"]
    pairs = [p for c in cliques for p in combinations(c, 2)] + [("p0", "q0"), ("q1", "r1")]
    g = graph(spark, pairs, extra=["alone", "lone2"])
    found = community.cluster(g)
    rows = {r.id: r.community for r in found.collect()}
    assert len(rows) == 20 and {len({rows[i] for i in c}) for c in cliques} == {1}
    assert sorted(rows.values())[-1] == 4 and rows["alone"] != rows["lone2"]
    assert community.modularity(g, found) > 0.5
    again = community.cluster(build.Graph(g.nodes.repartition(3), g.edges.repartition(5)))
    assert {r.id: r.community for r in again.collect()} == rows


def planted(seed, n, groups, inside, outside):
    """Edges of a random graph whose nodes link within their group more often than beyond it."""
    rng = random.Random(seed)
    of = [rng.randrange(groups) for _ in range(n)]
    return [(f"n{i:04d}", f"n{j:04d}") for i in range(n) for j in range(i) if rng.random() < (inside if of[i] == of[j] else outside)]


def brute_modularity(pairs, of):
    degree = Counter(x for p in pairs for x in p)
    mass = Counter()
    for i, d in degree.items():
        mass[of[i]] += d
    return sum(of[a] == of[b] for a, b in pairs) / len(pairs) - sum(m * m for m in mass.values()) / (4 * len(pairs) ** 2)


def brute_louvain(pairs):
    """Node by node, level by level."""
    near = defaultdict(Counter)
    for a, b in pairs:
        near[a][b] += 1
        near[b][a] += 1
    whole, members = 2 * len(pairs), {i: i for i in near}
    while True:
        k = {i: sum(x.values()) for i, x in near.items()}
        of, mass, merged = {i: i for i in near}, Counter(k), False
        moving = True
        while moving:
            moving = False
            for i in sorted(near):
                links = Counter()
                for j, w in near[i].items():
                    if j != i:
                        links[of[j]] += w
                mass[of[i]] -= k[i]
                best = max(sorted(set(links) | {of[i]}), key=lambda c: (round(links[c] - k[i] * mass[c] / whole, 9), c == of[i]))
                moving, merged = moving or best != of[i], merged or best != of[i]
                of[i] = best
                mass[best] += k[i]
        if not merged:
            return members
        members = {i: of[c] for i, c in members.items()}
        coarse = defaultdict(Counter)
        for i, x in near.items():
            for j, w in x.items():
                coarse[of[i]][of[j]] += w
        near = coarse


def both_sides(spark, pairs):
    return spark.createDataFrame([(x, y, 1.0) for a, b in pairs for x, y in ((a, b), (b, a))], "id string, other string, w double")


@pytest.mark.parametrize(("by_task", "n", "groups", "inside", "outside"), [(True, 150, 4, 0.25, 0.02), (True, 300, 3, 0.08, 0.03), (True, 500, 12, 0.2, 0.01), (False, 16, 2, 0.8, 0.05)])
def test_communities_are_as_good_as_louvains(spark, monkeypatch, by_task, n, groups, inside, outside):
    monkeypatch.setattr(community, "TASK_SIDES", 10**6 if by_task else 6)
    pairs = planted(7, n, groups, inside, outside)
    sides = both_sides(spark, pairs).repartition(3)
    found = {r.id: r.c for r in community.partition(sides, 1.0).collect()}
    assert brute_modularity(pairs, found) >= brute_modularity(pairs, brute_louvain(pairs)) - 0.02
    near = defaultdict(set)
    for a, b in pairs:
        if found[a] == found[b]:
            near[a].add(b)
            near[b].add(a)
    for c, ids in grouped(found).items():
        assert c == min(ids)
        reached = [c]
        for v in reached:
            reached += sorted(near[v] - set(reached))
        assert set(reached) == set(ids)
    if by_task:
        assert {r.id: r.c for r in community.partition(sides.repartition(5), 1.0).collect()} == found


def grouped(found):
    out = defaultdict(list)
    for i, c in found.items():
        out[c].append(i)
    return out


@pytest.mark.parametrize("by_task", [True, False])
def test_modularity_rises_in_every_round(spark, by_task):
    n = 120 if by_task else 14
    pairs = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(n - 1)] + ([(f"n{i:04d}", f"n{i * 7 % n:04d}") for i in range(2, n, 3)] if by_task else [])
    pairs = sorted({tuple(sorted(p)) for p in pairs if p[0] != p[1]})
    seen = []
    if by_task:
        number = {x: at for at, x in enumerate(sorted({x for p in pairs for x in p}))}
        a, b = (np.array([number[p[e]] for p in pairs]) for e in (0, 1))
        community.settled(np.append(a, b), np.append(b, a), np.ones(2 * len(pairs)), len(number), 1.0, seen)
    else:
        sides = both_sides(spark, pairs).coalesce(2).cache()
        strength = sides.groupBy("id").agg(F.sum("w").alias("k"))
        of = {r.id: r.c for r in community._moved(sides, strength, float(len(pairs)), 1.0, seen).collect()}
        near = defaultdict(list)
        for a, b in pairs:
            near[a].append(b)
            near[b].append(a)
        mass = Counter()
        for i, c in of.items():
            mass[c] += len(near[i])

        def gain(i, c):
            return sum(of[x] == c for x in near[i]) - len(near[i]) * (mass[c] - len(near[i]) * (of[i] == c)) / (2 * len(pairs))

        assert not [i for i in of for x in near[i] if gain(i, of[x]) > gain(i, of[i]) + 1e-6]
    assert len(seen) >= 2 and all(x < y for x, y in zip(seen, seen[1:], strict=False))


def test_large_communities_are_split(spark):
    # Two cliques joined by many edges are one community at this resolution, and too large a share of all nodes.
    parts = [[f"{c}{i}" for i in range(8)] for c in "ab"]
    pairs = [p for c in parts for p in combinations(c, 2)] + [(f"a{i}", f"b{(i + j) % 8}") for i in range(8) for j in range(3)]
    other = [[f"{c}{i}" for i in range(3)] for c in "mnopqrstuvwx"] + [[f"{c}{c}{i}" for i in range(2)] for c in "ghijklmnopqrstuvwxyz"]
    pairs += [p for c in other for p in combinations(c, 2)]
    sides = both_sides(spark, pairs)
    whole = {r.id: r.c for r in community.partition(sides, 1.0).collect()}
    assert len({whole[x] for c in parts for x in c}) == 1
    g = graph(spark, pairs)
    found = {r.id: r.community for r in community.cluster(build.Graph(g.nodes, g.edges)).collect()}
    size = Counter(found.values())
    assert len({found[x] for x in parts[0]}) == len({found[x] for x in parts[1]}) == 1 and found["a0"] != found["b0"]
    assert size[found["a0"]] == size[found["b0"]] == 8 and {found["a0"], found["b0"]} == {0, 1}


def test_rows_are_numbered_over_ranges(spark):
    rows = [(i * 37 % 1000, f"x{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(6)
    got = {(r.a, r.b): r.place for r in paths.numbered(df, "place", "a", "b").collect()}
    assert got == {r: n for n, r in enumerate(sorted(rows))}
    assert paths.numbered(df.limit(0), "place", "a").count() == 0


def test_cohesion_and_labels(spark):
    g = graph(spark, [("a", "b"), ("b", "c")], extra=["d"])
    row = metrics.cohesion(g).first()
    assert (row.size, row.cohesion) == (4, 0.33)
    assert community.labels(g).first().label == "b & a"


def test_json_round_trip(spark, tmp_path):
    g = graph(spark, [("a", "b"), ("b", "c")], extra=["d"])
    export.write_json(g, str(tmp_path / "g"))
    back = export.read_json(spark, str(tmp_path / "g"))
    assert sorted((r.id, r.label) for r in back.nodes.collect()) == sorted((r.id, r.label) for r in g.nodes.collect())
    assert sorted((r.a, r.b, r.relation) for r in back.edges.collect()) == sorted((r.a, r.b, r.relation) for r in g.edges.collect())


def test_vault_index(spark, tmp_path):
    rows = [("c1", "GraphStore", "code", "src/store.py", 0), ("c2", "indexBy", "code", "src/store.py", 0), ("d1", "Architecture", "document", "docs/arch.md", 1), ("p1", "LeidenPaper", "paper", "papers/leiden.pdf", 1), ("n1", "Cache rationale", "note", "wiki-out/ingested/note-1.md", 0)]
    nodes = spark.createDataFrame([(*r, r[0]) for r in rows], NODES)
    edges = spark.createDataFrame([("c1", "c2", "calls", "EXTRACTED", "1"), ("c1", "d1", "mentions", "EXTRACTED", "2"), ("d1", "p1", "references", "INFERRED", "3")], EDGES)
    g = build.Graph.build(nodes, edges)
    labels = spark.createDataFrame([(0, "Storage"), (1, "Theory")], "community int, label string")
    text = "\n".join(r.text for r in export.vault_index(g, labels).orderBy("place").collect())
    for part in ("## Code (2)", "## Document (1)", "## Paper (1)", "## Note (1)", "[[GraphStore]]", "## Communities (2)", "3 members", "2 members", "type: vault-index", "5 nodes", "2 communities"):
        assert part in text
    notes = {r.id: r for r in export.node_notes(g, labels).collect()}
    assert notes["c1"].folder == "code" and "- [[indexBy]] - `calls` [EXTRACTED]" in notes["c1"].note and "#community/Storage" in notes["c1"].note
    assert {r.community for r in export.community_notes(g, labels).collect()} == {0, 1}
    export.write_vault(g, labels, str(tmp_path / "vault"))


def records(rng, files_):
    """Node and edge records of some files: few ids, so that files say much about the same ones."""
    nodes, edges = [], []
    for f in files_:
        for n in range(rng.randrange(4)):
            nodes.append((f, f"n{rng.randrange(25):02d}", rng.choice([None, "x", "y"]), f"{f}:{n}"))
        for n in range(rng.randrange(5)):
            edges.append((f, f"n{rng.randrange(25):02d}", f"n{rng.randrange(25):02d}", rng.choice([None, "p", "q"]), f"{f}:{n}"))
    return nodes, edges


@pytest.mark.parametrize("seed", [1])
def test_upkeep_equals_a_full_build(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(upkeep, "BUCKETS", 7)
    node, edge = "file string, id string, label string, ord string", "file string, source string, target string, relation string, ord string"
    rng = random.Random(seed)
    said = {f"f{i}": records(rng, [f"f{i}"]) for i in range(12)}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(2)
    every = lambda kind: [r for f in sorted(said) for r in said[f][kind]]
    kept = upkeep.Upkeep(spark, f"{tmp_path}/kept")
    kept.create(frame(every(0), node), frame(every(1), edge))
    for turn in range(3):
        changed = rng.sample(sorted(said), 2) + [f"g{turn}"]
        if turn == 2:
            changed = ["f0", "never"]
        for f in changed:
            said[f] = records(rng, [f]) if f[0] != "n" and rng.random() < 0.8 else ([], [])
        kept.update(frame([(f,) for f in changed], "file string"), frame([r for f in changed for r in said[f][0]], node), frame([r for f in changed for r in said[f][1]], edge))
        want = build.Graph.build(frame(every(0), node).drop("file"), frame(every(1), edge).drop("file"))
        got = kept.graph()
        for part in ("nodes", "edges"):
            columns = getattr(want, part).columns
            assert sorted(getattr(got, part).select(columns).collect(), key=repr) == sorted(getattr(want, part).collect(), key=repr), (turn, part)
        assert {r.id: r.component for r in kept.components().collect()} == {r.id: r.component for r in paths.components(want).collect()}, turn
        held = {r.id: r.component for r in kept._whole("members").where("id is not null").collect()}
        assert held == {r.id: r.component for r in kept.components().collect()}


def test_upkeep_reads_what_a_change_touches(spark, tmp_path):
    node, edge = "file string, id string, label string, ord string", "file string, source string, target string, relation string, ord string"
    n = 2000
    nodes = [(f"f{i // 2}", f"n{i:05d}", "x", f"{i:05d}") for i in range(n)]
    edges = [(f"f{i // 2}", f"n{i:05d}", f"n{i + 1:05d}", "p", f"{i:05d}") for i in range(0, n, 2)]
    kept = upkeep.Upkeep(spark, f"{tmp_path}/kept")
    kept.create(spark.createDataFrame(nodes, node), spark.createDataFrame(edges, edge))
    fresh = [("f3", "n00006", "new", "00006")]
    kept.update(spark.createDataFrame([("f3",)], "file string"), spark.createDataFrame(fresh, node), spark.createDataFrame([], edge))
    assert all(rows < n / 10 for rows in kept.read_rows.values()) and set(kept.read_rows) >= {"said_nodes", "nodes", "sides", "labels"}
    assert kept.graph().nodes.count() == n - 1 and {r.id: r.component for r in kept.components().where("id = 'n00006'").collect()} == {"n00006": "n00006"}


@pytest.mark.parametrize("kept", [centrality.KEPT_CELLS, 10])
@pytest.mark.parametrize(("n", "hubs", "rest", "tail"), [(30, 3, 0.02, 0), (25, 2, 0.05, 6), (60, 4, 0.0, 0), (10, 0, 0.3, 40)])
def test_searches_in_batches_equal_single_ones(monkeypatch, kept, n, hubs, rest, tail):
    """Sums of nodes and edges from many sources at once, with hubs, edges beside them and long paths; without room, source by source."""
    monkeypatch.setattr(centrality, "KEPT_CELLS", kept)
    rng = np.random.default_rng(n)
    pairs = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.6 if i < hubs else rest)} | {(n + k - 1, n + k) for k in range(tail)}
    m = n + tail
    a, b = np.sort(rng.permutation(m)[np.array(sorted(pairs))], axis=1).T
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    copies, weight = (rng.integers(1, most, m).astype(float) for most in (4, 5))
    copies[~np.isin(np.arange(m), np.append(a, b))] = 1.0
    tails, number = np.append(a, b), np.tile(np.arange(len(a)), 2)
    order = np.argsort(tails, kind="stable")
    arrays = centrality.Arrays(np.searchsorted(tails[order], np.arange(m + 1)), np.append(b, a)[order], number[order], copies, weight)
    nodes, edges = np.zeros(m), np.zeros(len(a))
    alone = [centrality.shares(s, arrays, nodes, edges) for s in range(m)]
    parts = [centrality.search(m, a, b, copies, weight, task, 3, True) for task in range(3)]
    assert np.allclose(sum(p[0] for p in parts), nodes) and np.allclose(sum(p[1] for p in parts), edges)
    reach = dict(zip(np.concatenate([p[2] for p in parts]).tolist(), np.concatenate([p[3] for p in parts]).tolist(), strict=True))
    assert sorted(reach) == list(range(m)) and np.allclose([reach[s] for s in range(m)], [x[0] for x in alone])
    assert sum(p[4] for p in parts) == sum(x[1] for x in alone)
    only = [centrality.search(m, a, b, copies, weight, task, 2, False) for task in range(2)]
    assert np.allclose(sum(p[0] for p in only), nodes)


def test_communities_of_numbers_and_side_by_side(spark):
    """Numbers keep their order as such, and large communities are settled in one job."""
    pairs = [(x + 8 * c, y + 8 * c) for c in range(3) for x, y in combinations(range(8), 2)] + [(7, 8), (15, 16)]
    sides = spark.createDataFrame([(x, y, 1.0) for a, b in pairs for x, y in ((a, b), (b, a))], "id long, other long, w double").repartition(3)
    assert {r.id: r.c for r in community.partition(sides, 1.0).collect()} == {i: i // 8 * 8 for i in range(24)}
    members = spark.createDataFrame([(i, 0 if i < 16 else 16) for i in range(24)], "id long, c long")
    assert {r.id: r.c for r in community._split(sides, members, 1.0).collect()} == {i: i // 8 * 8 for i in range(24)}
