"""Traversals, rankings and searches against small graphs with known values and brute force."""

from __future__ import annotations

import random

import pytest

from cartograf import schemas as S
from cartograf.operators import analyze, graph, search
from cartograf.sources.derived import Graph


def make(spark, nodes, edges, files=None) -> Graph:
    node_rows = [{"id": n[0], "kind": n[1], "name": n[2], **(n[3] if len(n) > 3 else {})} for n in nodes]
    edge_rows = [{"id": f"{k}:{a}:{b}:{i}", "from_id": a, "to_id": b, "kind": k} for i, (a, k, b) in enumerate(edges)]
    fill = lambda rows, schema: spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
    paths = files or sorted({r["file_path"] for r in node_rows if r.get("file_path")})
    return Graph(fill(node_rows, S.NODES), fill(edge_rows, S.EDGES), fill([{"path": p, "symbol_count": 1} for p in paths], S.FILES))


def reached(df):
    return {r.id: (r.path_length, r.via_edge_kind) for r in df.collect()}


@pytest.fixture(scope="module")
def mail(spark):
    at = lambda p: {"file_path": p, "qualified_name": None}
    return make(
        spark,
        [("app", "module", "app", at("/src/app.ts")), ("mail", "service", "mail", at("/src/runtime/mail.ts")), ("run", "function", "run", at("/src/runtime/app.ts")), ("helper", "function", "helper", at("/src/tools/helper.ts"))],
        [("app", "depends_on", "mail"), ("run", "calls", "mail"), ("helper", "calls", "run")],
    )


def test_known_graph(mail):
    degree = {r.id: (r.fan_in, r.fan_out) for r in graph.degrees(mail.nodes, mail.edges).collect()}
    assert degree["mail"] == (2, 0) and degree["helper"] == (0, 1)
    path = [r.id for r in graph.shortest_path(mail.nodes, mail.edges, "helper", "mail").orderBy("step").collect()]
    assert path == ["helper", "run", "mail"]
    assert [r.id for r in graph.shortest_path(mail.nodes, mail.edges, "run", "run").collect()] == ["run"]
    assert graph.shortest_path(mail.nodes, mail.edges, "mail", "app").count() == 0
    assert reached(graph.dependencies(mail.nodes, mail.edges, "helper")) == {"run": (1, "calls"), "mail": (2, "calls")}
    assert reached(graph.callers(mail.nodes, mail.edges, "mail")) == {"app": (1, "depends_on"), "run": (1, "calls"), "helper": (2, "calls")}
    assert analyze.rank_nodes(mail.nodes, mail.edges).orderBy("decision_score", ascending=False).first().id == "mail"


def test_ranking_scores(spark):
    full = {"file_path": "a.ts", "qualified_name": "q", "domain": "analysis", "subsystem": "ranking", "summary": "s"}
    g = make(spark, [("low", "function", "low", {"file_path": "a.ts", "qualified_name": "l", "summary": "s"}), ("high", "function", "high", full), ("target", "function", "target", full)], [("low", "calls", "target"), ("high", "calls", "target")])
    assert {r.id: r.decision_score for r in analyze.rank_nodes(g.nodes, g.edges).collect()} == {"target": 10.5, "high": 5.5, "low": 2.5}


def simple_paths(edges, start, depth):
    """Distances and kinds by enumerating every simple path, as (distance, joined kinds)."""
    best: dict = {}
    todo = [(b, k, 1, {start, b}) for a, k, b in edges if a == start]
    while todo:
        node, kind, d, seen = todo.pop()
        if node not in best or d < best[node][0]:
            best[node] = (d, {kind})
        elif d == best[node][0]:
            best[node][1].add(kind)
        if d < depth:
            todo += [(b, k, d + 1, seen | {b}) for a, k, b in edges if a == node and b not in seen]
    return {n: (d, ", ".join(sorted(k))) for n, (d, k) in best.items()}


@pytest.mark.parametrize("seed", range(4))
def test_reachable_is_path_enumeration(spark, seed):
    rng = random.Random(seed)
    names = list("abcdefg")
    edges = list({(rng.choice(names), rng.choice(["calls", "reads", "contains"]), rng.choice([*names, "gone"])) for _ in range(13)})
    edges += [("gone", "calls", "b")]
    g = make(spark, [(n, "function", n) for n in names], edges)
    start, depth = rng.choice(names), rng.randint(0, 4)
    arch = [e for e in edges if e[1] != "contains"]
    want = {n: v for n, v in simple_paths(arch, start, max(depth, 1)).items() if n != "gone"}
    assert reached(graph.reachable(g.nodes, g.edges, start, depth)) == want
    back = [(b, k, a) for a, k, b in edges]
    assert reached(graph.reachable(g.nodes, g.edges, start, 3, "inbound", False)) == {n: v for n, v in simple_paths(back, start, 3).items() if n != "gone"}


def test_neighborhood_is_the_bag_form(spark):
    edges = [("a", "calls", "b"), ("b", "contains", "c"), ("x", "calls", "a"), ("y", "reads", "x"), ("c", "calls", "lost"), ("lost2", "calls", "a"), ("q", "calls", "b")]
    g = make(spark, [(n, "class", n) for n in "abcxyq"], edges)
    bag = {e for e in edges if "a" in (e[0], e[2])}
    for _ in range(1):
        bag |= {e for e in edges for n in bag if e[0] == n[2] or e[2] == n[0]}
    got = {(r.from_id, r.kind, r.to_id) for r in graph.neighborhood(g.nodes, g.edges, "a", 2).collect()}
    assert got == {e for e in bag if e[0] != "lost2"}


def test_neighbors_keep_dangling_ends(spark):
    g = make(spark, [("a", "class", "a")], [("a", "calls", "text"), ("a", "calls", "a")])
    rows = graph.neighbors(g.nodes, g.edges, "a", "both").collect()
    assert sorted((r.to_id, r.node_name, r.direction) for r in rows) == [("a", "a", "inbound"), ("a", "a", "outbound"), ("text", None, "outbound")] or len(rows) == 3


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    items = [f"i{k:02}" for k in range(30)]
    links = [(rng.choice(items), rng.choice(items)) for _ in range(22)] + [(f"i{k:02}", f"i{k + 1:02}") for k in range(20, 29)]
    label = {i: i for i in items}
    for _ in items:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(links, "a string, b string")
    got = {r.item: r.least for r in graph.components(df, spark.createDataFrame([(i,) for i in items], "item string")).collect()}
    assert got == label


def test_topology_votes_and_third_party(spark):
    g = make(
        spark,
        [("u", "class", "U", {"file_path": "/p/src/ui/u.ts"}), ("t", "class", "T", {"file_path": "/p/src/odd/t.ts"}), *[(f"c{k}", "function", f"c{k}", {"file_path": "/p/src/core/c.ts"}) for k in range(4)], ("v", "function", "v", {"file_path": "/p/vendor/v.ts"})],
        [("t", "calls", f"c{k}") for k in range(4)] + [(f"c{k}", "calls", "v") for k in range(4)],
    )
    topology = {r.path: r for r in analyze.file_topology(g.nodes, g.edges, g.files).collect()}
    assert topology["/p/src/odd/t.ts"].domain == "core" and topology["/p/src/ui/u.ts"].domain == "ui"
    assert (topology["/p/src/core/c.ts"].fan_in, topology["/p/src/core/c.ts"].fan_out, topology["/p/src/core/c.ts"].centrality) == (4, 4, 16)
    assert len({r.cluster_id.split(":")[1] for r in topology.values()}) == 2
    tables = analyze.overview(g.nodes, g.edges, g.files)
    assert all("vendor" not in r.path for r in tables["critical_files"].collect())
    assert all("vendor" not in (r.file_path or "") for r in tables["recommendations"].collect())


def test_search_tiers_and_best_match(spark):
    q = lambda n: {"qualified_name": n, "file_path": "/t.ts"}
    g = make(
        spark,
        [("c", "class", "TestClass", q("TestClass")), ("f", "function", "TestClass", q("x::TestClass")), ("m", "method", "foo", q("TestClass.foo")), ("n", "method", "bar", q("TestClass.bar")), ("z", "function", "a%b", q("a%b"))],
        [("c", "defines", "m"), ("c", "defines", "n"), ("n", "calls", "f")],
    )
    found = search.search(g.nodes, "testclass")
    assert [(r.id, r.score, r.match_type) for r in found.collect()] == [("c", 110, "exact"), ("f", 100, "exact"), ("m", 80, "prefix"), ("n", 80, "prefix")]
    assert search.best_match(found, g.edges).first().id == "c"
    assert [r.id for r in search.search(g.nodes, "%").collect()] == ["z"]
    assert search.search(g.nodes, "testclass", kind="method", file="T.TS").count() == 2
    assert search.search_symbols(g.nodes, "foo").first().id == "m"
    assert search.search_symbols(g.nodes, "nothing at all").count() == 0 and search.search_symbols(g.nodes, "nothing", filtered=False).count() == 5
    assert {r.id for r in search.find_by_name(g.nodes, "TESTCLASS").collect()} == {"c", "f"}
