"""Upserts, deletions, enrichment, resolution of textual ends, snapshots."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cartograf import schemas as S
from cartograf.operators import patch, resolve
from cartograf.sources import store
from cartograf.sources.derived import Graph

from .test_graph import make


def nodes_of(spark, rows):
    return make(spark, rows, []).nodes


def test_last_row_wins_and_patch_is_idempotent(spark):
    g = make(spark, [("a", "class", "old", {"file_path": "/x.ts"}), ("b", "class", "b", {"file_path": "/y.ts"})], [("a", "calls", "b")])
    new = nodes_of(spark, [("a", "class", "first", {"file_path": "/x.ts"})]).withColumn("seq", F.lit(1)).unionByName(nodes_of(spark, [("a", "class", "second", {"file_path": "/x.ts"})]).withColumn("seq", F.lit(2)))
    files = make(spark, [], [], ["/x.ts"]).files
    once = patch.apply_patch(g, files, new, g.edges.limit(0).withColumn("seq", F.lit(1)), order="seq")
    twice = patch.apply_patch(once, files, new, g.edges.limit(0).withColumn("seq", F.lit(1)), order="seq")
    for got in (once, twice):
        assert sorted((r.id, r.name) for r in got.nodes.collect()) == [("a", "second"), ("b", "b")]
        assert got.edges.count() == 1 and {r.path for r in got.files.collect()} == {"/x.ts", "/y.ts"}


def test_deleted_files_go_with_their_rows(spark):
    g = make(spark, [("a", "class", "a", {"file_path": "/x.ts"}), ("b", "class", "b", {"file_path": "/y.ts"})], [("a", "calls", "b"), ("b", "calls", "raw text")])
    edges = g.edges.withColumn("source_file", F.when(F.col("from_id") == "a", "/x.ts").otherwise("/y.ts"))
    left = patch.apply_patch(Graph(g.nodes, edges, g.files), g.files.limit(0), g.nodes.limit(0), g.edges.limit(0), spark.createDataFrame([("/x.ts",)], "path string"))
    assert [r.id for r in left.nodes.collect()] == ["b"] and [r.to_id for r in left.edges.collect()] == ["raw text"] and [r.path for r in left.files.collect()] == ["/y.ts"]


def test_enrichment(spark):
    got = {r.id: r for r in patch.enrich_nodes(nodes_of(spark, [("a", "class", "a", {"file_path": "/p/src/core/io/a.ts"}), ("b", "class", "b"), ("c", "class", "c", {"file_path": "/p/src/x/c.ts", "domain": "mine"})])).collect()}
    assert (got["a"].domain, got["a"].subsystem, got["a"].cluster_id) == ("core", "src/core/io", "core:src/core/io")
    assert (got["b"].domain, got["b"].cluster_id) == (None, None) and got["c"].cluster_id == "mine:src/x/c.ts"


def edge(spark, kind, a, b, source=None):
    return S.conform(spark.createDataFrame([("e", a, b, kind, source)], "id string, from_id string, to_id string, kind string, source_file string"), S.EDGES)


def resolved(spark, edges, local, stored):
    return resolve.resolve_edges(edges, local, stored).first()


def test_resolution(spark):
    at = lambda p, q=None: {"file_path": p, "qualified_name": q, "start_line": 3, "end_line": 9}
    stored = nodes_of(spark, [
        ("class:/auth.h:AuthService", "class", "AuthService", at("/auth.h", "AuthService")),
        ("file:/tmp/include/ApiBindings.h", "file", "ApiBindings.h", at("/tmp/include/ApiBindings.h")),
        ("function:/a/x.py:run", "function", "run", at("/a/x.py", "m.run")),
        ("function:/b/y.py:run", "function", "run", at("/b/y.py", "m.run")),
        ("function:/c/z.py:T.go", "function", "go", at("/c/z.py", "n::T.go")),
    ])
    local = nodes_of(spark, [("class:/a.h:SessionCoordinator", "class", "SessionCoordinator", at("/a.h", "SessionCoordinator"))])
    owner = "class:/a.h:SessionCoordinator"
    r = resolved(spark, edge(spark, "depends_on", owner, "authservice"), local, stored)
    assert (r.to_id, r.source_file, r.source_start_line) == ("class:/auth.h:AuthService", "/a.h", 3)
    assert resolved(spark, edge(spark, "imports", owner, "ApiBindings.h"), local, stored).to_id == "file:/tmp/include/ApiBindings.h"
    assert resolved(spark, edge(spark, "imports", owner, "../include/ApiBindings.h"), local, stored).to_id == "file:/tmp/include/ApiBindings.h"
    assert resolved(spark, edge(spark, "calls", owner, "run"), local, stored).to_id == "run"  # two equally good
    assert resolved(spark, edge(spark, "calls", owner, "run()", "/b/main.py"), local, stored).to_id == "function:/b/y.py:run"  # same folder
    assert resolved(spark, edge(spark, "calls", owner, "self.T.go"), local, stored).to_id == "function:/c/z.py:T.go"
    assert resolved(spark, edge(spark, "calls", "SessionCoordinator", "nobody"), local, stored).from_id == owner
    mine = nodes_of(spark, [(owner, "class", "AuthService", at("/a.h", "AuthService"))])
    assert resolved(spark, edge(spark, "calls", "x", "AuthService"), mine, stored).to_id == owner  # the patch's own first


def test_edges_need_both_ends(spark):
    with pytest.raises(Exception, match="without both ends"):
        patch.check_ends(edge(spark, "calls", "", "b")).collect()


def test_store_round_trip(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "g"))
    assert s.version() is None and s.graph().nodes.count() == 0 and s.revision() is None
    g = make(spark, [("a", "class", "a", {"file_path": "/x.ts"})], [("a", "calls", "b"), ("a", "contains", "c")])
    with s.lock():
        s.commit(g, store.build_revision("/ws", None, 5, ["h2", "h1"]))
    assert s.graph().edges.filter("kind = 'calls'").count() == 1 and s.graph().edges.columns == [f.name for f in S.EDGES]
    assert s.revision()["workspaceId"] == store.hash_text("/ws") and s.revision()["indexedAt"] == "5"
    first = s.version()
    s.commit(Graph(g.nodes.limit(0), g.edges, g.files))
    assert s.version() != first and s.graph().nodes.count() == 0 and s.revision() is not None
    (tmp_path / "g" / "_LOCK").touch()
    with pytest.MonkeyPatch.context() as m, pytest.raises(TimeoutError):
        m.setattr(store, "RETRIES", 1)
        m.setattr(store, "WAIT_S", 0.01)
        with s.lock():
            pass


def test_meta(tmp_path):
    folder = str(tmp_path)
    assert store.get_meta(folder) is None
    store.mark_dirty(folder, ["a", "b", "a"])
    assert store.mark_dirty(folder, ["b", "c"])["dirtyFiles"] == ["a", "b", "c"]
    assert store.clear_dirty(folder, ["a"]) == ["b", "c"] and store.get_meta(folder)["lastUpdateReason"] == "partial update remaining"
    assert store.clear_dirty(folder) == []


def test_registered_endpoints_match_brute_force(spark, monkeypatch):
    """All kinds are asked for and found, the patch's nodes first."""
    from cartograf.plans import queries

    at = lambda p, q=None: {"file_path": p, "qualified_name": q}
    rows = [
        ("namespace:0", "namespace", "ASIA", at("/ws/src/graph/regions.ts", "ASIA")),
        ("module:0", "module", "CHINA", at("/ws/src/graph/nation_0.ts", "CHINA")),
        ("service:3", "service", "Supplier#3", at("/ws/src/runtime/supplier_0.py", "Supplier#3")),
        ("service:4", "service", "Supplier#4", at("/ws/src/runtime/supplier_0.py", "Supplier#4")),
        ("class:1", "class", "Customer#1", at("/ws/src/ui/customer_0.ts", "Customer#1")),
        ("function:1", "function", "go", at("/ws/src/tools/brand_1.rs", "B::go")),
        ("function:2", "function", "order_2", at("/ws/src/tools/brand_1.rs", "B::order_2")),
        ("method:1", "method", "order_1", at("/ws/src/core/prio_1.cpp")),
        ("method:2", "method", "order_2", at("/ws/src/core/prio_1.cpp")),
        ("method:3", "method", "order_3", at("/ws/src/core/prio_2.cpp")),
    ]
    g = make(spark, rows, [])
    monkeypatch.setattr(queries, "derived_graph", lambda *_: g)
    got = {(r.kind, r.raw): r.resolved for r in queries.QUERIES["resolve_endpoints"](spark, "").collect()}

    def score(kind, n):
        _, k, name, more = n
        here, path = "/ws/src/runtime", more["file_path"]
        total = (name == name.rsplit("/", 1)[-1]) + 4 * (path.rsplit("/", 1)[0] == here) + 2 * path.startswith(here)
        total += 2 * path.endswith(".cpp") if kind == "imports" else 5
        return total + bool(more["qualified_name"] and "::" not in more["qualified_name"])

    def best(kind, raw, nodes, exact):
        fold = (lambda s: s) if exact else str.lower
        text = raw.removeprefix("new ").removesuffix("()")
        found = []
        for n in nodes:
            q, path = n[3]["qualified_name"] or "", n[3]["file_path"]
            names = {fold(x) for x in (n[2], q, q.split("::")[-1]) if x}
            texts = {text, text.split("::")[-1], text.split("/")[-1], text.split(".")[-1]}
            if any(fold(t) in names or t == path or fold(t) == fold(path.rsplit("/", 1)[-1]) for t in texts):
                found.append((score(kind, n), n[0]))
        top = [i for s, i in found if s == max(found)[0]]
        return bool(found), top[0] if len(top) == 1 else None

    patched = [("service:3", "service", "New Supplier#3", rows[2][3])]
    want = {}
    for _, k, name, more in rows + patched:
        text = {"service": name.upper(), "function": name, "class": f"new {name}()", "method": name}.get(k, more["file_path"])
        for raw in (text, name, more["file_path"]):
            kind = "calls" if k in ("function", "method") else "imports"
            met, found = best(kind, raw, patched, True)
            met, found = (met, found) if met else best(kind, raw, rows, False)
            if met:
                want[kind, raw] = found
    assert got == want
    assert got["calls", "order_1"] == "method:1" and got["calls", "order_2"] is None and got["imports", "/ws/src/graph/regions.ts"] == "namespace:0"
    assert got["imports", "/ws/src/runtime/supplier_0.py"] == "service:3" and got["calls", "/ws/src/core/prio_1.cpp"] is None and got["calls", "/ws/src/core/prio_2.cpp"] == "method:3"
