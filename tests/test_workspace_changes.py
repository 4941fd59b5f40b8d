"""Listing, hashing, change detection, event streams, reports on a small workspace."""

from __future__ import annotations

import os
import time

import pytest

from cartograf import indexing, report
from cartograf.extract import registry
from cartograf.operators import patch
from cartograf.sources import store, workspace
from cartograf.streaming import changes

from .test_graph import make


def write(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_listing_and_ignore_rules(tmp_path):
    for name in ("src/a.ts", "src/skip.log", "node_modules/x.ts", "keep/b.py", "out/c.py", "deep/out/d.py", "tmp/e.rs", "tmp/keep.rs", "docs/f.md"):
        write(tmp_path, name, "x")
    write(tmp_path, ".gitignore", "# no logs\n*.log\n/out/\ntmp/*\n!tmp/keep.rs\ndocs/**\n")
    found = [p.removeprefix(f"{tmp_path}/") for p in workspace.list_files(str(tmp_path))]
    assert sorted(found) == [".gitignore", "deep/out/d.py", "keep/b.py", "src/a.ts", "tmp/keep.rs"]


def test_read_diff_and_targets(spark, tmp_path):
    a, b = write(tmp_path, "a.ts", "export class A {}\n"), write(tmp_path, "b.py", "def é():\n  pass\n")
    files = workspace.read_files(spark, [a, b])
    rows = {r.path: r for r in files.collect()}
    assert rows[a].hash == store.hash_text("export class A {}\n") and rows[b].language == "python" and rows[b].content.startswith("def é")
    stored = spark.createDataFrame([(a, rows[a].hash), (b, "old")], "path string, hash string")
    assert [(r.path, r.status) for r in workspace.hash_diff(files, stored).collect()] == [(b, "changed")]
    assert [r.path for r in workspace.deleted_files(spark.createDataFrame([(a,), ("/gone",)], "path string"), files).collect()] == ["/gone"]
    none, one = stored.select("path").limit(0), spark.createDataFrame([("x",)], "path string")
    assert {(r.path, r.source) for r in workspace.update_targets(none, one, stored).collect()} == {("x", "dirty")}
    assert workspace.update_targets(none, none, none).count() == 0
    assert not workspace.safe_to_index("/") and not workspace.safe_to_index("/home/someone") and not workspace.safe_to_index("/usr/lib")


def events(spark):
    rows = [
        ("write_file", {"path": "src/a.ts"}, None, None), ("Edit", {"file": "/ws/src/../src/b.py"}, ["c.rs", "n.md"], None), ("read_file", {"path": "src/no.ts"}, None, None),
        ("graph_update", {"path": "src/own.ts"}, None, None), ("save", {"path": "/else/x.ts"}, None, ["./src//a.ts", " "]), ("move", {"target": "../out.ts"}, None, None),
    ]
    return spark.createDataFrame(rows, "tool_name string, params map<string,string>, files array<string>, paths array<string>")


def test_dirty_set_batch_and_stream(spark, tmp_path):
    want = {"/ws/src/a.ts", "/ws/src/b.py", "/ws/c.rs"}
    batch = events(spark)
    assert {r.path for r in changes.dirty_set(batch, "/ws").collect()} == want
    source = str(tmp_path / "in")
    batch.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second run finds nothing new
        changes.run_available(changes.dirty_stream(stream, "/ws"), str(tmp_path / "out"), str(tmp_path / "state"))
        assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want)
    assert changes.normalized("../x", "/ws") is None and changes.normalized("a/../b.ts", "/ws") == "/ws/b.ts"


def test_states(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path))
    assert changes.graph_state(s) == "missing"
    store.set_meta(str(tmp_path), schemaVersion=1)
    assert changes.graph_state(s) == "schema_mismatch"
    store.set_meta(str(tmp_path), schemaVersion=2, dirtyFiles=["a"])
    assert changes.graph_state(s) == "dirty"
    store.set_meta(str(tmp_path), dirtyFiles=[])
    assert changes.graph_state(s) == "corrupted"
    s.commit(make(spark, [], []))
    assert changes.graph_state(s) == "ready"


def test_workspace_to_reports(spark, tmp_path):
    write(tmp_path, "src/core/store.ts", "export class Store {\n  save(x: number) { return x; }\n  load() { return 1; }\n}\n")
    write(tmp_path, "src/app/main.ts", "import { Store } from '../core/store.ts';\nexport function start() { helper(); return new Store(); }\nexport function helper() { return 2; }\n")
    files = workspace.read_files(spark, workspace.list_files(str(tmp_path)))
    nodes, edges = registry.extract(files)
    empty = make(spark, [], [])
    g = patch.relabel(patch.apply_patch(empty, files.drop("content"), nodes, edges))
    s = store.GraphStore(spark, str(tmp_path / ".graph"))
    s.commit(g, store.build_revision(str(tmp_path), None, 1, []))
    g = s.graph()
    text = report.inspect(g, "Store.save", depth=1)
    assert "Symbol: save [method]" in text and "Fan-in:" in text
    impact = report.impact(g, "helper")
    assert "start [function]" in impact and "Affected Files:" in impact
    assert report.inspect(g, "Store.load", form="mermaid", depth=1).startswith("graph TD\n")
    assert report.inspect(g, "zzz") == "No symbols found matching: zzz"
    overview = report.overview(g, s.revision())
    assert "| class | 1 |" in overview and "### Core Runtime Hubs" in overview


def test_parent_steps_at_any_depth(spark):
    names = [f"{'/'.join('abcdefgh'[:k])}/{'../' * j}x{k}{j}.ts" for k in range(1, 9) for j in range(11)] + ["/ws/a/b/c/d/e/../../../../../x.ts", "./a//./b/../y.ts", "/../ws/z.ts"]
    df = spark.createDataFrame([("write_file", {"path": n}, None, None) for n in names], "tool_name string, params map<string,string>, files array<string>, paths array<string>")
    want = {changes.normalized(n, "/ws") for n in names} - {None}
    assert {r.path for r in changes.dirty_set(df, "/ws").collect()} == want and "/ws/x.ts" in want


def test_init_and_update_end_to_end(spark, tmp_path):
    a = write(tmp_path, "src/core/store.ts", "export class Store {\n  save(x: number) { return x; }\n}\n")
    b = write(tmp_path, "src/app/main.py", "def start():\n    helper()\n\ndef helper():\n    return 2\n")
    write(tmp_path, "notes.md", "no code\n")
    h = write(tmp_path, "src/c/a.h", "struct P { int x; };\n")
    s, told = store.GraphStore(spark, str(tmp_path / ".graph")), []
    assert indexing.update(s, str(tmp_path)) == {"updated": 0, "source": "none", "skipped": True}
    done = indexing.init(s, str(tmp_path), progress=lambda n, total: told.append((n, total)))
    assert done["initialized"] and (done["files"], done["skipped"], done["deleted"]) == (3, 1, 0) and told[-1] == (4, 4)
    assert changes.graph_state(s) == "ready" and indexing.init(s, str(tmp_path)) == {"skipped": True, "state": "ready"}
    files = {r.path: r for r in s.table("files").collect()}
    assert set(files) == {a, b, h} and files[h].language == "c" and files[b].symbol_count == 3
    assert s.node(f"function:{b}:start").first().name == "start"
    assert [r.to_id for r in s.table("edges").filter("kind = 'calls'").collect()] == [f"function:{b}:helper"]
    want = store.build_revision(str(tmp_path), None, int(s.revision()["indexedAt"]), [f.hash for f in files.values()])
    assert s.revision()["graphRevision"] == want["graphRevision"]
    first = s.version()
    assert indexing.update(s, str(tmp_path)) == {"updated": 0, "checked": 3, "source": "tracked", "skipped": True} and s.version() == first
    write(tmp_path, "src/app/main.py", "def start():\n    return 1\n")
    os.unlink(a)
    store.mark_dirty(str(s.folder), [a, b, h])
    assert indexing.init(s, str(tmp_path))["needsUpdate"]
    got = indexing.update(s, str(tmp_path))
    assert (got["updated"], got["checked"], got["source"]) == (2, 3, "dirty") and changes.graph_state(s) == "ready"
    assert {r.id for r in s.table("nodes").filter("kind <> 'struct'").collect()} == {f"file:{b}", f"function:{b}:start", f"file:{h}"}
    assert {r.path for r in s.table("files").collect()} == {b, h} and s.file(a).isEmpty()

    def abort(n, total):
        raise KeyError("stop")

    with pytest.raises(KeyError):
        indexing.init(s, str(tmp_path), force=True, progress=abort)
    assert not (s.folder / "_LOCK").exists()
    assert indexing.auto_index(s, str(tmp_path)) is None


def test_background_index(spark, tmp_path, monkeypatch):
    write(tmp_path, "a.py", "def f():\n    pass\n")
    monkeypatch.setattr(workspace, "BARRED", {"/": 0})
    s, told = store.GraphStore(spark, str(tmp_path / ".graph")), []
    assert indexing.auto_index(s, str(tmp_path)) is None  # no marker
    write(tmp_path, "Makefile", "")
    assert indexing.auto_index(s, str(tmp_path), told.append).result(120)["files"] == 1
    assert changes.graph_state(s) == "ready"


def test_safety_rules(tmp_path, monkeypatch):
    write(tmp_path, "go.mod", "")
    assert not workspace.safe_to_index(str(tmp_path))  # system tree
    monkeypatch.setattr(workspace, "BARRED", {k: v for k, v in workspace.BARRED.items() if k != "/tmp"})
    assert workspace.safe_to_index(str(tmp_path))
    monkeypatch.setenv("HOME", str(tmp_path))
    assert not workspace.safe_to_index(str(tmp_path))
    assert not any(map(workspace.safe_to_index, ("/", "/home", "/home/a", "/Users/b", "/root", "/etc", "/usr/lib/x")))


def test_lock(spark, tmp_path, monkeypatch):
    one, two = (store.GraphStore(spark, str(tmp_path)) for _ in range(2))
    monkeypatch.setattr(store, "RETRIES", 1)
    monkeypatch.setattr(store, "REFRESH_S", 0.05)
    old = time.time() - 100
    with one.lock() as held:
        os.utime(held.path, (old, old))
        time.sleep(0.5)  # the holder touches it again
        with pytest.raises(TimeoutError), two.lock():
            pass
        held._over.set()
        time.sleep(0.2)
        os.utime(held.path, (old, old))
        with two.lock() as other:  # taken over
            with pytest.raises(store.LostLock):
                one.commit(make(spark, [], []))
            held.release()
            assert other.mine()
    assert not held.path.exists()
    version = one.commit(make(spark, [], []))
    with pytest.raises(store.StaleGraph):
        two.commit(make(spark, [], []), over="v1")
    assert two.version() == version and list(tmp_path.glob("_LOCK*")) == []
