"""What the extractors find in small sources, and extraction as a table function."""

from __future__ import annotations

import pytest

from cartograf.extract import registry
from cartograf.extract.names import Binding, include_target, metadata_json, normalize, semantic_target, through_bindings


def run(path, content, language=None):
    b = registry.default.get(registry.default.route(path, language))(path, content)
    return b, {(n["kind"], n["qualified_name"]) for n in b.nodes}, {(e["kind"], e["from_id"].rpartition(":")[2], e["to_id"]) for e in b.edges}


def test_metadata():
    assert metadata_json("function", {"async": True, "note": "é"}) == '{"async":true,"note":"é"}' and metadata_json("topic", None) is None
    assert metadata_json("topic", {"qos": 1.5}) == '{"qos":1.5}' and metadata_json("module", {"async": 1}) == '{"async":1}'
    for kind, bad in (("method", {"exported": None}), ("class", {"abstract": 1}), ("topic", {"qos": True}), ("topic", {"retain": "x"})):
        with pytest.raises(ValueError, match="must be"):
            metadata_json(kind, bad)


def test_names():
    assert normalize("new this.client.read()") == "client.read"
    assert normalize('  "abc"') == "abc" and normalize("a->b()") == "a.b" and normalize("crate::x::{A, B}") == "x"
    bound = [Binding("./fs", "readFile", "rf")]
    assert semantic_target("rf", None, bound) == "./fs::readFile" and semantic_target("rf.sync", None, bound) == "./fs::readFile.sync"
    assert semantic_target("rfx", None, bound) == "rfx" and through_bindings("", bound) == "" and through_bindings("q::readFile", bound) == "./fs::readFile"
    both = [Binding("a", "F", "f"), Binding("b", "G", "f.g"), Binding("c", "H", "h::f.g")]
    assert through_bindings("f.g", both) == "b::G" and through_bindings("f.x", both) == "a::F.x" and through_bindings("f::y", both) == "a::F::y"
    assert include_target("/a/b/c.c", '"../x.h"') == "/a/x.h" and include_target("/a/b/c.c", "<vector>") == "vector"


def test_python():
    b, nodes, edges = run("/w/a.py", "from pathlib import Path as P\nimport os.path\n\nclass A(Base, m.Mixin):\n    class In:\n        pass\n    def read(self):\n        return P('x').open()\n\nasync def handle_get(x: Model):\n    bus.publish(topic)\n")
    assert {("class", "A"), ("class", "A.In"), ("method", "A.read"), ("function", "handle_get")} < nodes
    assert {("depends_on", "A.read", "pathlib::Path"), ("extends", "A", "Base"), ("extends", "A", "m.Mixin"), ("defines", "A", "method:/w/a.py:A.read"), ("handles", "handle_get", "get"), ("publishes", "handle_get", "topic"), ("imports", "/w/a.py", "os.path"), ("references", "handle_get", "Model")} < edges
    assert [n["start_line"] for n in b.nodes if n["name"] == "handle_get"] == [10]
    assert ("class", "X") in run("/w/b.py", "class X:\n  def broken(:\n")[1]
    assert len(run("/w/é.py", "x = 'ü'; y = f(x)\n")[0].edges) == 1


def test_typescript():
    source = """import def, { readFile as rf, other } from './fs';
import * as ns from "ns";
// class Comment {}
export abstract class Svc<T> extends Base<T> implements One, Two {
  private name: string = '';
  private run(x: number) { return rf(x); }
  async save(y: { a: number }): Promise<void> { await store.save(y); }
  get size(): number { return 1; }
  constructor(a: A) { super(); helper(a); }
}
export interface Shape extends Thing { area(): number; sides: number }
export type Alias = { a: number } | string;
export enum Color { Red = 1, Green }
export const a = 1, b = (x) => x;
export default function main() { router.forward('t'); bus.emit(`x`, 2); }
class Hidden { m() {} }
function alsoHidden() {}
"""
    b, nodes, edges = run("/w/a.ts", source)
    want = {("class", "Svc"), ("property", "Svc.name"), ("method", "Svc.run"), ("method", "Svc.save"), ("getter", "Svc.getSize"), ("constructor", "Svc.constructor"), ("interface", "Shape"), ("method", "Shape.area"), ("property", "Shape.sides"), ("type", "Alias"), ("enum", "Color"), ("enum-member", "Color.Red"), ("enum-member", "Color.Green"), ("variable", "a"), ("variable", "b"), ("function", "main")}
    assert nodes == want | {("file", None)}
    assert {("extends", "Svc", "Base<T>"), ("implements", "Svc", "One"), ("implements", "Svc", "Two"), ("calls", "Svc.run", "rf"), ("depends_on", "Svc.run", "./fs::readFile"), ("writes", "Svc.save", "y"), ("routes_to", "main", "t"), ("publishes", "main", "x"), ("imports", "/w/a.ts", "./fs"), ("depends_on", "/w/a.ts", "ns"), ("calls", "Svc.constructor", "helper")} < edges
    assert not any(e["kind"] == "calls" and "." in e["to_id"] for e in b.edges)
    assert sum(e["kind"] == "defines" for e in b.edges) == 7
    assert len(run("/w/e.ts", "")[0].nodes) == 1


def test_rust():
    _, nodes, edges = run("/w/a.rs", "use std::fs::read_to_string as read_file;\nuse a::b::{C, D as E};\nmod inner { pub struct P { x: Q } }\ntrait Draw { fn draw(&self); }\nimpl<T> Draw for Item<T> {\n  fn draw(&self) { read_file(\"x { \"); self.a.b; }\n}\nfn handle_it() -> Vec<Model> { go!(1); E::new() }\n")
    assert {("module", "inner"), ("struct", "inner::P"), ("trait", "Draw"), ("function", "Item<T>::draw"), ("function", "handle_it")} < nodes
    assert {("depends_on", "draw", "std::fs::read_to_string"), ("imports", "/w/a.rs", "std::fs"), ("depends_on", "/w/a.rs", "a::b::D"), ("implements", "Item<T>", "Draw"), ("calls", "draw", "read_file"), ("handles", "handle_it", "it"), ("references", "handle_it", "Model"), ("calls", "handle_it", "E::new")} < edges


def test_c():
    _, nodes, edges = run("/w/src/c/a.h", '#include "./shape.h"\n#include <stdio.h>\ntypedef struct { int x; } Shape;\ntypedef int (*Callback)(Event *e);\nunion U { int a; };\nstatic int area(Shape *s, int n)\n{\n  (f(n))();\n  return load_size(s);\n}\nint proto(int);\n')
    assert {("type", "Shape"), ("type", "Callback"), ("union", "U"), ("function", "area")} < nodes and ("function", "proto") not in nodes
    assert {("imports", "/w/src/c/a.h", "/w/src/c/shape.h"), ("imports", "/w/src/c/a.h", "stdio.h"), ("depends_on", "area", "Shape"), ("calls", "area", "load_size"), ("reads", "area", "load_size")} < edges
    assert all(t for _, _, t in edges)


def test_cpp():
    _, nodes, edges = run("/w/a.cpp", "class Fwd;\nclass Win : public Base, private ns::Other {\n public:\n  Win() : m(0) {}\n  void show(const Config &c) const { bus->connect(this); bus.publish(c); }\n  Model *model;\n};\nnamespace n { struct S { int v; }; }\nint Win::size() { return get_size(); }\n")
    assert {("class", "Win"), ("struct", "S"), ("function", "Win::show"), ("function", "Win::size")} < nodes and ("class", "Fwd") not in nodes
    assert {("extends", "Win", "Base"), ("extends", "Win", "ns::Other"), ("depends_on", "Win", "Model")} < edges
    assert any(k == "calls" and "connect" in t for k, _, t in edges) and any(k == "publishes" for k, *_ in edges)


def test_table_function(spark):
    rows = [("/w/a.py", "python", "def f():\n  g()\n"), ("/w/b.js", "javascript", "x"), ("/w/c.ts", None, "export class A {}"), ("/w/d.py", "python", None)]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    kinds = [(r.row, r.file_path, r.message) for r in registry.extract_rows(files).collect() if r.row in ("skipped", "failed")]
    assert sorted(kinds) == [("skipped", "/w/b.js", "no extractor"), ("skipped", "/w/d.py", "no content")]
    nodes, edges = registry.extract(files)
    assert {r.id for r in nodes.collect()} == {"file:/w/a.py", "function:/w/a.py:f", "file:/w/c.ts", "class:/w/c.ts:A"}
    assert {r.kind for r in edges.collect()} == {"contains", "calls"}
    own = registry.Registry()
    own.register("python", registry.default.get("c"))
    own.register("python", registry.default.get("python"))
    assert own.languages() == ["python"] and own.route("/src/c/x.hpp") is None and registry.default.route("/src/c/x.hpp") == "c"
