"""Python, by its own syntax tree. A file that doesn't parse gives its file node and what its lines show."""

from __future__ import annotations

import ast
import re

from .builder import Builder
from .names import Binding, normalize

VERBS = ("reads", "writes", "publishes", "subscribes")


class Walker(ast.NodeVisitor):
    def __init__(self, b: Builder):
        self.b, self.scope, self.owner = b, None, b.file
        data = b.content.encode()
        starts = [0]
        for line in data.split(b"\n")[:-1]:
            starts.append(starts[-1] + len(line) + 1)
        ascii_only = len(data) == len(b.content)
        self.place = (lambda line, col: starts[line - 1] + col) if ascii_only else (lambda line, col: len(data[: starts[line - 1] + col].decode("utf-8", "ignore")))

    def span(self, node) -> tuple[int, int]:
        first = node
        return self.place(first.lineno, first.col_offset), self.place(node.end_lineno, node.end_col_offset)

    def text(self, node) -> str:
        a, z = self.span(node)
        return self.b.content[a:z]

    def inside(self, node, scope, owner):
        before = self.scope, self.owner
        self.scope, self.owner = scope, owner
        self.generic_visit(node)
        self.scope, self.owner = before

    def defined(self, ident, a, z):
        if self.scope:
            self.b.edge("defines", f"class:{self.b.path}:{self.scope}", ident, 1.0, a, z)

    def visit_ClassDef(self, node):
        a, z = self.span(node)
        qualified = f"{self.scope}.{node.name}" if self.scope else node.name
        ident = self.b.symbol("class", node.name, qualified, a, z, {"abstract": False})
        self.b.type_references(ident, self.text(node), 0.72, "python", a, z)
        for base in node.bases:
            if isinstance(base, ast.Name | ast.Attribute):
                self.b.edge("extends", ident, self.text(base), 1.0, a, z)
        self.defined(ident, a, z)
        self.inside(node, qualified, ident)

    def function(self, node):
        a, z = self.span(node)
        qualified = f"{self.scope}.{node.name}" if self.scope else node.name
        kind = "method" if self.scope else "function"
        ident = self.b.symbol(kind, node.name, qualified, a, z, {"async": isinstance(node, ast.AsyncFunctionDef), "exported": not self.scope})
        self.defined(ident, a, z)
        self.b.handled(ident, node.name, a, z)
        self.b.used_bindings(ident, self.text(node), a, z)
        self.b.type_references(ident, self.text(node), 0.7, "python", a, z)
        self.inside(node, self.scope, ident)

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def visit_Call(self, node):
        a, z = self.span(node)
        first = node.args[0] if node.args else node.keywords[0].value if node.keywords else None
        self.b.called(self.owner, self.text(node.func), self.text(first) if first is not None else None, a, z, VERBS)
        self.generic_visit(node)

    def visit_Attribute(self, node):
        a, z = self.span(node)
        target = normalize(self.text(node))
        if target != self.owner:
            self.b.edge("references", self.owner, target, 0.5, a, z)
        self.generic_visit(node)

    def bind(self, node, bindings):
        a, z = self.span(node)
        for x in bindings:
            self.b.imported(x, normalize(f"{x.module}::{x.imported}"), a, z)

    def visit_Import(self, node):
        last = lambda s: s.rpartition(".")[2]
        self.bind(node, [Binding(n.name, last(n.name), n.asname or last(n.name)) for n in node.names])

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        self.bind(node, [Binding(module, n.name, n.asname or n.name) for n in node.names])


def parse(path: str, content: str) -> Builder:
    b = Builder(path, "python", content)
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        for m in re.finditer(r"^(class|def)\s+(\w+)", content, re.M):
            b.symbol("class" if m.group(1) == "class" else "function", m.group(2), m.group(2), m.start(), m.end())
        return b
    Walker(b).visit(tree)
    return b
