"""Rust by recognisers over blanked text: items, impl blocks, use declarations, calls, fields."""

from __future__ import annotations

import re

from .builder import Builder, blanked, calls, closing
from .clike import owners
from .names import Binding, normalize

USE = re.compile(r"\buse\s+([^;]+);")
ITEM = re.compile(r"\b(struct|enum|trait|mod|fn)\s+([A-Za-z_]\w*)")
IMPL = re.compile(r"\bimpl\b\s*(?:<[^{};]*?>\s*)?(?:([\w:<>,&' ]+?)\s+for\s+)?([\w:<>,&' \[\]]+?)\s*(?:where\b[^{]*)?\{")
FIELD = re.compile(r"\b[a-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)+")


def bindings_of(path: str) -> list[Binding]:
    path = " ".join(path.split())
    group = re.fullmatch(r"(.*)::\{(.+)\}", path)
    items = [f"{group.group(1)}::{x.strip()}" for x in group.group(2).split(",") if x.strip()] if group else [path]
    out = []
    for item in items:
        m = re.fullmatch(r"(.*?)(?:\s+as\s+([A-Za-z_]\w*))?", item)
        *front, last = m.group(1).strip().split("::")
        out.append(Binding("::".join(front) or last, last, m.group(2) or last))
    return out


def item_end(text: str, at: int) -> int:
    """End of an item whose name ends at a place: its body, or the semicolon before one."""
    m = re.compile(r"[{;(]").search(text, at)
    while m and m.group() == "(":
        m = re.compile(r"[{;(]").search(text, closing(text, m.start()))
    return len(text) if not m else m.end() if m.group() == ";" else closing(text, m.start())


def parse(path: str, content: str) -> Builder:
    b, text = Builder(path, "rust", content), blanked(content, "rust")
    for m in USE.finditer(text):
        for x in bindings_of(m.group(1)):
            b.imported(x, normalize(f"{x.module}::{x.imported}"), m.start(), m.end())
    scopes: list[tuple[int, int, str]] = []  # traits, structs, enums and modules by name, impl blocks by type
    for m in IMPL.finditer(text):
        end, name = closing(text, m.end() - 1), m.group(2).strip()
        scopes.append((m.start(), end, name))
        b.type_references(f"impl:{path}:{name}", text[m.start() : end], 0.68, "rust", m.start(), end)
        if m.group(1):
            b.edge("implements", f"struct:{path}:{name}", m.group(1).strip(), 1.0, m.start(), end)
    items = [(m, item_end(text, m.end())) for m in ITEM.finditer(text) if not re.match(r"[\w.]", text[max(0, m.start() - 1) : m.start()])]
    for m, end in items:
        if m.group(1) != "fn":
            scopes.append((m.start(), end, m.group(2)))
    around = owners(scopes, "")
    spans, headers = [], set()
    for m, end in items:
        kind, name = m.group(1), m.group(2)
        inner = owners([s for s in scopes if not (s[0] == m.start() and s[1] == end)], "")
        outer = inner(m.start())
        qualified = f"{outer}::{name}" if outer else name
        if kind == "mod":
            b.symbol("module", name, qualified, m.start(), end)
        elif kind != "fn":
            ident = b.symbol(kind, name, qualified, m.start(), end)
            spans.append((m.start(), end, ident))
            b.type_references(ident, text[m.start() : end], 0.74, "rust", m.start(), end)
            if outer:
                b.edge("defines", f"module:{path}:{outer}", ident, 1.0, m.start(), end)
        elif text[end - 1 : end] == "}":  # a signature without a body defines nothing
            ident = b.symbol("function", name, qualified, m.start(), end)
            headers.add(m.start(2))
            spans.append((m.start(), end, ident))
            if outer:
                b.edge("defines", f"impl:{path}:{outer}", ident, 1.0, m.start(), end)
            b.handled(ident, name, m.start(), end)
            b.used_bindings(ident, text[m.start() : end], m.start(), end)
            b.type_references(ident, text[m.start() : end], 0.72, "rust", m.start(), end)
        else:
            headers.add(m.start(2))
    owner = owners(spans, b.file)
    for callee, at, inside in calls(text, 0, len(text)):
        if at not in headers and not text[max(0, at - 4) : at].endswith("fn "):
            argument = content[inside[0] - 1 : inside[1] + 1]
            b.called(owner(at), callee, argument if "\n" in argument else None, at, inside[1] + 1, ("reads", "writes", "publishes", "subscribes"))
    for m in FIELD.finditer(text):
        target = normalize(m.group())
        if target and around is not None:
            b.edge("references", owner(m.start()), target, 0.5, m.start(), m.end())
    return b
