"""C and C++ by recognisers over blanked text: includes, type definitions with bodies, functions, calls."""

from __future__ import annotations

import re

from .builder import Builder, blanked, calls, closing
from .names import Binding, include_target, normalize

INCLUDE = re.compile(r"^[ \t]*#[ \t]*include[ \t]*([<\"][^>\"\n]+[>\"])", re.M)
TAGGED = re.compile(r"\b(struct|union|enum)\s+(?:class\s+)?([A-Za-z_]\w*)\s*(?=\{)")
ANY_TAG = re.compile(r"\b(struct|union|enum)\s+([A-Za-z_]\w*)")
TYPEDEF = re.compile(r"\btypedef\b")
CLASS = re.compile(r"\b(class|struct)\s+(?:[A-Z][A-Z0-9_]*\s+)?([A-Za-z_]\w*)\s*(?:final\s*)?(:[^;{()]*)?\{")
FUNCTION = re.compile(r"([A-Za-z_~][\w:~]*)\s*\(")
NOT_FUNCTIONS = frozenset("if for while switch return catch sizeof do else defined new delete throw".split())


def functions(text: str, strict: bool):
    """(name, start of the definition, header end, end) of functions with a body; ``strict``: not those that return pointers."""
    for m in FUNCTION.finditer(text):
        name = m.group(1)
        if name.split("::")[-1].lstrip("~") in NOT_FUNCTIONS:
            continue
        close = closing(text, m.end() - 1)
        rest = re.compile(r"\s*(?:const\b|noexcept\b|override\b|final\b|->\s*[\w:<>*& ]+|\s)*(?::\s*\w+\s*[({][^;]*?[)}]\s*(?=\{))?\{").match(text, close)
        if not rest:
            continue
        before = re.compile(r"[^;{}#]*\Z").search(text, max(0, m.start() - 400), m.start())
        head = before.group() if before else ""
        head = head.rpartition("\n\n")[2]
        kinds = re.sub(r"\b(public|private|protected|signals|slots)\s*:", "", head).strip()
        if "=" in kinds or "," in kinds.replace("<", "").split("(")[0] and "<" not in kinds or (not kinds and "::" not in name and strict):
            continue
        if strict and kinds.endswith("*"):
            continue
        start = m.start() - len(head) + (len(head) - len(head.lstrip()))
        yield name, start, close, closing(text, rest.end() - 1)


def owners(spans: list[tuple[int, int, str]], default: str):
    """Innermost of the spans around a place."""
    spans = sorted(spans, key=lambda s: s[1] - s[0])
    return lambda at: next((ident for a, z, ident in spans if a <= at < z), default)


def includes(b: Builder, text: str) -> None:
    for m in INCLUDE.finditer(b.content):
        if text[m.start() : m.end()].strip():
            target = include_target(b.path, m.group(1))
            b.imported(Binding(target, "", ""), target, m.start(), m.end())
    b.bindings.clear()


def emit_calls(b: Builder, text: str, owner, verbs: tuple[str, ...], headers: set[int]) -> None:
    for callee, at, inside in calls(text, 0, len(text)):
        name = normalize(callee)
        if name and at not in headers:
            argument = b.content[inside[0] - 1 : inside[1] + 1]
            b.called(owner(at), name, argument if "\n" in argument else None, at, inside[1] + 1, verbs)


def parse_c(path: str, content: str) -> Builder:
    b, text = Builder(path, "c", content), blanked(content, "c")
    includes(b, text)
    spans, headers = [], set()
    for m in ANY_TAG.finditer(text):
        body = re.compile(r"\s*\{").match(text, m.end())
        end = closing(text, body.end() - 1) if body else m.end()
        ident = b.symbol(m.group(1), m.group(2), m.group(2), m.start(), end)
        b.type_references(ident, text[m.start() : end], 0.75, "c", m.start(), end)
        spans.append((m.start(), end, ident))
    for m in TYPEDEF.finditer(text):
        end, at = m.end(), m.end()
        while at < len(text) and text[at] != ";":
            at = closing(text, at) if text[at] in "{(" else at + 1
        end = min(at + 1, len(text))
        flat = re.sub(r"\{[\s\S]*\}", " ", text[m.end() : at])
        pointer = re.search(r"\(\s*\*\s*([A-Za-z_]\w*)\s*\)", flat)
        names = re.findall(r"[A-Za-z_]\w*", re.sub(r"\[[^\]]*\]", "", flat))
        if name := pointer.group(1) if pointer else names[-1] if names else None:
            ident = b.symbol("type", name, name, m.start(), end)
            b.type_references(ident, text[m.start() : end], 0.7, "c", m.start(), end)
            spans.append((m.start(), end, ident))
    for name, start, close, end in functions(text, True):
        ident = b.symbol("function", name, name, start, end)
        at = text.rfind(name, start, close)
        headers.add(text.find(name, start))
        headers.add(at)
        spans.append((start, end, ident))
        b.type_references(ident, text[start:close], 0.72, "c", start, end)
    emit_calls(b, text, owners(spans, b.file), ("reads", "writes"), headers)
    return b


def parse_cpp(path: str, content: str) -> Builder:
    b, text = Builder(path, "cpp", content), blanked(content, "c")
    includes(b, text)
    spans, headers, classes = [], set(), []
    for m in CLASS.finditer(text):
        end = closing(text, m.end() - 1)
        classes.append((m.start(), end, m.group(2)))
    scope_of = lambda at: "::".join(n for a, z, n in classes if a < at < z)
    for m in CLASS.finditer(text):
        end, outer = closing(text, m.end() - 1), scope_of(m.start())
        qualified = f"{outer}::{m.group(2)}" if outer else m.group(2)
        ident = b.symbol(m.group(1), m.group(2), qualified, m.start(), end)
        for base in re.split(r",(?![^<]*>)", (m.group(3) or "").lstrip(":")):
            base = re.sub(r"\b(public|private|protected|virtual)\b", "", base).strip()
            if base:
                b.edge("extends", ident, base, 1.0, m.start(), end)
                b.edge("depends_on", ident, base, 0.85, m.start(), end)
        b.type_references(ident, text[m.start() : end], 0.75, "cpp", m.start(), end)
        if outer:
            b.edge("defines", f"class:{path}:{outer}", ident, 1.0, m.start(), end)
        spans.append((m.start(), end, ident))
    for name, start, close, end in functions(text, False):
        outer = scope_of(start)
        qualified = f"{outer}::{name}" if outer else name
        ident = b.symbol("function", name.split("::")[-1], qualified, start, end)
        headers.add(text.rfind(name, start, close))
        headers.add(text.find(name + "(", start))
        if outer:
            b.edge("defines", f"class:{path}:{outer}", ident, 1.0, start, end)
        b.type_references(ident, text[start:close], 0.72, "cpp", start, end)
        spans.append((start, end, ident))
    emit_calls(b, text, owners(spans, b.file), ("reads", "writes", "publishes", "subscribes", "routes_to"), headers)
    return b


