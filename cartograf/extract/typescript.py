"""TypeScript by recognisers over blanked text: exported top-level declarations and members of classes and interfaces."""

from __future__ import annotations

import re

from .builder import Builder, at_depth, blanked, brace_depths, calls, closing
from .names import Binding

IMPORT = re.compile(r"^[ \t]*import\s+(?:type\s+)?([^'\"`;]*?)(?:\s*from\s*)?['\"]([^'\"\n]*)['\"]", re.M)
DECLARED = re.compile(
    r"\bexport\s+(?:default\s+)?(?:declare\s+)?(abstract\s+)?(async\s+)?(?:const\s+(?=enum\b))?(class|interface|type|enum|function\*?|const|let|var)\s+([A-Za-z_$][\w$]*)"
)
MEMBER = re.compile(
    r"(?:^|[;{}\n])[ \t]*((?:(?:public|private|protected|static|readonly|abstract|override|async|declare)\s+)*)(get\s+(?=[\w$#]+\s*\()|set\s+(?=[\w$#]+\s*\()|\*\s*)?([A-Za-z_$#][\w$]*)\s*[?!]?\s*(<[^>(]*>\s*)?([(:=;]|(?=\n|\}))"
)
VERBS = ("reads", "writes", "publishes", "subscribes", "routes_to")


def bindings_of(clause: str, module: str) -> list[Binding]:
    out = []
    named = re.search(r"\{([^}]*)\}", clause)
    for item in (named.group(1) if named else "").split(","):
        m = re.fullmatch(r"\s*(?:type\s+)?([\w$]+)(?:\s+as\s+([\w$]+))?\s*", item)
        if m:
            out.append(Binding(module, m.group(1), m.group(2) or m.group(1)))
    rest = re.sub(r"\{[^}]*\}|\*\s*as\s+[\w$]+", "", clause).strip(" ,\n\t")
    if re.fullmatch(r"[\w$]+", rest):
        out.append(Binding(module, "default", rest))
    return out


def statement_end(text: str, at: int) -> int:
    """End of a statement without a body of its own: its semicolon, or the line end where no bracket is open."""
    while at < len(text):
        if text[at] in "{([":
            at = closing(text, at)
        elif text[at] == ";":
            return at + 1
        elif text[at] == "\n" and not re.compile(r"\s*(?:[|&.=?:+]|=>)").match(text, at) and not re.search(r"[|&=,:?+]\s*\Z", text[max(0, at - 20) : at]):
            return at
        else:
            at += 1
    return at


def body_start(text: str, at: int) -> int | None:
    """Where the body of a function opens whose parameters end at a place; None if it has none. A bracket behind a colon, a bar or the like opens a type."""
    while at < len(text):
        c = text[at]
        if c == "{":
            before = text[:at].rstrip()
            if not before.endswith((":", "|", "&", "<", ",", "=>")):
                return at
            at = closing(text, at)
        elif c in "([":
            at = closing(text, at)
        elif c in ";}" or (c == "\n" and not re.compile(r"\s*[{|&:]").match(text, at)):
            return None
        else:
            at += 1
    return None


def members(b: Builder, text: str, owner: str, name: str, body: int, end: int, is_class: bool) -> None:
    depths, seen_constructor = brace_depths(text, body + 1, end - 1), False
    at = body + 1
    pattern = re.compile(MEMBER.pattern)
    while m := pattern.search(text, at - 1 if at > body + 1 else body, end - 1):
        start, kind = m.start(3), (m.group(2) or "").strip()
        if at_depth(depths, start) or m.group(3) in ("if", "for", "while", "return", "switch"):
            at = m.end() if m.end() > at else at + 1
            continue
        mark, word = m.group(5), m.group(3)
        if mark == "(":
            stop = closing(text, m.end() - 1)
            opened = body_start(text, stop)
            stop = closing(text, opened) if opened is not None else statement_end(text, stop)
        else:
            stop = statement_end(text, m.end(3))
        stop = min(stop, end - 1)
        if is_class and word == "constructor" and mark == "(":
            if not seen_constructor:
                ident = b.symbol("constructor", "constructor", f"{name}.constructor", start, stop)
                b.edge("defines", owner, ident, 1.0, start, stop)
                calls_in(b, text, ident, start, stop)
                b.used_bindings(ident, b.content[start:stop], start, stop)
            seen_constructor = True
        elif word not in ("constructor",):
            what = {"get": "getter", "set": "setter"}.get(kind, "method" if mark == "(" else "property")
            qualified = f"{name}.{kind}{word[:1].upper()}{word[1:]}" if kind in ("get", "set") else f"{name}.{word}"
            metadata = {"async": "async" in m.group(1), "exported": True} if what == "method" else None
            ident = b.symbol(what, word, qualified, start, stop, metadata)
            b.edge("defines", owner, ident, 1.0, start, stop)
            if is_class and what in ("method", "getter", "setter"):
                calls_in(b, text, ident, start, stop)
                b.used_bindings(ident, b.content[start:stop], start, stop)
        at = max(stop, m.end(3) + 1)


def calls_in(b: Builder, text: str, owner: str, start: int, end: int) -> None:
    head = re.compile(r"[\w$#]+\s*(?:<[^>(]*>)?\s*\(").search(text, start, end)
    for callee, at, inside in calls(text, start, end):
        if head and at == head.start():
            continue
        first = b.content[inside[0] : inside[1]]
        cut, k = len(first), 0
        plain = text[inside[0] : inside[1]]
        while k < len(plain):
            if plain[k] in "{([":
                k = closing(plain, k)
            elif plain[k] == ",":
                cut = k
                break
            else:
                k += 1
        b.called(owner, callee, first[:cut].strip() or None, at, inside[1] + 1, VERBS, plain=re.fullmatch(r"[\w$]+", callee) is not None)


def parse(path: str, content: str) -> Builder:
    b, text = Builder(path, "typescript", content), blanked(content, "typescript")
    for m in IMPORT.finditer(content):
        if not text[m.start() : m.end()].strip():
            continue
        b.edge("imports", b.file, m.group(2), 1.0, m.start(), m.end())
        b.edge("depends_on", b.file, m.group(2), 0.9, m.start(), m.end())
        b.bindings += bindings_of(m.group(1), m.group(2))
    depths = brace_depths(text, 0, len(text))
    for m in DECLARED.finditer(text):
        if at_depth(depths, m.start()):
            continue
        kind, name, start = m.group(3).rstrip("*"), m.group(4), m.start()
        if kind in ("const", "let", "var"):
            end = statement_end(text, m.end())
            b.symbol("variable", name, name, m.start(4), end)
            flat = re.sub(r"=>?[\s\S]*?(?=,\s*[\w$]+\s*[=:]|\Z)", "", text[m.end() : end])
            for other in re.finditer(r",\s*([A-Za-z_$][\w$]*)\s*(?=[=:,;]|\Z)", flat):
                b.symbol("variable", other.group(1), other.group(1), start, end)
            continue
        if kind == "type":
            b.symbol("type", name, name, start, statement_end(text, m.end()))
            continue
        if kind == "function":
            open_at = text.find("(", m.end())
            close = closing(text, open_at) if open_at >= 0 else m.end()
            opened = body_start(text, close)
            end = closing(text, opened) if opened is not None else statement_end(text, close)
            ident = b.symbol("function", name, name, start, end, {"async": bool(m.group(2)), "exported": True})
            calls_in(b, text, ident, m.start(4), end)
            b.used_bindings(ident, content[start:end], start, end)
            continue
        body = text.find("{", m.end())
        if body < 0:
            continue
        end, head = closing(text, body), text[m.end() : body]
        ident = b.symbol(kind, name, name, start, end, {"abstract": bool(m.group(1))} if kind == "class" else None)
        parts = re.split(r"\b(extends|implements)\b", head)
        for word, names in zip(parts[1::2], parts[2::2], strict=True):
            for base in re.split(r",(?![^<]*>)", names):
                if base.strip():
                    b.edge(word, ident, base.strip(), 1.0, start, end)
        if kind == "enum":
            for item in re.finditer(r"(?:\A|,)\s*([A-Za-z_$][\w$]*)", text[body + 1 : end - 1]):
                at = body + 1 + item.start(1)
                b.symbol("enum-member", item.group(1), f"{name}.{item.group(1)}", at, at + len(item.group(1)))
        else:
            members(b, text, ident, name, body, end, kind == "class")
            b.used_bindings(ident, content[start:end], start, end)
    return b
