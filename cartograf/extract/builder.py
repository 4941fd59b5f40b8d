"""Collects the nodes and edges of one file, and views source text with comments and strings blanked out."""

from __future__ import annotations

import bisect
import hashlib
import posixpath
import re

from .names import CONFIDENCE, Binding, metadata_json, semantic_target, types_in, verbs_of


class Builder:
    def __init__(self, path: str, language: str, content: str):
        self.path, self.language, self.content = path, language, content
        self.file = f"file:{path}"
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.bindings: list[Binding] = []
        self._ids: set[str] = set()
        self._edge_ids: dict[str, int] = {}
        self._lines = [0, *(m.end() for m in re.finditer("\n", content))]
        self._node(self.file, "file", posixpath.basename(path) or path, None, 1, len(self._lines), None, None)

    def line(self, at: int) -> int:
        return bisect.bisect_right(self._lines, at)

    def _node(self, ident, kind, name, qualified, first, last, digest, metadata):
        self._ids.add(ident)
        self.nodes.append({"id": ident, "kind": kind, "name": name, "language": self.language, "qualified_name": qualified, "file_path": self.path, "start_line": first, "end_line": last, "hash": digest, "metadata_json": metadata})

    def symbol(self, kind: str, name: str, qualified: str, start: int, end: int, metadata: dict | None = None) -> str:
        """A node for the text from start to end, once for each id, contained in the file."""
        ident = f"{kind}:{self.path}:{qualified}"
        if ident not in self._ids:
            text = self.content[start:end]
            self._node(ident, kind, name, qualified, self.line(start), self.line(max(start, end - 1)), hashlib.sha256(text.encode()).hexdigest(), metadata_json(kind, metadata or None))
            self.edge("contains", self.file, ident, 1.0, start, end)
        return ident

    def edge(self, kind: str, source: str, target: str, confidence: float, start: int, end: int) -> None:
        """An edge found at a place; one that has neither end's text is left out."""
        if not source or not target:
            return
        ident = f"{kind}:{source}:{target}:{self.line(start)}:{start - self._lines[self.line(start) - 1]}"
        again = self._edge_ids.get(ident, 0)
        self._edge_ids[ident] = again + 1
        if again:
            ident += f"#{again}"
        self.edges.append({"id": ident, "from_id": source, "to_id": target, "kind": kind, "confidence": confidence, "source_file": self.path, "source_start_line": self.line(start), "source_end_line": self.line(max(start, end - 1))})

    def imported(self, binding: Binding, target: str, start: int, end: int) -> None:
        self.edge("imports", self.file, binding.module, 1.0, start, end)
        self.edge("depends_on", self.file, target, 0.9, start, end)
        self.bindings.append(binding)

    def called(self, owner: str, callee: str, argument: str | None, start: int, end: int, verbs: tuple[str, ...], plain: bool = True) -> None:
        if plain:
            self.edge("calls", owner, callee, 0.8, start, end)
        target = semantic_target(callee, argument, self.bindings)
        for kind in verbs_of(callee, verbs):
            self.edge(kind, owner, target, CONFIDENCE[kind], start, end)

    def used_bindings(self, owner: str, text: str, start: int, end: int) -> None:
        """depends_on edges to imported names that a text mentions."""
        words = set(re.findall(r"\w+", text, re.ASCII))
        for b in dict.fromkeys(self.bindings):
            if b.local in words or (b.local and not b.local.isidentifier() and re.search(rf"\b{re.escape(b.local)}\b", text)):
                self.edge("depends_on", owner, semantic_target(b.local, f"{b.module}::{b.imported or b.local}", self.bindings), 0.85, start, end)

    def type_references(self, owner: str, text: str, confidence: float, dialect: str, start: int, end: int, both: bool = True) -> None:
        for name in types_in(text, dialect):
            if name != owner:
                if both:
                    self.edge("references", owner, name, confidence, start, end)
                self.edge("depends_on", owner, name, round(confidence - 0.05, 2) if both else confidence, start, end)

    def handled(self, owner: str, name: str, start: int, end: int) -> None:
        if name.lower().startswith("handle"):
            self.edge("handles", owner, semantic_target(name, re.sub(r"\Ahandle_?", "", name), []), 0.7, start, end)


QUOTED = {
    "c": r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'',
    "typescript": r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\[\s\S])*`',
    "rust": r'r(#*)"[\s\S]*?"\1|b?"(?:[^"\\]|\\[\s\S])*"|b?\'(?:[^\'\\\n]|\\[^\n]{1,9}?)\'',
}


def blanked(content: str, dialect: str) -> str:
    """The text with comments and insides of strings as blanks, every place and line kept."""
    pattern = rf"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|(?:{QUOTED[dialect]})"
    keep_ends = lambda s: s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1] if len(s) > 1 and s[0] in "\"'`" else re.sub(r"[^\n]", " ", s)
    return re.sub(pattern, lambda m: keep_ends(m.group()), content)


PAIRS = {"{": "}", "(": ")", "[": "]"}


def closing(text: str, at: int) -> int:
    """Place behind the bracket that closes the one at ``at``; the end of the text if it stays open."""
    opens, closes, depth = text[at], PAIRS[text[at]], 0
    for m in re.compile(f"[{re.escape(opens + closes)}]").finditer(text, at):
        depth += 1 if m.group() == opens else -1
        if not depth:
            return m.end()
    return len(text)


def brace_depths(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(place, depth) after each curly bracket between two places, depth 0 at the start."""
    out, depth = [(start, 0)], 0
    for m in re.compile("[{}]").finditer(text, start, end):
        depth += 1 if m.group() == "{" else -1
        out.append((m.end(), depth))
    return out


def at_depth(depths: list[tuple[int, int]], place: int) -> int:
    return depths[bisect.bisect_right(depths, (place, 1 << 30)) - 1][1]


# words are taken whole: one that could be cut anywhere would be tried in all its cuts
CALL = re.compile(r"(?<![A-Za-z_$])((?:[A-Za-z_$][\w$]*+(?:<[\w:, ]*+>)?(?:\s*+(?:\.|->|::|\?\.)\s*+)?)+)\s*+(!?)\(")
KEYWORDS = frozenset("if for while switch return catch sizeof function match loop else do constructor super typeof new in of await fn impl where case throw alignof decltype defined".split())


def calls(text: str, start: int, end: int):
    """(callee, place, inside of the brackets as (start, end)) of what looks like calls in blanked text."""
    for m in CALL.finditer(text, start, end):
        callee = m.group(1).strip()
        head = re.split(r"\W+", callee)[0]
        if head in KEYWORDS or m.group(2) or callee.endswith((".", ":", ">")) and not callee.endswith(">"):
            continue
        stop = min(closing(text, m.end() - 1), end)
        yield callee, m.start(), (m.end(), stop - 1)
