"""Names inside one source file: targets of calls and types, import bindings. Plain Python, for extractors."""

from __future__ import annotations

import json
import numbers
import posixpath
import re
from typing import NamedTuple

from .. import schemas as S
from ..functions.scalars import _STRIPS, TYPE_STOPS, VERBS

STRIPS = [(re.compile(p, re.ASCII if "\\s" not in p else 0), by) for p, by in ((p.replace("\\z", "\\Z"), by) for p, by in _STRIPS)]
# What counts as the name of a type, and the confidence of edges that verbs imply.
TYPES = {
    "python": re.compile(r"\b[A-Z][A-Za-z0-9_]*(?:\.[A-Z][A-Za-z0-9_]*)?\b", re.ASCII),
    "rust": re.compile(r"\b(?:[A-Z][A-Za-z0-9_]*|[a-z_][A-Za-z0-9_]*::[A-Z][A-Za-z0-9_]*)\b", re.ASCII),
    "c": re.compile(r"\b[A-Z_]\w*\b", re.ASCII),
    "cpp": re.compile(r"\b(?:[A-Z_]\w*(?:::\w+)*|std::\w+)\b", re.ASCII),
}
CONFIDENCE = {"reads": 0.55, "writes": 0.55, "publishes": 0.6, "subscribes": 0.6, "routes_to": 0.6}


class Binding(NamedTuple):
    module: str
    imported: str
    local: str


def normalize(raw: str) -> str:
    out = raw.strip()
    for pattern, by in STRIPS:
        out = pattern.sub(by, out)
    return out.strip()


def bound_name(b: Binding) -> str:
    return normalize(f"{b.module}::{b.imported or b.local}")


def _rest(target: str, b: Binding) -> str | None:
    """What a target adds to the name that a binding brings in; None if it isn't that name."""
    if target in (b.local, "") or target.endswith(f"::{b.imported}"):
        return "" if target else None
    parts = re.match(rf"{re.escape(b.local)}([.:].*)", target, re.DOTALL) if b.local else None
    return parts and parts.group(1)


def through_bindings(target: str, bindings: list[Binding]) -> str:
    """A target with an imported local name replaced by what it stands for: whole names before heads, then the first binding."""
    rests = [(rest, b) for b in bindings if (rest := _rest(target, b)) is not None]
    if not rests:
        return target
    rest, b = min(rests, key=lambda found: found[0] != "")
    return bound_name(b) + rest


def semantic_target(callee: str, argument: str | None, bindings: list[Binding]) -> str:
    return through_bindings(normalize(argument or callee) or normalize(callee), bindings)


def types_in(text: str, dialect: str) -> list[str]:
    stop = TYPE_STOPS[dialect]
    found = dict.fromkeys(normalize(m) for m in TYPES[dialect].findall(text))
    return [t for t in found if t and t not in stop]


def verbs_of(callee: str, only: tuple[str, ...]) -> list[str]:
    low = callee.lower()
    return [kind for kind, words in VERBS if kind in only and re.search(words, low)]


def include_target(path: str, raw: str) -> str:
    name = raw.strip().strip('"<>')
    return posixpath.normpath(posixpath.join(posixpath.dirname(path), name)) if name.startswith(".") or "/" in name else name


def metadata_json(kind: str, metadata: dict | None) -> str | None:
    """Metadata of a node as JSON text; fails where an entry has another type than its kind of node demands."""
    for name, wanted in S.METADATA_TYPES.get(kind, {}).items():
        value = (metadata or {}).get(name, ...)
        fits = isinstance(value, bool) if wanted == "boolean" else isinstance(value, numbers.Real) and not isinstance(value, bool)
        if value is not ... and not fits:
            raise ValueError(f"{kind} metadata: {name} must be {wanted}")
    return None if metadata is None else json.dumps(metadata, separators=(",", ":"), ensure_ascii=False)
