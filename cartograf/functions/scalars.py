"""Scalar functions on columns: paths, names, labels, scores. All run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Lower case of A to Z only."""
    return F.translate(col(c), ASCII_UPPER, ASCII_LOWER)


# paths


def segments(path: Column | str) -> Column:
    return F.filter(F.split(col(path), "/"), lambda s: s != "")


def basename(path: Column | str) -> Column:
    return F.coalesce(F.try_element_at(segments(path), F.lit(-1)), F.lit(""))


def dirname(path: Column | str) -> Column:
    p = col(path)
    cut = F.regexp_replace(p, r"/+[^/]*/*\z", "")
    return F.when(~p.contains("/"), ".").when((cut == "") & p.startswith("/"), "/").otherwise(cut)


def extension(path: Column | str) -> Column:
    """Lower-cased text from the last point on; the whole text if there is none."""
    return F.lower(F.concat(F.when(col(path).contains("."), ".").otherwise(""), F.try_element_at(F.split(col(path), r"\."), F.lit(-1))))


def language_of(path: Column | str) -> Column:
    pairs = [F.lit(x) for pair in S.LANGUAGES.items() for x in pair]
    return F.element_at(F.create_map(*pairs), extension(path))


def is_header(path: Column | str) -> Column:
    return extension(path).isin(*S.HEADERS)


def third_party(path: Column | str) -> Column:
    """Whether a directory of the path is one of those for foreign code; null paths aren't."""
    names = "|".join(S.THIRD_PARTY)
    return F.coalesce(F.lower(F.replace(col(path), F.lit("\\"), F.lit("/"))).rlike(f"/({names})/"), F.lit(False))


def domain_of(path: Column | str, parity: bool = True) -> Column:
    """Last segment that is a known domain; else, with ``parity``, the segment before the first ``src``, without it the one after the last; else ``workspace``."""
    parts = segments(path)
    known = F.try_element_at(F.filter(parts, lambda s: s.isin(*S.DOMAINS)), F.lit(-1))
    if parity:
        at = F.array_position(parts, "src")
        other = F.when(at > 1, F.get(parts, (at - 2).cast("int")))
    else:
        back = F.array_position(F.reverse(parts), "src")
        other = F.when(back > 1, F.get(F.reverse(parts), (back - 2).cast("int")))
    return F.coalesce(known, other, F.lit("workspace"))


def subsystem_of(path: Column | str) -> Column:
    """Up to three segments from the last ``src`` on; else the last three."""
    parts = segments(path)
    back = F.array_position(F.reverse(parts), "src")
    start = F.when(back > 0, F.size(parts) - back + 1).otherwise(F.greatest(F.size(parts) - 2, F.lit(1))).cast("int")
    return F.array_join(F.slice(parts, start, F.lit(3)), "/")


def cluster_of(domain: Column | str, subsystem: Column | str) -> Column:
    return F.concat(col(domain), F.lit(":"), col(subsystem))


def contained(path: Column | str, root: str) -> Column:
    """Whether a normalised path lies under a root (or is the root)."""
    root = root.rstrip("/")
    return (col(path) == root) | col(path).startswith(root + "/")


# names

# The steps that normalise a name, in the order in which they apply.
_STRIPS = (
    (r"\A[\"'`]", ""),
    (r"[\"'`]\z", ""),
    (r"\Aawait[\s ﻿]+", ""),
    (r"\Anew[\s ﻿]+", ""),
    (r"\Athis\.", ""),
    (r"\Athis->", ""),
    (r"\Aself\.", ""),
    (r"\Aself->", ""),
    (r"\Acrate::", ""),
    (r"\Asuper::", ""),
    (r"\A&", ""),
    (r"\A::", ""),
    (r"\(\)", ""),
    (r"->", "."),
    (r"::\{.*\}\z", ""),
    (r"\(.*\)\z", ""),
)
_BLANKS = r"\A[\s ﻿]+|[\s ﻿]+\z"


def normalize_target(raw: Column | str) -> Column:
    """A callee or type as a plain name: quotes, keywords, receivers, calls and trailing groups stripped, once each, in order."""
    out = F.regexp_replace(col(raw), _BLANKS, "")
    for pattern, by in _STRIPS:
        out = F.regexp_replace(out, pattern, by)
    return F.regexp_replace(out, _BLANKS, "")


def symbol_candidates(raw: Column | str) -> Column:
    """The normalised name and its last part at points, ``::`` and slashes; distinct, none empty."""
    name = normalize_target(raw)
    last = [F.when(F.size(F.split(name, sep)) > 1, F.try_element_at(F.split(name, sep), F.lit(-1))) for sep in (r"\.", "::", "/")]
    return F.filter(F.array_distinct(F.array(name, *last)), lambda s: s.isNotNull() & (s != ""))


TYPE_NAME = r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9_]*(?![A-Za-z0-9_])"
# Names that each dialect doesn't count as references.
TYPE_STOPS = {
    "python": ("True", "False", "None", "self", "cls", "Optional", "List", "Dict", "Set", "Tuple"),
    "rust": ("Self", "Option", "Result", "Vec", "String", "Box", "Arc", "Rc", "Some", "None", "Ok", "Err"),
    "c": ("struct", "union", "enum", "typedef", "const", "static", "inline", "extern", "return", "void", "int", "long", "short", "float", "double", "bool", "char", "unsigned", "signed", "size_t"),
    "cpp": (
        "class", "struct", "enum", "public", "private", "protected", "virtual", "override", "const", "constexpr", "static", "inline", "typename", "template", "return",
        "void", "int", "long", "short", "float", "double", "bool", "char", "unsigned", "signed", "namespace", "signals", "slots", "emit",
    ),
}


def type_references(text: Column | str, dialect: str = "python") -> Column:
    """Distinct capitalised names in order of appearance, without the dialect's stop list."""
    found = F.array_distinct(F.regexp_extract_all(col(text), F.lit(f"({TYPE_NAME})"), F.lit(1)))
    return F.array_except(found, F.array(*[F.lit(s) for s in TYPE_STOPS[dialect]]))


VERBS = (
    ("reads", "read|get|load|fetch"),
    ("writes", "write|save|set|store|append|update"),
    ("publishes", "publish|emit|dispatch|send"),
    ("subscribes", "subscribe|listen|consume|observe"),
    ("routes_to", "route|forward|redirect"),
)


def semantic_verbs(callee: Column | str) -> Column:
    """Edge kinds that a callee's name hints at; several may hold."""
    low = F.lower(col(callee))
    return F.filter(F.array(*[F.when(low.rlike(words), kind) for kind, words in VERBS]), lambda s: s.isNotNull())


def capitalize(c: Column | str) -> Column:
    return F.concat(F.upper(F.substring(col(c), 1, 1)), F.substr(col(c), F.lit(2)))


def diagram_id(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^a-zA-Z0-9]", "_")


# edges and scores


def is_architecture(kind: Column | str = "kind") -> Column:
    return ~col(kind).isin(*S.STRUCTURAL)


def listed_architecture(kind: Column | str = "kind") -> Column:
    return col(kind).isin(*S.ARCHITECTURE)


def edge_weight(kind: Column | str = "kind") -> Column:
    pairs = [F.lit(x) for pair in S.WEIGHTS.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(kind)), F.lit(1.0))


def direction(kind: Column | str = "kind") -> Column:
    pairs = [F.lit(x) for pair in S.DIRECTIONS.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(kind)), F.lit("source -> target"))


def present(c: Column | str) -> Column:
    return F.coalesce(col(c) != "", F.lit(False))


def bonus(condition: Column, points: float) -> Column:
    return F.when(condition, F.lit(float(points))).otherwise(0.0)


def decision_score(centrality: Column | str = "centrality") -> Column:
    """Of a node: centrality, points for each label it has, a large malus for foreign code."""
    score = col(centrality).cast("double") + bonus(present("domain"), 2) + bonus(present("subsystem"), 1) + bonus(present("summary"), 1) + bonus(present("qualified_name"), 0.5)
    return score - bonus(third_party("file_path"), 100)


def file_decision_score(path: Column | str = "path", centrality: Column | str = "centrality") -> Column:
    return col(centrality).cast("double") + bonus(present("domain"), 2) + bonus(present("subsystem"), 1) - bonus(third_party(path), 100)


def recommendable() -> Column:
    path = F.col("file_path")
    return F.col("kind").isin(*S.RECOMMENDABLE) & present(path) & ~path.rlike("(?i)test|spec") & ~third_party(path) & ~F.lower("name").isin("new", "main", "default", "helper")


def progress(current: Column | str, total: Column | str) -> Column:
    return F.when(col(total) == 0, 0).otherwise(F.floor(col(current) / col(total) * 100 + 0.5)).cast("int")


def iso_timestamp(millis: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(col(millis)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_stale(millis: Column | str, now: int, threshold: int = 60_000) -> Column:
    return F.lit(now) - col(millis) > threshold


def line_count(text: Column | str) -> Column:
    return F.size(F.split(col(text), "\n", -1))


# metadata of nodes

_VARIANTS = {"boolean": "BOOLEAN", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT"}


def metadata_problem(kind: Column | str, metadata: Column | str) -> Column:
    """What is wrong with a node's metadata (JSON text); null if nothing is. An entry with the value null is wrong, a missing one isn't."""
    value = F.try_parse_json(col(metadata))
    problem = F.when(col(metadata).isNotNull() & value.isNull(), F.lit("metadata is no JSON"))
    for of, entries in S.METADATA_TYPES.items():
        for name, wanted in entries.items():
            found = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
            problem = problem.when((col(kind) == of) & ~found.rlike(f"^({_VARIANTS[wanted]})"), F.lit(f"{of} metadata: {name} must be {wanted}"))
    return problem
