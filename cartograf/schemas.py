"""Tables of a code graph and their vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

NODES = (
    T.StructType()
    .add("id", STRING, False)
    .add("kind", STRING, False)
    .add("name", STRING, False)
    .add("language", STRING)
    .add("qualified_name", STRING)
    .add("file_path", STRING)
    .add("start_line", INT)
    .add("end_line", INT)
    .add("hash", STRING)
    .add("summary", STRING)
    .add("metadata_json", STRING)
    .add("domain", STRING)
    .add("subsystem", STRING)
    .add("cluster_id", STRING)
    .add("centrality_score", DOUBLE)
)
EDGES = (
    T.StructType()
    .add("id", STRING, False)
    .add("from_id", STRING, False)
    .add("to_id", STRING, False)
    .add("kind", STRING, False)
    .add("confidence", DOUBLE)
    .add("metadata_json", STRING)
    .add("source_file", STRING)
    .add("source_start_line", INT)
    .add("source_end_line", INT)
)
FILES = (
    T.StructType()
    .add("path", STRING, False)
    .add("hash", STRING)
    .add("mtime", LONG)
    .add("language", STRING)
    .add("last_indexed_at", LONG)
    .add("symbol_count", INT)
    .add("edge_count", INT)
    .add("domain", STRING)
    .add("subsystem", STRING)
    .add("centrality_score", DOUBLE)
)
DOCS = T.StructType().add("name", STRING, False).add("content", STRING).add("updated_at", LONG)
METADATA = T.StructType().add("key", STRING, False).add("value", STRING)
TABLES = {"nodes": NODES, "edges": EDGES, "files": FILES, "docs": DOCS, "graph_metadata": METADATA}
KEYS = {"nodes": "id", "edges": "id", "files": "path", "docs": "name", "graph_metadata": "key"}
SCHEMA_VERSION = 2

# They must equal the vocabularies that existing graphs use.
STRUCTURAL = ("contains", "defines")
ARCHITECTURE = (
    "calls", "imports", "depends_on", "references", "reads", "writes", "extends", "implements",
    "handles", "routes_to", "publishes", "subscribes", "spawns", "waits_for", "owns", "sends_message_to",
)
DIRECTIONS = {
    "calls": "caller -> callee",
    "imports": "importer -> imported",
    "references": "referrer -> referenced",
    "extends": "child -> parent",
    "implements": "implementation -> interface",
    "contains": "container -> child",
    "defines": "definer -> defined",
    "owns": "owner -> owned",
    "spawns": "parent -> child",
    "waits_for": "waiter -> awaited",
    "depends_on": "dependent -> dependency",
    "reads": "reader -> resource",
    "writes": "writer -> resource",
    "handles": "handler -> message_or_request",
    "routes_to": "router -> destination",
    "publishes": "publisher -> topic_or_message",
    "subscribes": "subscriber -> topic_or_message",
    "sends_message_to": "sender -> recipient",
}
WEIGHTS = {"calls": 3.0, "depends_on": 3.0, "implements": 3.0, "extends": 3.0, "imports": 2.0, "references": 2.0, "reads": 1.5, "writes": 1.5, "publishes": 1.5, "subscribes": 1.5, "routes_to": 1.5, "handles": 1.5}
NOT_RANKED = ("file", "variable", "type", "enum", "message", "queue", "topic")
RECOMMENDABLE = ("class", "function", "method", "module", "trait", "service", "tool", "flow", "process")
THIRD_PARTY = ("thirdparty", "third-party", "3rdparty", "vendor", "external", "extern", "deps", "dependencies", "submodules", "generated")
DOMAINS = ("runtime", "tools", "graph", "parsing", "orchestration", "indexing", "protocol", "core", "media", "ui", "app", "frontend", "frontends", "backend")
# types that entries of a node's metadata must have, by kind of node
FUNCTION_METADATA = {"async": "boolean", "exported": "boolean"}
METADATA_TYPES = {"function": FUNCTION_METADATA, "method": FUNCTION_METADATA, "class": {"abstract": "boolean"}, "topic": {"retain": "boolean", "qos": "number"}}
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".rs": "rust", ".py": "python",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c++": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".h": "cpp",
    ".c": "c",
}
HEADERS = (".h", ".hpp", ".hh", ".hxx")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order; those that an older table lacks are null, others are left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
