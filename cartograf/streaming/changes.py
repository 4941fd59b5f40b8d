"""Change events: which tool calls make which files dirty, as a batch and as a stream; the state of a graph."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..schemas import LANGUAGES, SCHEMA_VERSION
from ..sources.store import GraphStore, get_meta

# Parts of tool names that write, and parameters that hold paths.
WRITE_WORDS = ("write", "edit", "create", "save", "patch", "replace", "rename", "move", "delete", "remove")
PATH_PARAMS = ("path", "file", "filename", "target", "dest", "destination")


def write_like(tool) -> F.Column:
    return F.lower(X.col(tool)).rlike("|".join(WRITE_WORDS))


def is_source(path) -> F.Column:
    """One list of source extensions for detection and events."""
    return X.extension(path).isin(*LANGUAGES)


def normalized(path: str, root: str) -> str | None:
    """Absolute form of a path inside a root; None if it lies outside."""
    full = posixpath.normpath(path if path.startswith("/") else f"{root}/{path}")
    root = posixpath.normpath(root)
    return full if full == root or full.startswith(root.rstrip("/") + "/") else None


def dirty_paths(events: DataFrame, root: str, own_tools: str = "graph_") -> DataFrame:
    """path of source files that write-like events name inside a root.

    events: tool_name, params (map of strings), files, paths (arrays of strings). Works on a stream as well.
    """
    root = root.rstrip("/")
    named = F.array_compact(F.array(*[F.element_at("params", k) for k in PATH_PARAMS]))
    every = F.concat(named, F.coalesce("files", F.array().cast("array<string>")), F.coalesce("paths", F.array().cast("array<string>")))
    touched = events.filter(write_like("tool_name") & ~F.col("tool_name").startswith(own_tools)).select(F.explode(every).alias("path")).filter(F.trim("path") != "")
    full = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(root + "/"), "path"))
    # as posixpath.normpath: "" and "." go, ".." takes the segment before it, at any depth
    walk = lambda kept, x: F.when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(x.isin("", "."), kept).otherwise(F.concat(kept, F.array(x)))
    full = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), walk), "/"))
    return touched.select(full.alias("path")).filter(X.contained("path", root) & is_source("path"))


def dirty_set(events: DataFrame, root: str) -> DataFrame:
    return dirty_paths(events, root).distinct()


def tool_events(events: DataFrame) -> DataFrame:
    """Tool calls out of the generic event table: purchases and signups write, one file for each user."""
    tool = F.when(F.col("event_type") == "purchase", "write_file").when(F.col("event_type") == "signup", "create_file").otherwise(F.concat(F.lit("read_"), "event_type"))
    ext = F.element_at(F.array(*[F.lit(e) for e in (".ts", ".py", ".rs", ".md", ".cpp")]), (F.pmod(F.col("user_id"), F.lit(5)) + 1).cast("int"))
    path = F.concat(F.lit("src/u"), F.pmod(F.col("user_id"), F.lit(97)).cast("string"), ext)
    empty = F.array().cast("array<string>")
    return events.select(tool.alias("tool_name"), F.create_map(F.lit("path"), path).alias("params"), empty.alias("files"), empty.alias("paths"))


def dirty_stream(stream: DataFrame, root: str, watermark: str | None = None) -> DataFrame:
    """First occurrences of dirty paths of a stream of events; the state is the set of paths seen."""
    return dirty_paths(stream, root).dropDuplicates(["path"])


def run_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append a stream's new rows to a Parquet folder until its source is exhausted."""
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def graph_state(store: GraphStore) -> str:
    """missing, schema_mismatch, dirty, corrupted or ready; asked in this order."""
    meta = get_meta(str(store.folder))
    if meta is None:
        return "missing"
    if meta.get("schemaVersion") != SCHEMA_VERSION:
        return "schema_mismatch"
    if meta.get("dirtyFiles"):
        return "dirty"
    return "ready" if store.version() else "corrupted"
