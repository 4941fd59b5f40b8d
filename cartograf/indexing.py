"""Indexing of a workspace from end to end: listing, reading, extraction, patch, labels, revision, commit.

The listing and the paths of an update are on the driver, as they come from the workspace's own folder; contents are read
and parsed by the executors. All tools return what happened as a dict.
"""

from __future__ import annotations

import contextlib
import os
import threading
import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .extract import registry as extractors
from .operators import patch
from .sources import store as stores
from .sources import workspace
from .sources.shared import cut
from .sources.store import GraphStore
from .streaming.changes import graph_state, normalized

Progress = Callable[[int, int], None]
POLL_S = 0.2


def _now() -> int:
    return time.time_ns() // 1_000_000


@contextlib.contextmanager
def watched(spark: SparkSession, total: int, progress: Progress | None):
    """An accumulator of files done, reported as (current, total) while jobs run. An error raised by ``progress`` cancels them."""
    done = spark.sparkContext.accumulator(0)
    if progress is None:
        yield done
        return
    context, group, over, errors = spark.sparkContext, f"indexing-{time.time_ns()}", threading.Event(), []

    def report() -> None:
        told = 0
        while not over.wait(POLL_S):
            now = min(done.value, total)  # a task that ran twice counts twice
            if now > told:
                told = now
                try:
                    progress(now, total)
                except Exception as error:  # noqa: BLE001
                    errors.append(error)
                    context.cancelJobGroup(group)
                    return

    context.setJobGroup(group, "indexing of a workspace", interruptOnCancel=True)
    reporter = threading.Thread(target=report, daemon=True)
    reporter.start()
    try:
        yield done
    except Exception:
        if errors:
            raise errors[0] from None
        raise
    finally:
        over.set()
        reporter.join()
        context.setLocalProperty("spark.jobGroup.id", None)
    if errors:
        raise errors[0]
    progress(total, total)


def routed(files: DataFrame, registry: extractors.Registry) -> DataFrame:
    """Files that an extractor reads, with its language."""
    known = {ext: registry.route(f"/x{ext}") for ext in S.LANGUAGES}
    table = F.create_map(*[F.lit(v) for ext, language in known.items() if language for v in (ext, language)]) if any(known.values()) else None
    if table is None:
        return files.limit(0)
    ext = F.concat(F.lit("."), F.lower(F.element_at(F.split("path", r"\."), -1)))
    language = F.try_element_at(table, ext)
    if registry.get("c") is not None:
        language = F.when(ext.isin(*S.HEADERS) & F.contains("path", F.lit("/src/c/")), "c").otherwise(language)
    return files.withColumn("language", language).filter(F.col("language").isNotNull())


def index(store: GraphStore, root: str, paths: list[str] | None = None, registry: extractors.Registry = extractors.default, progress: Progress | None = None) -> dict[str, int]:
    """Bring the graph up to date with files of a workspace (all that the listing gives, if none are named).

    Files that are gone leave the graph with their nodes; files that no extractor reads are passed over. With nothing to
    write, neither the lock is taken nor a version made. The revision's hash covers the files of this run.
    """
    spark = store.spark
    asked = list(dict.fromkeys(paths)) if paths else workspace.list_files(root)
    present = [p for p in asked if os.path.isfile(p)]
    gone = sorted(set(asked) - set(present))
    now = _now()
    with watched(spark, len(asked), progress) as done:
        read = routed(workspace.read_files(spark, present), registry)
        nodes, edges = extractors.extract(read, registry, done)
        files = cut(read.drop("content").withColumn("last_indexed_at", F.lit(now)))
        count = files.count()
        if count or gone:
            deleted = spark.createDataFrame([(p,) for p in gone], "path string")
            with store.lock():
                over = store.version()
                graph = patch.apply_patch(store.graph(), files, nodes, edges, deleted)
                graph = patch.relabel(patch.settled(graph))
                revision = stores.revision_of(files, os.path.abspath(root), stores.git_commit(root), now)
                store.commit(graph, {r.key: r.value for r in revision.collect()}, over=over)  # four rows
    return {"files": count, "deleted": len(gone), "skipped": len(present) - count}


def init(store: GraphStore, root: str, force: bool = False, registry: extractors.Registry = extractors.default, progress: Progress | None = None) -> dict:
    """Index a whole workspace unless its graph is ready, or asks for an update only."""
    state, folder = graph_state(store), str(store.folder)
    if not force and state == "ready":
        return {"skipped": True, "state": state}
    if not force and state == "dirty":
        return {"skipped": True, "needsUpdate": True, "state": state, "dirtyFiles": stores.get_meta(folder)["dirtyFiles"]}
    counts = index(store, root, None, registry, progress)
    indexed_at = _now()
    stores.set_meta(folder, indexedAt=indexed_at, schemaVersion=S.SCHEMA_VERSION, dirtyFiles=[], lastUpdateReason=None)
    return {"initialized": True, "force": force, "schemaVersion": S.SCHEMA_VERSION, "indexedAt": indexed_at, **counts}


def update(store: GraphStore, root: str, files: list[str] | None = None, registry: extractors.Registry = extractors.default, progress: Progress | None = None) -> dict:
    """Index what has changed among the named files, else the dirty ones, else all that the graph tracks.

    Contents are compared by hash; files that are gone or unknown count as changed. Named files outside the root are left out.
    """
    spark, folder, base = store.spark, str(store.folder), os.path.abspath(root)
    inside = lambda names: [p for n in names if (p := normalized(n, base))]
    as_paths = lambda names: spark.createDataFrame([(p,) for p in dict.fromkeys(names)], "path string")
    stored = store.table("files")
    dirty = (stores.get_meta(folder) or stores.DEFAULT_META)["dirtyFiles"]
    targets = workspace.update_targets(as_paths(inside(files or [])), as_paths(inside(dirty)), stored).collect()  # as many as the workspace's paths
    if not targets:
        return {"updated": 0, "source": "none", "skipped": True}
    source, names = targets[0].source, [r.path for r in targets]
    present = [p for p in names if os.path.isfile(p)]
    current = workspace.read_files(spark, present).select("path", "hash")
    changed = {r.path for r in workspace.hash_diff(current, stored).collect()} | (set(names) - set(present))
    if not changed:
        stores.clear_dirty(folder, names)
        stores.set_meta(folder, indexedAt=_now(), lastUpdateReason=None)
        return {"updated": 0, "checked": len(names), "source": source, "skipped": True}
    index(store, root, sorted(changed), registry, progress)
    stores.clear_dirty(folder, names if source == "dirty" else sorted(changed))
    indexed_at = _now()
    stores.set_meta(folder, indexedAt=indexed_at, lastUpdateReason=None)
    return {"updated": len(changed), "checked": len(names), "source": source, "indexedAt": indexed_at}


def auto_index(store: GraphStore, root: str, notify: Callable[[str], None] = lambda _: None) -> Future | None:
    """Start of a session: index in the background where no graph (or one of another schema) is, and the folder is a project's."""
    state = graph_state(store)
    if state not in ("missing", "schema_mismatch") or not workspace.safe_to_index(root):
        return None
    Path(store.folder).mkdir(parents=True, exist_ok=True)
    pool = ThreadPoolExecutor(1, thread_name_prefix="indexing")
    future = pool.submit(init, store, root)
    future.add_done_callback(lambda f: notify("ready" if f.exception() is None else f"failed: {f.exception()}"))
    pool.shutdown(wait=False)
    return future
