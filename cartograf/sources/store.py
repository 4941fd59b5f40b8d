"""Graph snapshots: versioned Parquet folders, one pointer that names the current one, a writer's lock.

A commit writes all tables of a new version and then renames the pointer into place, so readers see the old
graph or the new one and a crash leaves the old one. A commit holds the writer's lock, and one whose graph came from
a version that is no longer the current one is refused. Edges are partitioned by kind: kind filters prune folders.
The pointer, the metadata file and the lock live beside the tables and are handled on the driver.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import subprocess
import threading
import time
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from .derived import Graph

# How long a lock lives untouched, how often its holder touches it, and how a writer waits for it.
STALE_S, REFRESH_S, RETRIES, WAIT_S, MOST_WAIT_S = 60, 5, 20, 0.25, 2.0
CURRENT = object()


class StaleGraph(RuntimeError):
    """Another writer has committed since a graph was read."""


class LostLock(RuntimeError):
    """Another writer has taken the lock over."""


class Held:
    """A lock file that bears its holder's token and is touched by a thread while it is held."""

    def __init__(self, path: Path):
        self.path, self.token = path, uuid.uuid4().hex
        self._over = threading.Event()

    def take(self) -> bool:
        try:
            handle = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        os.write(handle, self.token.encode())
        os.close(handle)
        threading.Thread(target=self._refresh, daemon=True).start()
        return True

    def mine(self) -> bool:
        try:
            return self.path.read_text() == self.token
        except FileNotFoundError:
            return False

    def check(self) -> None:
        if not self.mine():
            raise LostLock(f"{self.path} is another writer's by now")

    def _refresh(self) -> None:
        while not self._over.wait(REFRESH_S) and self.mine():
            with contextlib.suppress(FileNotFoundError):
                os.utime(self.path)

    def release(self) -> None:
        self._over.set()
        if self.mine():
            self.path.unlink(missing_ok=True)


def evict(path: Path) -> None:
    """Take a stale lock away. It is moved first: one that was renewed in between goes back."""
    aside = path.with_name(f"{path.name}.{uuid.uuid4().hex}")
    with contextlib.suppress(FileNotFoundError):
        if time.time() - path.stat().st_mtime <= STALE_S:
            return
        os.rename(path, aside)
        if time.time() - aside.stat().st_mtime <= STALE_S:
            with contextlib.suppress(FileExistsError):
                os.link(aside, path)
        aside.unlink()


class GraphStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)
        self._held: Held | None = None

    def version(self) -> str | None:
        pointer = self.folder / "_CURRENT"
        return pointer.read_text().strip() if pointer.exists() else None

    def table(self, name: str) -> DataFrame:
        """A table of the current version, brought to today's columns; empty if there is none."""
        schema, version = S.TABLES[name], self.version()
        path = self.folder / (version or "-") / name
        if not path.exists():
            return self.spark.createDataFrame([], schema)
        return S.conform(self.spark.read.parquet(f"file://{path.resolve()}"), schema)

    def graph(self) -> Graph:
        return Graph(self.table("nodes"), self.table("edges"), self.table("files"))

    def node(self, ident: str) -> DataFrame:
        return self.table("nodes").filter(F.col("id") == ident)

    def file(self, path: str) -> DataFrame:
        return self.table("files").filter(F.col("path") == path)

    def commit(self, graph: Graph, revision: dict[str, str | None] | None = None, docs: DataFrame | None = None, over: str | None | object = CURRENT) -> str:
        """Write a graph as the new current version, under the lock; ``over`` is the version that the graph was made from."""
        if self._held is None:
            with self.lock():
                return self.commit(graph, revision, docs, over)
        if over is not CURRENT and over != self.version():
            raise StaleGraph(f"made from {over}, but {self.version()} is current")
        version = f"v{time.time_ns()}"
        target = self.folder / version
        metadata = self.table("graph_metadata") if revision is None else self.spark.createDataFrame([(k, "" if v is None else str(v)) for k, v in revision.items()], S.METADATA)
        tables = {"nodes": graph.nodes, "edges": graph.edges, "files": graph.files, "docs": docs if docs is not None else self.table("docs"), "graph_metadata": metadata}
        for name, df in tables.items():
            writer = S.conform(df, S.TABLES[name]).write
            (writer.partitionBy("kind") if name == "edges" else writer).parquet(f"file://{(target / name).resolve()}")
        pending = self.folder / f"_CURRENT.{version}"
        pending.write_text(version)
        self._held.check()
        os.replace(pending, self.folder / "_CURRENT")
        return version

    def revision(self) -> dict[str, str] | None:
        """The four revision entries; None if one of the needed ones is missing."""
        found = self.table("graph_metadata").groupBy().pivot("key", ["graphRevision", "indexedAt", "indexedCommit", "workspaceId"]).agg(F.first("value")).first()
        got = found.asDict() if found else {}
        return got if all(got.get(k) for k in ("graphRevision", "workspaceId", "indexedAt")) else None

    @contextlib.contextmanager
    def lock(self):
        """Exclusive right to write, kept fresh while held; a lock whose holder hasn't touched it for a minute is taken over."""
        self.folder.mkdir(parents=True, exist_ok=True)
        held, wait = Held(self.folder / "_LOCK"), WAIT_S
        for attempt in range(RETRIES + 1):
            evict(held.path)
            if held.take():
                break
            if attempt == RETRIES:
                raise TimeoutError(f"{held.path} is held by another writer")
            time.sleep(wait)
            wait = min(wait * 1.5, MOST_WAIT_S)
        self._held = held
        try:
            yield held
        finally:
            self._held = None
            held.release()


def git_commit(folder: str) -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True, timeout=10, check=True).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def hash_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def build_revision(workspace: str, commit: str | None, now_ms: int, hashes: list[str]) -> dict[str, str | None]:
    owner = hash_text(workspace)
    return {"graphRevision": hash_text(f"{owner}:{commit or 'no-git'}:{now_ms}:{','.join(sorted(hashes))}"), "indexedCommit": commit, "workspaceId": owner, "indexedAt": str(now_ms)}


def revision_of(files: DataFrame, workspace: str, commit: str | None, now_ms: int) -> DataFrame:
    """key, value rows of a revision. Its hash runs over all files' hashes in order, so one task reads them (64 bytes a
    file, sorted on disk where need be); no row holds more than one."""
    owner = hash_text(workspace)
    head = f"{owner}:{commit or 'no-git'}:{now_ms}:"

    def run(batches):
        digest, first = hashlib.sha256(head.encode()), True
        for batch in batches:
            for value in batch.column(0).to_pylist():
                digest.update(value.encode() if first else b"," + value.encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["revision"])

    hashes = files.select("hash").filter(F.col("hash").isNotNull()).repartition(1).sortWithinPartitions("hash")
    found = hashes.mapInArrow(run, "revision string").agg(F.coalesce(F.max("revision"), F.lit(hash_text(head))).alias("revision"))
    entries = F.create_map(F.lit("graphRevision"), F.col("revision"), F.lit("indexedCommit"), F.lit(commit or ""), F.lit("workspaceId"), F.lit(owner), F.lit("indexedAt"), F.lit(str(now_ms)))
    return found.select(F.explode(entries).alias("key", "value"))


DEFAULT_META = {"schemaVersion": S.SCHEMA_VERSION, "indexedCommit": None, "indexedAt": 0, "dirtyFiles": [], "lastUpdateReason": None}


def get_meta(folder: str) -> dict | None:
    try:
        return json.loads((Path(folder) / "meta.json").read_text())
    except (OSError, ValueError):
        return None


def set_meta(folder: str, **changes) -> dict:
    meta = DEFAULT_META | (get_meta(folder) or {}) | changes
    Path(folder).mkdir(parents=True, exist_ok=True)
    pending = Path(folder) / "meta.json.new"
    pending.write_text(json.dumps(meta, indent=2))
    os.replace(pending, Path(folder) / "meta.json")
    return meta


def mark_dirty(folder: str, files: list[str]) -> dict:
    return set_meta(folder, dirtyFiles=list(dict.fromkeys([*(get_meta(folder) or DEFAULT_META)["dirtyFiles"], *files])))


def clear_dirty(folder: str, files: list[str] | None = None) -> list[str]:
    """Forget all or some dirty files; what is left."""
    cleared = None if files is None else set(files)
    left = [f for f in (get_meta(folder) or DEFAULT_META)["dirtyFiles"] if cleared is not None and f not in cleared]
    set_meta(folder, dirtyFiles=left, lastUpdateReason="partial update remaining" if left else None)
    return left
