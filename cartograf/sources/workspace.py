"""Workspace as a source: listing with ignore rules, text and hashes of files, change detection."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X

DEFAULT_IGNORES = (".git", "node_modules", "dist", "build", ".graph")
# What marks a folder as a project, and folders that are never indexed unasked.
MARKERS = (
    ".git", "package.json", "Cargo.toml", "go.mod", "requirements.txt", "pyproject.toml", "pom.xml", "build.gradle", "Makefile", "CMakeLists.txt", "WORKSPACE",
    "deno.json", "pnpm-workspace.yaml", "flake.nix", "Gemfile", "Project.toml", "mix.exs", "rebar.config", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock",
)
SYSTEM_TREES = ("/etc", "/usr", "/bin", "/sbin", "/lib", "/var", "/opt", "/dev", "/proc", "/sys", "/tmp", "c:\\windows", "c:\\program files", "c:\\program files (x86)")
# how many levels below a folder are barred with it: roots alone, the homes in their folder, whole system trees
BARRED = {"/": 0, "c:\\": 0, "/root": 0, "/home": 1, "/users": 1} | dict.fromkeys(SYSTEM_TREES, float("inf"))


class Ignore:
    """Rules of a .gitignore file: later ones win, ``!`` takes back, ``/`` inside anchors, a trailing one means folders."""

    def __init__(self, lines: list[str]):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in lines:
            line = line.rstrip("\r\n")
            line = line if line.endswith("\\ ") else line.rstrip(" ")
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line.removeprefix("\\")
            folder, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.lstrip("/")
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + self._regex(line) + r"\Z"), keep, folder))

    @staticmethod
    def _regex(glob: str) -> str:
        out, i = "", 0
        while i < len(glob):
            c = glob[i]
            if glob.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif glob.startswith("/**", i) and i + 3 == len(glob):
                out, i = out + "/.+", i + 3
            elif c == "*":
                out, i = out + "[^/]*", i + 1
            elif c == "?":
                out, i = out + "[^/]", i + 1
            elif c == "[" and (end := glob.find("]", i + 2)) > 0:
                out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            else:
                out, i = out + re.escape(c), i + 1
        return out

    def __call__(self, path: str, folder: bool) -> bool:
        hit = False
        for pattern, keep, only_folders in self.rules:
            if (folder or not only_folders) and pattern.match(path):
                hit = not keep
        return hit


def list_files(root: str) -> list[str]:
    """Absolute paths of regular files, ignored folders not entered, unreadable ones skipped. Only the root's .gitignore counts."""
    base = Path(root).resolve()
    lines = list(DEFAULT_IGNORES)
    if (base / ".gitignore").is_file():
        lines += (base / ".gitignore").read_text(errors="replace").splitlines()
    ignored, out = Ignore(lines), []
    for folder, folders, names in os.walk(base):
        inside = Path(folder).relative_to(base).as_posix()
        rel = lambda n, at=inside: n if at == "." else f"{at}/{n}"
        folders[:] = sorted(d for d in folders if not ignored(rel(d), True) and not os.path.islink(f"{folder}/{d}"))
        out += [f"{folder}/{n}" for n in sorted(names) if not ignored(rel(n), False) and os.path.isfile(f"{folder}/{n}") and not os.path.islink(f"{folder}/{n}")]
    return out


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, mtime (ms), hash (SHA-256 of the bytes), language, content of files, read by the executors."""
    if not paths:
        return spark.createDataFrame([], "path string, mtime long, hash string, language string, content string")
    raw = spark.read.format("binaryFile").load([f"file://{p}" for p in paths])
    path = F.regexp_replace("path", r"\Afile:/*", "/")
    text = F.decode(F.expr("try_validate_utf8(cast(content as string))").cast("binary"), "UTF-8")
    return raw.select(path.alias("path"), F.unix_millis("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), "content").select(
        "path", "mtime", "hash", X.language_of("path").alias("language"), F.coalesce(text, F.col("content").cast("string")).alias("content")
    )


def deleted_files(asked: DataFrame, listing: DataFrame) -> DataFrame:
    """Of the asked-for paths those that the listing lacks."""
    return asked.select("path").distinct().join(listing.select("path"), "path", "left_anti")


def hash_diff(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """path, status (new, changed) of files that need an update: unknown, unreadable (no hash) or with another hash."""
    old = stored.select("path", F.col("hash").alias("old_hash"), F.lit(True).alias("known"))
    joined = listing.select("path", "hash").join(old, "path", "left")
    need = F.col("known").isNull() | ~X.present("hash") | ~F.col("hash").eqNullSafe(F.col("old_hash"))
    return joined.filter(need).select("path", F.when(F.col("known").isNull(), "new").otherwise("changed").alias("status"))


def update_targets(explicit: DataFrame, dirty: DataFrame, tracked: DataFrame) -> DataFrame:
    """path, source of the first non-empty of three sets of paths: asked for, dirty, tracked."""
    every = [df.select("path").distinct().withColumns({"source": F.lit(name), "rank": F.lit(k)}) for k, (name, df) in enumerate((("explicit", explicit), ("dirty", dirty), ("tracked", tracked)))]
    union = every[0].unionByName(every[1]).unionByName(every[2])
    first = union.agg(F.min("rank").alias("first"))
    return union.join(F.broadcast(first), union.rank == first["first"]).select("path", "source")  # one row


def safe_to_index(folder: str) -> bool:
    """Whether a folder looks like a project and isn't a root, a home or a system folder: no folder above it bars its level."""
    place = Path(os.path.abspath(folder))
    barred = BARRED | {os.path.abspath(home).lower(): 0 for home in (os.environ.get("HOME"), os.environ.get("USERPROFILE")) if home and os.path.abspath(home).lower() not in BARRED}
    upwards = (str(p).lower() for p in (place, *place.parents))
    return all(level > barred.get(p, -1) for level, p in enumerate(upwards)) and any((place / m).exists() for m in MARKERS)
