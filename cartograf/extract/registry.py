"""Pluggable extractors: a registry by language, and extraction as a table function over files."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..sources.shared import cut
from . import clike, python_source, rust, typescript
from .builder import Builder

Extractor = Callable[[str, str], Builder]


class Registry:
    """Extractors by language; registering a language again replaces what was there."""

    def __init__(self):
        self.by_language: dict[str, Extractor] = {}

    def register(self, language: str, extractor: Extractor) -> None:
        self.by_language[language] = extractor

    def get(self, language: str) -> Extractor | None:
        return self.by_language.get(language)

    def languages(self) -> list[str]:
        return sorted(self.by_language)

    def route(self, path: str, language: str | None = None) -> str | None:
        """Language whose extractor reads a file; headers below ``/src/c/`` are C."""
        end = "." + path.rpartition(".")[2].lower()
        found = language or S.LANGUAGES.get(end)
        if end in S.HEADERS and "/src/c/" in path:
            found = "c"
        return found if found in self.by_language else None


default = Registry()
for _language, _extractor in {"typescript": typescript.parse, "python": python_source.parse, "rust": rust.parse, "c": clike.parse_c, "cpp": clike.parse_cpp}.items():
    default.register(_language, _extractor)

_EDGE_ONLY = ("from_id", "to_id", "confidence", "source_file", "source_start_line", "source_end_line")
_ROW = "row string, id string, kind string, name string, language string, qualified_name string, file_path string, start_line int, end_line int, hash string, metadata_json string, from_id string, to_id string, confidence double, source_file string, source_start_line int, source_end_line int, message string"


def extract_rows(files: DataFrame, registry: Registry = default, done: Accumulator | None = None) -> DataFrame:
    """Tagged rows (node, edge, skipped, failed) of files (path, language, content). One bad file doesn't stop the others.

    ``done`` counts the files of finished tasks.
    """
    names = [f.split(" ")[0] for f in _ROW.split(", ")]
    types = [pa.string() if f.endswith("string") else pa.float64() if f.endswith("double") else pa.int32() for f in _ROW.split(", ")]

    def run(batches):
        for batch in batches:
            rows: list[dict] = []
            for path, language, content in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content")), strict=True):
                if done is not None:
                    done.add(1)
                chosen = registry.route(path or "", language)
                if chosen is None or content is None:
                    rows.append({"row": "skipped", "file_path": path, "message": "no content" if content is None else "no extractor"})
                    continue
                try:
                    built = registry.get(chosen)(path, content)
                except Exception as error:  # noqa: BLE001
                    rows.append({"row": "failed", "file_path": path, "message": f"{type(error).__name__}: {error}"})
                    continue
                rows += [{"row": "node", **n} for n in built.nodes] + [{"row": "edge", **e} for e in built.edges]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return files.select("path", "language", "content").mapInArrow(run, _ROW)


def extract(files: DataFrame, registry: Registry = default, done: Accumulator | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of files; each file is parsed once."""
    rows = cut(extract_rows(files, registry, done))
    return S.conform(rows.filter(F.col("row") == "node"), S.NODES), S.conform(rows.filter(F.col("row") == "edge"), S.EDGES)
