"""Shared plumbing: text buffers out of Arrow, block-wise shuffles, shared-folder tables."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

SLICE_BYTES = 2 << 20
U64 = np.uint64


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again, so that what follows doesn't depend on executors' disks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote, once no later read needs them."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


MOST_SENT = 1 << 20  # numbers that a broadcast may hold (16 MB)


def counted(ids: DataFrame) -> DataFrame:
    """A table of one number a row (already written), to be broadcast if it has no more than MOST_SENT rows; else joins shuffle."""
    return F.broadcast(ids) if ids.count() <= MOST_SENT else ids


def trim() -> None:
    """Give freed memory back: Python workers stay for later stages, and would keep the most they ever held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser over 64-bit words (wrapping arithmetic)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def as_text(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pc.fill_null(values.cast(pa.large_string()), "")


def raw(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array (nulls must be filled): data, and n + 1 offsets into it."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    body = values.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with at most ``limit`` bytes of text (or one row): rows, bytes, offsets."""
    if not batch.num_rows:
        return
    data, offsets = raw(as_text(batch.column(column)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words_at(data: np.ndarray) -> np.ndarray:
    """Little-endian 64-bit word that starts at each byte; data gets eight zero bytes behind it."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


TAIL = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], U64)


def span_hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step; spans still open shrink the arrays."""
    h = mix64(lengths.astype(U64) + U64(0x9E3779B97F4A7C15 + seed))
    todo, at, rest = np.arange(len(starts)), starts.astype(np.int64), lengths.astype(np.int64)
    while len(todo):
        part = words[at] & TAIL[np.minimum(rest, 8)]
        h[todo] = mix64((h[todo] ^ part) * U64(0x9FB21C651E98DF25) + U64(1))
        more = rest > 8
        todo, at, rest = todo[more], at[more] + 8, rest[more] - 8
    return h


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all spans, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def per_span(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive offsets; empty spans give 0."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


BLOCKS = "bucket int, body binary"


def blocks(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Rows with the same bucket as one compressed body: count, then each column's bytes. Cuts the rows of a shuffle."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        body = np.int64(b - a).tobytes() + b"".join(np.ascontiguousarray(c[a:b]).tobytes() for c in columns)
        yield int(bucket[a]), len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unblock(bodies: Iterable[bytes], kinds: list) -> list[np.ndarray]:
    """The columns of all bodies, one after the other; kinds: dtypes, as ``blocks`` got them."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for packed in bodies:
        body = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
        n, at = int(np.frombuffer(body, np.int64, 1)[0]), 8
        for k, kind in enumerate(kinds):
            kind = np.dtype(kind)
            parts[k].append(np.frombuffer(body, kind, n, at))
            at += n * kind.itemsize
    return [np.concatenate(p) if p else np.zeros(0, np.dtype(kind)) for p, kind in zip(parts, kinds, strict=True)]


def volume(bodies: Iterable[bytes]) -> int:
    """Bytes of all bodies, decompressed."""
    return sum(int.from_bytes(packed[:8], "little") for packed in bodies)


def block_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "body"])


def by_bucket(df: DataFrame, n: int, work: Callable[[list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Deal blocks out by bucket (0 to n - 1) and give ``work`` all bodies of each bucket."""

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(key, []).append(body)
        for key in sorted(held):
            yield from work(held.pop(key))
            trim()

    return df.repartition(n, "bucket").mapInArrow(run, schema)
