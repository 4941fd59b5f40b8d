"""Token counts, byte-level BPE round trips.

Both operators read a vocabulary file on the driver and broadcast its bytes (checked against
``MOST_BYTES``; a vocabulary doesn't grow with the data). Texts are worked on in slices of bounded
size, also inside one very long text. Null texts count as empty. Repeated rows, ties and further
columns pass through; a further column that has the name of an added one is replaced by it.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Backtracker, Encoder, Merger, Vocabulary, load_json, load_ranks, pieces, split
from .common import per_span, slices

MOST_BYTES = 64 << 20


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        content = f.read()
    if len(content) > MOST_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary may be")
    return content


def ship(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(vocabulary(path))


def ship_proved(spark: SparkSession, path: str):
    """Broadcast arguments of ``merging_encoder``: the vocabulary and its proof."""
    content = vocabulary(path)
    return spark.sparkContext.broadcast((content, proof(content)))


def extended(df: DataFrame, added: list[tuple[str, str]]) -> tuple[DataFrame, T.StructType]:
    """The frame without columns that the added ones replace (names compared as Spark does), and the new schema."""
    names = {n.lower() for n, _ in added}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t), True) for n, t in added)])
    return df, schema


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *added.values()], [*batch.schema.names, *added])


def provably_whole(vocab: Vocabulary) -> dict[bytes, int]:
    """Vocabulary strings that encode alone as one token: one match of the pattern, and merged to that token.

    Proved for each string by splitting it and merging its bytes, once, before any text is read.
    """
    found = {}
    for ident, token in vocab.tokens.items():
        try:
            token.decode("utf-8")
        except UnicodeDecodeError:
            continue  # never a whole match in a text
        found[token] = ident
    names = list(found)
    data = np.frombuffer(b"".join(names), np.uint8)
    lengths = np.array([len(b) for b in names], np.int64)
    bounds = np.append(np.cumsum(lengths) - lengths, len(data))
    single = np.diff(np.searchsorted(split(data, bounds[:-1]), bounds)) == 1
    _, counts = Merger(vocab)(data, bounds[:-1], lengths)
    ids, counts_at = _, np.cumsum(counts) - counts
    return {b: found[b] for k, b in enumerate(names) if single[k] and counts[k] == 1 and ids[counts_at[k]] == found[b]}


@cache
def proof(content: bytes) -> bytes:
    """Ids of the vocabulary strings that are provably whole, as 32-bit integers: made once on the driver, shipped to the workers."""
    return np.array(sorted(provably_whole(load_json(content.decode("utf-8"))).values()), np.int32).tobytes()


@cache
def merging_encoder(content: bytes, whole: bytes) -> tuple[Encoder, dict[bytes, int]]:
    """Encoder for a vocabulary and its ``proof``, and the special strings."""
    vocab = load_json(content.decode("utf-8"))
    sure = {vocab.tokens[i]: i for i in np.frombuffer(whole, np.int32).tolist()}
    return Encoder(Merger(vocab), sure), {k.encode(): v for k, v in vocab.specials.items()}


@cache
def backtracking_encoder(content: bytes) -> Encoder:
    return Encoder(Backtracker(load_ranks(content)))


def count_slice(encoder: Encoder, specials: dict[bytes, int], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each text: sure matches count one each; only the rest is merged."""
    out = np.zeros(len(offsets) - 1, np.int64)
    bounds, owner, ident = pieces(data, offsets, specials)
    for first, last in runs(bounds):
        part, cuts = data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        starts, lengths, hashes = encoder.matches(part, cuts)
        n = np.ones(len(starts), np.int64)
        rest = np.flatnonzero(encoder.whole(hashes) < 0)
        if len(rest):
            back, _, counts, _ = encoder.distinct(part, starts[rest], lengths[rest], hashes[rest])
            n[rest] = counts[back]
        counts = per_span(n, np.searchsorted(starts, cuts))
        np.add.at(out, owner[first:last], np.where(ident[first:last] >= 0, 1, counts))
    return out


def encode_slice(encoder: Encoder, specials: dict[bytes, int], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and the texts' offsets in them."""
    bounds, owner, ident = pieces(data, offsets, specials)
    parts, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for first, last in runs(bounds):
        ids, at = encoder.encode_all(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        n = np.diff(at)
        marked = np.flatnonzero(ident[first:last] >= 0)
        if len(marked):
            cut = [ids[at[k] : at[k + 1]] for k in range(last - first)]
            for k in marked:
                cut[k] = np.array([ident[first + k]], np.int32)
            ids, n = np.concatenate(cut), np.array([len(c) for c in cut])
        parts.append(ids)
        np.add.at(counts, owner[first:last], n)
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])


def runs(bounds: np.ndarray, limit: int = 4 << 20):
    """Runs of whole cuts with at most ``limit`` bytes, or one cut."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = min(max(int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1, first + 1), n)
        yield first, last
        first = last


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) to each row.

    Whole-token shortcut: matches that are proved to be one token are counted by a lookup; merges run only
    for the others, once for each distinct match that a worker remembers. Special strings of the file count
    as one token, as the library takes them by default. An empty table gives an empty result.
    """
    proved = ship_proved(df.sparkSession, path or tokenizer_file("byte_bpe_50k.json"))
    df, schema = extended(df, [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")])

    def run(batches):
        encoder, specials = merging_encoder(*proved.value)
        for batch in batches:
            for rows, data, offsets in slices(batch, text):
                n = count_slice(encoder, specials, data, offsets)
                yield with_columns(rows, {"n_bytes": pa.array(np.diff(offsets)), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    return df.mapInArrow(run, schema)


def encode_bytes(df: DataFrame, text: str = "text", path: str | None = None, ids: bool = True) -> DataFrame:
    """Adds n_tokens, ids (array of int, if asked for), ids_sha256 and decoded_sha256 to each row.

    Each distinct match is encoded by backtracking from longest matches; the ids are then decoded by the
    table of token bytes. ids_sha256 hashes the decimal ids joined by commas, decoded_sha256 the decoded bytes.
    """
    content = ship(df.sparkSession, path or tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    added = [("n_tokens", "long"), *([("ids", "array<int>")] if ids else []), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    df, schema = extended(df, added)

    def run(batches):
        encoder = backtracking_encoder(content.value)
        table = encoder.encode.tokens
        width = max(table) + 1
        bytes_of = [table.get(i, b"") for i in range(width)]
        digits = [b"%d" % i for i in range(width)]
        for batch in batches:
            for rows, data, offsets in slices(batch, text):
                flat, at = encode_slice(encoder, {}, data, offsets)
                names, decoded = [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = flat[a:b].tolist()
                    names.append(hashlib.sha256(b",".join([digits[i] for i in own])).hexdigest())
                    decoded.append(hashlib.sha256(b"".join([bytes_of[i] for i in own])).hexdigest())
                new = {"n_tokens": pa.array(np.diff(at))}
                if ids:
                    new["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
                yield with_columns(rows, new | {"ids_sha256": pa.array(names), "decoded_sha256": pa.array(decoded)})

    return df.mapInArrow(run, schema)
