"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of documents. In each round the queues are visited in order; a queue's deficit counter grows
by its quantum, its share of ``TURN`` of a window, and the queue gives as many tokens as the counter holds whole ones; the
rest, a fraction of a token, is carried into the next round. Windows of ``window`` tokens are filled from these turns one
after the other: a turn that a window's end cuts off goes on in the next window. So every window holds the target
proportions but for one turn of each queue, and an empty queue leaves its share to the others.

Quanta are fixed-point numbers of FRACTION bits, so before round r a queue has given the whole part of r x quantum, or
all it holds (``Mixture.served``), and the counter holds the rest. Any task thus takes up the very deficits with which the
windows of another partition ended, without walking through the rounds before its own. In a window each queue's tokens
stand together. All sequences but the last are full.

By default the target proportions are the sources' own shares of all tokens. Null texts count as empty
(one token, the end id), null sources form a queue of their own, rows that repeat are packed each. Every source
is a queue; of more than ``MOST_QUEUES`` the ones without a target share that many queues, whose weight is the sum of
theirs. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, slices
from .tokens import encode_slice, merging_encoder, ship_proved, tokenizer_file

MOST_QUEUES = 1 << 16
TURN = 16  # rounds a window
FRACTION = 16  # bits of a quantum behind the point


class Mixture:
    """Deficit round-robin over queues of ``totals`` tokens: who has given what before any place of the packed stream."""

    def __init__(self, totals: list[int], weights: list[int], window: int):
        self.totals, self.window, self.total = np.array(totals, np.int64), window, sum(totals)
        turn, share = max(1, window // TURN), max(1, sum(weights))
        self.quantum = np.array([max(1, (w * turn << FRACTION) // share) for w in weights], np.int64)
        #: the round after which a queue is empty
        self.dry = np.array([-(-(t << FRACTION) // int(q)) for t, q in zip(totals, self.quantum, strict=True)], np.int64)
        self.last = 0  # round found last; the next one is near
        self.kept: OrderedDict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = OrderedDict()
        self.keep = max(2, (1 << 21) // max(1, len(totals)))

    def served(self, r: int) -> np.ndarray:
        """Tokens that each queue has given in the first r rounds."""
        return np.minimum(self.totals, (np.minimum(r, self.dry) * self.quantum) >> FRACTION)

    def deficits(self, r: int) -> np.ndarray:
        """Deficit counters before round r, in 2^-FRACTION tokens; empty queues have none."""
        return np.where(r < self.dry, r * self.quantum - (self.served(r) << FRACTION), 0)

    def round_at(self, position: int) -> int:
        """Round in which the stream reaches a position below the total."""
        before = lambda r: int(self.served(r).sum()) <= position
        low, step = self.last, 1
        while not before(low):
            low, step = max(0, low - step), step * 2
        high, step = low + 1, 1
        while before(high):
            low, high, step = high, high + step, step * 2
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if before(mid) else (low, mid)
        self.last = low
        return low

    def given(self, position: int) -> np.ndarray:
        """Of each queue, how many of the first ``position`` tokens are its own."""
        if position >= self.total:
            return self.totals
        r = self.round_at(position)
        done = self.served(r)
        turn = self.served(r + 1) - done
        return done + np.clip(position - done.sum() - (np.cumsum(turn) - turn), 0, turn)

    def at(self, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each queue has given before and after window w, and where its tokens begin in it."""
        if w not in self.kept:
            begin = self.kept[w - 1][1] if w - 1 in self.kept else self.given(w * self.window)
            end = self.given((w + 1) * self.window)
            self.kept[w] = begin, end, np.cumsum(end - begin) - (end - begin)
            if len(self.kept) > self.keep:
                self.kept.popitem(last=False)
        self.kept.move_to_end(w)
        return self.kept[w]

    def find(self, queue: int, i: int) -> int:
        """Window of token i of a queue."""
        r = -(-((i + 1) << FRACTION) // int(self.quantum[queue])) - 1
        done = self.served(r)
        turn = self.served(r + 1)[:queue] - done[:queue]
        return (int(done.sum()) + int(turn.sum()) + i - int(done[queue])) // self.window


def queue_name(df: DataFrame, source: str, targets: dict[str, int] | None) -> F.Column:
    """Name of the queue of each row; counts the sources first, up to one more than the bound."""
    name = F.col(source).cast("string")
    own = F.concat(F.lit("="), name)
    if df.select(name).distinct().limit(MOST_QUEUES + 1).count() > MOST_QUEUES:
        shared = F.concat(F.lit("#"), F.pmod(F.xxhash64(name), F.lit(MOST_QUEUES)).cast("string"))
        own = F.when(name.isin(*targets), own).otherwise(shared) if targets else F.when(name.isNotNull(), shared)
    return F.coalesce(own, F.lit("null"))


def weights_of(df: DataFrame, totals: dict[str, int], targets: dict[str, int] | None) -> dict[str, int]:
    """Weight of each queue: what it holds, or its target (1 without one; for shared queues the number of their sources)."""
    if targets is None:
        return totals
    out = {q: max(1, int(targets.get(q[1:], 1))) if q[0] == "=" else 1 for q in totals}
    if any(q[0] == "#" for q in totals):
        shared = df.filter(F.col("queue").startswith("#")).groupBy("queue").agg(F.count_distinct("source").alias("n"))
        out |= {r.queue: r.n for r in shared.collect()}  # at most MOST_QUEUES rows
    return out


def pack(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    window: int = 2048,
    end_id: int = 1,
    targets: dict[str, int] | None = None,
    path: str | None = None,
    ids: bool = True,
) -> DataFrame:
    """One row per piece: key, start, length, ids (if asked for), ids_crc32, doc_tokens, sequence_id, offset.

    ``targets`` gives sources whole-number weights (others get 1); without it a source weighs what it holds.
    """
    spark = df.sparkSession
    proved = ship_proved(spark, path or tokenizer_file("byte_bpe_50k.json"))
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), queue_name(df, source, targets).alias("queue"), F.col(source).cast("string").alias("source"))

    def encode(batches):
        encoder, specials = merging_encoder(*proved.value)
        part, given = TaskContext.get().partitionId(), {}
        for batch in batches:
            for own, data, offsets in slices(batch, "text"):
                flat, at = encode_slice(encoder, specials, data, offsets)
                kind = np.uint16 if max(end_id, int(flat.max(initial=0))) < 65536 else np.uint32
                starts, lengths, bodies = [], [], []
                for q, a, b in zip(own.column("queue").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    starts.append(given.get(q, 0))
                    lengths.append(b - a + 1)
                    given[q] = starts[-1] + lengths[-1]
                    bodies.append(np.append(flat[a:b], end_id).astype(kind).tobytes())
                n = own.num_rows
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("queue"), pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(bodies, pa.binary())],
                    ["doc_id", "queue", "part", "start", "doc_tokens", "body"],
                )

    encoded = materialise(rows.drop("source").mapInArrow(encode, "doc_id long, queue string, part int, start long, doc_tokens long, body binary"), "pack-ids")
    held = encoded.groupBy("queue", "part").agg(F.sum("doc_tokens").alias("n"))
    order = W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)
    bases = materialise(held.select("queue", "part", (F.sum("n").over(order) - F.col("n")).alias("base"), "n"), "pack-bases")
    totals = {r.queue: r.n for r in bases.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # a row for each queue: at most MOST_QUEUES, targets and one
    names, weights = sorted(totals), weights_of(rows, totals, targets)
    plan = spark.sparkContext.broadcast(({q: k for k, q in enumerate(names)}, [totals[q] for q in names], [weights[q] for q in names]))  # of that many numbers

    def cut(batches):
        place, sizes, shares = plan.value
        mixture = Mixture(sizes, shares, window)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, name, base, start, n, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "queue", "base", "start", "doc_tokens", "body")), strict=True):
                q, at = place[name], base + start
                tokens = np.frombuffer(body, np.uint16 if len(body) == 2 * n else np.uint32).astype("<u4").tobytes()
                w, done = mixture.find(q, at), 0
                while done < n:
                    before, after, offsets = mixture.at(w)
                    first = int(before[q])
                    length = min(int(after[q]) - (at + done), n - done)
                    if length > 0:
                        own = tokens[4 * done : 4 * (done + length)]
                        row = (doc, done, length, own, zlib.crc32(own), n, w, int(offsets[q]) + at + done - first)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                        done += length
                    w += 1
                if len(out[0]) >= 20_000:
                    yield pieces_batch(out, ids)
                    out = [[] for _ in range(8)]
            if out[0]:
                yield pieces_batch(out, ids)

    joined = encoded.join(bases.select("queue", "part", "base"), ["queue", "part"])
    return joined.select("doc_id", "queue", "base", "start", "doc_tokens", "body").mapInArrow(
        cut, "doc_id long, start long, length long" + ", ids array<int>" * ids + ", ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def pieces_batch(out: list[list], ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    arrays = [pa.array(c, pa.int64()) for k, c in enumerate(out) if k != 3]
    names.remove("ids")
    if ids:
        flat = np.frombuffer(b"".join(out[3]), "<u4").astype(np.int32)
        at = np.concatenate([[0], np.cumsum(out[2])]).astype(np.int32)
        arrays.insert(3, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)))
        names.insert(3, "ids")
    return pa.RecordBatch.from_arrays(arrays, names)
