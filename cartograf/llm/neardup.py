"""MinHash near-duplicates: SuperMinHash signatures, banding, exact confirmation, union-find groups.

SuperMinHash gives each shingle a random permutation of the signature's places and puts rank + noise
there; a place keeps its minimum. The ranks of one shingle are correlated (it takes every place once),
which lowers the variance of the estimate, and a document is done as soon as all its places hold a value
below the rank that comes next. Here all shingles of a block of documents take rank 0, then those of the
documents that aren't done rank 1, and so on: the same signatures as element by element, in a few array
operations a rank.

With BANDS bands of ROWS places a pair of similarity 0.8 shares no band with probability
(1 - 0.8^5)^48, about 5e-9. Documents that share a band are compared along a chain in random order
(another one in each band) and with its first member, so a group of g documents gives about 3 g pairs,
never g squared. Before anything is shuffled, equal sets in a block collapse into one, and a task that holds
more than REPS members of a band chains them itself and passes on REPS of them: a group of copies of any
size reaches a reducer as a few rows from each task. Links are confirmed on the full sets of shingles: two partners of
each document first, then those of the other pairs whose documents aren't in one group yet.

A chain holds all pairs of up to CHAINED members. Larger bands whose members aren't in one group by then are
open: there, the shared shingles of every two members of different groups are counted, block by block
(``overlaps``), and only pairs that are similar enough leave the block. A band of more than BLOCK members is
dealt out as pairs of blocks, so that no task holds more than two blocks of it at once. Thus the centre of a
star meets its copies, the links inside a family of texts around one template are found, and no pair that
shares a band is left out; what isn't similar makes no rows.

Null or wordless texts have no shingles and are linked with nothing. Rows that repeat a document id count
as one document. Rows with a null id get their size, no component, and stay. Sets are compared as 64-bit hashes of their shingles.
"""

from __future__ import annotations

from itertools import chain as chain_of

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_text, block_batch, blocks, by_bucket, counted, discard, materialise, mix64, ragged, raw, shuffle_partitions, slices, span_hashes, trim, unblock, words_at
from .components import components

BANDS, ROWS, REPS = 48, 5, 8
CHAINED = 4  # so many members are paired all with all by a chain
BLOCK = 1024  # members of a band that are compared with as many others at once
FEW = 32  # sets that hold an element, up to which it is counted by pairs
FIT = 100_000  # shingles whose permutations are held at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the texts' offsets in them."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    inside = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    h = span_hashes(words_at(_LOWER[data]), starts, ends - starts)
    words = np.searchsorted(starts, offsets)
    count = np.diff(words)
    chained, out = h * U64(0x9E3779B97F4A7C15), np.zeros(len(h), U64)
    left = np.repeat(words[1:], count) - np.arange(len(h))  # words from here to the end of the text
    is_first = np.zeros(len(h), bool)
    is_first[words[:-1][count > 0]] = True
    short = np.repeat(count, count) < size
    valid = (left >= size) | (short & is_first)
    at = np.flatnonzero(valid)
    steps = np.minimum(left[at], size)
    value = mix64(chained[at] + U64(1))
    for k in range(1, size):
        go = steps > k
        value[go] = mix64(value[go] * U64(0xD6E8FEB86659FD93) + h[at[go] + k] + U64(k))
    out = value
    bounds = np.searchsorted(at, words)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])
    return out[keep], total[bounds]


def super_minhash(elements: np.ndarray, offsets: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (documents x m) of non-empty sets; m is at most 256."""
    docs = len(offsets) - 1
    signature = np.full((docs, m), np.iinfo(np.uint64).max, U64)
    first = 0
    while first < docs:
        last = min(max(int(np.searchsorted(offsets, offsets[first] + FIT, "right")) - 1, first + 1), docs)
        for a in range(int(offsets[first]), int(offsets[last]), FIT):  # one very long document alone may take several turns
            b = min(int(offsets[last]), a + FIT) if last == first + 1 else int(offsets[last])
            _fill(signature[first:last], elements[a:b], np.repeat(np.arange(last - first), np.clip(np.diff(np.clip(offsets[first : last + 1], a, b)), 0, None)), m)
            if b == offsets[last]:
                break
        first = last
    return signature


def _fill(signature: np.ndarray, elements: np.ndarray, owner: np.ndarray, m: int) -> None:
    places = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(elements), m)).copy()
    flat = signature.reshape(-1)
    for rank in range(m):
        noise = mix64(elements + U64((rank + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        swap = rank + ((noise & U64(0xFFFFFFFF)) % U64(m - rank)).astype(np.int64)
        row = np.arange(len(elements))
        place = places[row, swap]
        places[row, swap] = places[:, rank]
        np.minimum.at(flat, owner * m + place, (U64(rank) << U64(32)) | (noise >> U64(32)))
        open_docs = signature.max(1) >= U64((rank + 1) << 32)
        go = open_docs[owner]
        if not go.any():
            return
        if not go.all():
            elements, owner, places = elements[go], owner[go], places[go]


def band_keys(signature: np.ndarray) -> np.ndarray:
    docs = len(signature)
    parts = signature.reshape(docs, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64) << U64(32), (docs, BANDS)).copy()
    for r in range(ROWS):
        key = mix64(key * U64(0x9FB21C651E98DF25) + parts[:, :, r])
    return key


def chain(key: np.ndarray, doc: np.ndarray, size: np.ndarray, least: float, reps: int | None):
    """Pairs among the members of each key, which rows to pass on, and which rows stay open: those not
    passed on, or without ``reps`` those of keys with more than CHAINED members.

    Members stand in a random order that differs from key to key; each is paired with the next two and with the first.
    """
    order = np.lexsort((mix64(doc.astype(U64) * U64(0xD6E8FEB86659FD93) ^ key), key))
    key, doc, size = key[order], doc[order], size[order]
    n = len(key)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    nth = np.arange(n) - head
    count = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
    busy = count > (reps or 1)
    pairs = []
    for other, go in ((np.arange(n) - 1, nth >= 1), (np.arange(n) - 2, nth >= 2), (head, nth >= 3)):
        at = np.flatnonzero(go & busy)
        pairs.append((at, other[at]))
    i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    a, b = np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])
    good = (a != b) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]))
    pairs = np.unique(np.stack([a[good], b[good]], 1), axis=0) if good.any() else np.zeros((0, 2), np.int64)
    return pairs, (order[nth < reps] if reps else None), order[nth >= reps] if reps else order[count > CHAINED]


def confirmed(batches, size: int, percent: int):
    """Keeps the pairs whose full sets are similar enough."""
    for batch in batches:
        sets = []
        for column in ("ta", "tb"):
            once = as_text(batch.column(column)).dictionary_encode()  # a text that stands in many pairs is read once
            data, offsets = raw(once.dictionary)
            own: list[np.ndarray] = []
            first, n = 0, len(once.dictionary)
            while first < n:  # in slices, so that the arrays stay small
                last = min(max(int(np.searchsorted(offsets, offsets[first] + (2 << 20), "right")) - 1, first + 1), n)
                elements, at = shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], size)
                own += [elements[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                first = last
            sets.append([own[k] for k in once.indices.to_pylist()])
        keep = []
        for a, b in zip(*sets, strict=True):
            both = np.concatenate([a, b])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(a) + len(b) - common) and common > 0)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()


def overlaps(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of elements that every two of some sets share: by pairs where few sets hold an element, else by matrix products."""
    m = len(offsets) - 1
    owner = np.repeat(np.arange(m), np.diff(offsets))
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    at = np.flatnonzero(np.concatenate([np.ones(1, bool), elements[1:] != elements[:-1]])) if len(elements) else np.zeros(0, np.int64)
    held = np.diff(np.append(at, len(elements)))
    shared = np.zeros((m, m), np.float32)
    few = np.flatnonzero((held > 1) & (held <= FEW))
    for a in range(0, len(few), 20_000):
        own = few[a : a + 20_000]
        rows = ragged(at[own], held[own])
        ahead = np.repeat(at[own] + held[own], held[own]) - rows - 1
        i, j = owner[np.repeat(rows, ahead)], owner[ragged(rows + 1, ahead)]
        shared += np.bincount(i * m + j, minlength=m * m).reshape(m, m).astype(np.float32) if len(i) * 4 > m * m else _added(i, j, m)
    many = np.flatnonzero(held > FEW)
    for a in range(0, len(many), 2048):
        own = many[a : a + 2048]
        has = np.zeros((m, len(own)), np.float32)
        has[owner[ragged(at[own], held[own])], np.repeat(np.arange(len(own)), held[own])] = 1
        shared += has @ has.T
    return np.maximum(shared, shared.T)


def _added(i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros(m * m, np.float32)
    at, n = np.unique(i * m + j, return_counts=True)
    out[at] = n
    return out.reshape(m, m)


def alike(block: np.ndarray, many: np.ndarray, group: np.ndarray, elements: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of one part that are similar enough, of different groups and, where the part holds two blocks, of different blocks."""
    shared = overlaps(elements, offsets)
    good = np.triu(100 * shared >= percent * (many[:, None] + many[None, :] - shared), 1) & (shared > 0) & (group[:, None] != group[None, :])
    if block.min() != block.max():
        good &= block[:, None] != block[None, :]
    return np.nonzero(good)


def wide_members(wide: DataFrame, kinds: list) -> DataFrame:
    """band, doc, many out of blocks."""

    def rows(batches):
        for batch in batches:
            for body in batch.column("body").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in unblock([body], kinds)], ["band", "doc", "many"])

    return wide.mapInArrow(rows, "band long, doc long, many long")


def crossing(members: DataFrame, groups: DataFrame, texts: DataFrame, size: int, percent: int, n: int) -> DataFrame:
    """a, b: pairs of two groups that share one of the wide bands and are similar by 32-bit hashes of their shingles.

    ``members`` holds band, doc, many (size); ``texts`` doc_id, text. Equal hashes of different shingles can only
    add pairs, which don't outlast confirmation.
    """

    of = groups.select(F.col("node").alias("doc"), "component")
    own = materialise(members.join(of, "doc", "left").select("band", "doc", "many", F.coalesce("component", "doc").alias("group")), "near-wide")
    bands = own.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count(F.lit(1)).alias("m")).filter("low <> high")
    cut = bands.select("band", F.ceil(F.col("m") / BLOCK).cast("int").alias("cuts"))
    dealt = own.join(cut, "band").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("cuts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    part = F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other"))
    dealt = materialise(dealt.select(part.alias("part"), "block", "doc", "many", "group"), "near-open")
    discard(own)
    names = ["block", "many", "group", "doc"]

    def hashed(batches):
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                elements, at = shingle_sets(data, offsets, size)
                short = elements.astype(np.uint32)  # the low half
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([short[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["doc", "set"])

    def compare(batches):
        held: list[pa.RecordBatch] = []
        for batch in chain_of(batches, (None,)):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if not held or batch is not None and sum(b.num_rows for b in held) < 4 * BLOCK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            part = table.column("part").to_numpy()
            stop = len(part) if batch is None else int(np.searchsorted(part, part[-1], "left"))  # the last part may go on
            held = [b for b in table.slice(stop).to_batches() if b.num_rows]
            if not stop:
                continue
            table = table.slice(0, stop)
            block, many, group, doc = (table.column(c).to_numpy() for c in names)
            data, offsets = raw(table.column("set").combine_chunks())
            elements, offsets = np.frombuffer(data.tobytes(), np.uint32), offsets // 4
            pairs: list[np.ndarray] = []
            bounds = np.flatnonzero(np.concatenate([np.ones(1, bool), part[1:stop] != part[: stop - 1], np.ones(1, bool)]))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                i, j = alike(block[a:b], many[a:b], group[a:b], elements[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], percent)
                pairs.append(np.sort(np.stack([doc[a:b][i], doc[a:b][j]], 1), axis=1))
            found = np.unique(np.concatenate(pairs), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
            trim()

    open_ = texts.select(F.col("doc_id").alias("doc"), "text").join(dealt.select("doc").distinct(), "doc", "left_semi")
    sets = open_.mapInArrow(hashed, "doc long, set binary")
    found = dealt.join(sets, "doc").select("part", *names, "set").repartition(n, "part").sortWithinPartitions("part").mapInArrow(compare, "a long, b long")
    found = materialise(found.distinct(), "near-crossing")
    discard(dealt)
    return found


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (is that document) of each row.

    Documents are linked if 100 x intersection >= percent x union of their sets of ``size``-word shingles.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    least = percent / 100
    schema = "kind int, a long, b long, bucket int, body binary"
    kinds = [np.uint64, np.int64, np.int64]

    def batch_of(kind, a, b):
        m = len(a)
        return pa.RecordBatch.from_arrays([pa.array([kind] * m, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], ["kind", "a", "b", "bucket", "body"])

    def sign(batches):
        held: list[list[np.ndarray]] = [[], [], [], []]  # band keys, documents, sizes; set hashes with documents
        exact: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            out = []
            if held[0]:
                band, doc, many = (np.concatenate(x) for x in held[:3])
                pairs, rest, local = chain(band, doc, many, least, REPS)
                if len(pairs):
                    yield batch_of(1, pairs[:, 0], pairs[:, 1])
                out += blocks((band[rest] % U64(n)).astype(np.int32), [band[rest], doc[rest], many[rest]])
                if len(local):
                    out += [(2 * n, body) for _, body in blocks(np.zeros(len(local), np.int32), [band[local], doc[local], many[local]])]
            if exact:
                one, two, doc = (np.concatenate(x) for x in zip(*exact, strict=True))
                out += [(n + k, body) for k, body in blocks((one % U64(n)).astype(np.int32), [one, two.view(np.int64), doc])]
            if out:
                got = block_batch(out)
                m = got.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([2] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *got.columns], ["kind", "a", "b", "bucket", "body"])
            for x in held:
                x.clear()
            exact.clear()
            trim()

        volume = 0
        for batch in batches:
            for own, data, offsets in slices(batch, "text"):
                elements, at = shingle_sets(data, offsets, size)
                many, ids = np.diff(at), own.column("doc_id")
                yield pa.RecordBatch.from_arrays([pa.array([0] * own.num_rows, pa.int32()), ids, pa.array(many), pa.nulls(own.num_rows, pa.int32()), pa.nulls(own.num_rows, pa.binary())], ["kind", "a", "b", "bucket", "body"])
                full = np.flatnonzero((many > 0) & ids.is_valid().to_numpy(zero_copy_only=False))
                if not len(full):
                    continue
                doc = ids.fill_null(0).to_numpy()[full]
                sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix64(elements ^ U64(c)))]) for c in (0, 0x5851F42D4C957F2D)]
                one, two = (mix64(s[at[full + 1]] - s[at[full]] + many[full].astype(U64)) for s in sums)
                order = np.lexsort((doc, two, one))
                new = np.ones(len(order), bool)
                new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
                head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
                rest = doc[order] != doc[head]
                if rest.any():
                    yield batch_of(3, doc[head][rest], doc[order][rest])
                reps = np.sort(order[new])
                spans = full[reps]
                lengths = many[spans]
                flat = elements[np.repeat(at[spans] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]
                keys = band_keys(super_minhash(flat, np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])))
                held[0].append(keys.ravel())
                held[1].append(np.repeat(doc[reps], BANDS))
                held[2].append(np.repeat(lengths, BANDS))
                exact.append((one[reps], two[reps], doc[reps]))
                volume += len(reps)
                if volume >= 20_000:
                    yield from flush()
                    volume = 0
        yield from flush()

    signed = materialise(rows.mapInArrow(sign, schema), "near-signatures")

    def meet(bodies):
        band, doc, many = unblock(bodies, kinds)
        pairs, _, wide = chain(band, doc, many, least, None)
        m = len(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64()), pa.array([False] * m, pa.bool_()), pa.nulls(m, pa.binary())], ["a", "b", "sure", "body"])
        if len(wide):
            held = [body for _, body in blocks(np.zeros(len(wide), np.int32), [band[wide], doc[wide], many[wide]])]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.array(held, pa.binary())], ["a", "b", "sure", "body"])

    def same(bodies):
        one, two, doc = unblock(bodies, kinds)
        order = np.lexsort((doc, two, one))
        one, two, doc = one[order], two[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        head = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
        rest = head != doc
        yield pa.RecordBatch.from_arrays([pa.array(head[rest], pa.int64()), pa.array(doc[rest], pa.int64()), pa.array([True] * int(rest.sum()), pa.bool_())], ["a", "b", "sure"])

    # buckets below n hold bands, those below 2 n equal sets, the last one what tasks don't pass on
    dealt = signed.filter("kind = 2").select("bucket", "body")
    met = materialise(by_bucket(dealt.filter(F.col("bucket") < n), n, meet, "a long, b long, sure boolean, body binary"), "near-met")
    bands = met.filter("body is null").select("a", "b", "sure")
    equal = by_bucket(dealt.filter((F.col("bucket") >= n) & (F.col("bucket") < 2 * n)), n, same, "a long, b long, sure boolean")
    wide = dealt.filter(F.col("bucket") == 2 * n).select("body").unionByName(met.filter("body is not null").select("body"))
    local = signed.filter("kind in (1, 3)").select("a", "b", (F.col("kind") == 3).alias("sure"))
    pairs = materialise(local.unionByName(bands).unionByName(equal).groupBy("a", "b").agg(F.max("sure").alias("sure")), "near-pairs")
    unsure, members = pairs.filter("not sure").select("a", "b"), materialise(wide_members(wide, kinds), "near-members")
    sizes = materialise(signed.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles")), "near-sizes")
    for used in (signed, met):  # the largest tables; what is left of them is written
        discard(used)
    # texts are dealt out once; what follows reads only those that some other document may be like
    wanted = materialise(unsure.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(members.select(F.col("doc").alias("doc_id"))).distinct(), "near-wanted")
    texts = materialise(rows.filter("doc_id is not null and text is not null").join(counted(wanted), "doc_id", "left_semi"), "near-texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def confirm(asked):
        both = asked.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
        return both.mapInArrow(lambda batches: confirmed(batches, size, percent), "a long, b long")

    # two partners of each document first; of the other pairs only those that aren't joined by then
    drawn = F.struct(F.xxhash64("a", "b").alias("h"), F.col("a").alias("a"))
    first = unsure.groupBy("b").agg(F.min(drawn).alias("one"), F.max(drawn).alias("two")).select(F.explode(F.array_distinct(F.array("one.a", "two.a"))).alias("a"), "b")
    early = materialise(confirm(first).unionByName(pairs.filter("sure").select("a", "b")), "near-links")
    known = components(early)
    of_a = known.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = known.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    apart = unsure.join(of_a, "a", "left").join(of_b, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    late = materialise(confirm(apart.join(first, ["a", "b"], "left_anti")), "near-links")
    joined = known.select(F.col("node").alias("a"), F.col("component").alias("b"))
    groups = components(late.unionByName(joined))
    crossed = crossing(members, groups, texts, size, percent, n)
    cross = materialise(confirm(crossed.join(unsure, ["a", "b"], "left_anti")), "near-links")
    if not cross.isEmpty():
        was, groups = groups, components(cross.unionByName(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        discard(was)
    out = sizes.join(groups, sizes.doc_id == groups.node, "left").drop("node")
    component = F.coalesce("component", "doc_id")
    done = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    done = materialise(done, "near-groups")  # so that what is larger can go
    for used in (sizes, members, pairs, wanted, texts, early, known, late, crossed, cross, groups):
        discard(used)
    return done
