"""Removal of repeated passages with a sparse, distributed suffix array.

A byte goes if it is covered by a ``width``-byte string that also starts in a document with a smaller id.

Suffixes start at leading tokens: each window of ``width`` bytes names the 16-byte token in it with the
smallest hash (the leftmost of equals). Equal windows name the same token at the same place, so every
repeat shows up among suffixes that start with one token, and about one byte in seventeen starts a suffix.

1. Copies of whole texts are told by hash: all but the smallest document go as a whole, if long enough.
2. Tokens are grouped by hash; tokens of one document only need no further look.
3. The suffixes of the others, with the bytes of the windows that named them, are range-partitioned by
   their leading bytes at splitters taken from a sample. Splitters are whole leading words, so no two
   suffixes on either side of one share a token: the comparison across a boundary can find nothing.
   Equal ones in a block collapse into that of the smallest document before the shuffle.
4. Each bucket sorts its suffixes, and its reversed left contexts, by multikey quicksort with eight-byte
   characters, a run of its leading tokens of about PILE bytes after the other (the rest stays compressed, so
   the memory of a task doesn't follow the volume of its bucket); common prefix lengths of neighbours then give the classes of equal windows, and each
   class its smallest document.

Tokens that many sampled documents hold are hot: they skip step 2 (they are known to be shared) and their
suffixes are cut in three with cores of at least 39 bytes, dealt out by a hash of the core, so that a
common phrase with many contexts is spread over buckets. The sample decides where rows go, not what is found.

Null texts are empty. Rows with a null id keep all their bytes and count for no other document. Rows that
repeat an id count as one document (their own bytes don't remove each other). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, block_batch, blocks, by_bucket, mix64, ragged, shuffle_partitions, slices, span_hashes, trim, unblock, volume, words_at
from .tokens import extended

TOKEN = 16
SMALL = 4096  # rows of a run that quicksort doesn't cut further
PILE = 16 << 20  # bytes of suffixes that are sorted at once
SHOWN = 24 << 20  # bytes of suffixes that a task holds before it deals them out
HOT = 8  # of the sampled documents that hold a hot token, at least


def slide(a: np.ndarray, window: int, f) -> np.ndarray:
    """f over all windows, by doubling."""
    size = 1
    while size * 2 <= window:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[: len(a) - (window - size)], a[window - size :]) if size < window else a


def suffixes(data: np.ndarray, offsets: np.ndarray, width: int):
    """Owner, token place, first and last window start, token hash of each run of windows that name one token."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none, none.astype(U64)
    words = words_at(data)
    n = len(data) - TOKEN + 1
    h = mix64(mix64(words[:n]) * U64(0x9FB21C651E98DF25) + words[8 : 8 + n])
    least = slide((h & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64), width - TOKEN + 1, np.minimum)
    named = (least & U64(0xFFFFFFFF)).astype(np.int64)
    long = np.flatnonzero(np.diff(offsets) >= width)
    if not len(long):
        return none, none, none, none, none.astype(U64)
    change = np.zeros(len(named) + 1, np.int8)
    change[offsets[long]] += 1
    change[offsets[long + 1] - width + 1] -= 1
    valid = np.cumsum(change[:-1], dtype=np.int8) > 0
    new = np.ones(len(named), bool)
    new[1:] = (named[1:] != named[:-1]) | ~valid[:-1]
    new[offsets[long]] = True
    first = np.flatnonzero(valid & new)
    ended = np.ones(len(named), bool)
    ended[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(valid & ended)
    place = named[first]
    return np.searchsorted(offsets, first, "right") - 1, place, first, last, h[place]


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows by their words, by multikey quicksort.

    A run of rows that agree on the words before is cut in three at a pivot of its next word; those that equal the pivot
    go on with the word after it. Runs of up to SMALL rows are finished together (``finished``).
    """
    order, depth = np.arange(len(words)), words.shape[1]
    small, todo = np.zeros(len(words), bool), [(0, len(words), 0)]  # where the small runs begin; runs with the word they are at
    while todo:
        a, b, j = todo.pop()
        if a == b:
            continue
        if j == depth or b - a <= SMALL:
            small[a] = True
            continue
        rows = order[a:b]
        own = words[rows, j]
        pivot = np.sort(own[:: (b - a) // 9])[4]  # of nine
        less, more = own < pivot, own > pivot
        low, high = a + int(less.sum()), b - int(more.sum())
        order[a:b] = np.concatenate([rows[less], rows[~(less | more)], rows[more]])
        todo += [(a, low, j), (low, high, j + 1), (high, b, j)]
    return finished(words, order, np.cumsum(small))


def finished(words: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """``order`` with the rows of each group put in the order of their words, word by word: only what still ties goes on."""
    at, group = np.arange(len(order)), group.copy()
    for j in range(words.shape[1] if len(order) else 0):
        own = words[order[at], j]
        by = np.lexsort((own, group))
        order[at], own, group = order[at[by]], own[by], group[by]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (own[1:] != own[:-1])
        alone = new & np.append(new[1:], True)
        group = np.cumsum(new)[~alone]
        at = at[~alone]
        if not len(at):
            break
    return order


def prefix_order(bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings of one length, and common prefix lengths with the one before."""
    n, m = bytes_.shape
    padded = np.zeros((n, -(-m // 8) * 8), np.uint8)
    padded[:, :m] = bytes_
    order = multikey_order(padded.view(">u8").astype(U64))
    common = np.zeros(n, np.int64)
    for a in range(1, n, 1 << 18):
        b = min(n, a + (1 << 18))
        differ = bytes_[order[a:b]] != bytes_[order[a - 1 : b - 1]]
        at = differ.argmax(1)
        common[a:b] = np.where(differ[np.arange(b - a), at], at, m)
    return order, common


def repeated(context: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with windows that a smaller document holds too; smallest and largest such window, as distance to the token.

    ``context`` has the token at column ``reach``; low to high are the distances of a row's own windows.
    """
    reach = width - TOKEN
    n = len(context)
    lowest, highest = np.full(n, width, np.int64), np.full(n, -1, np.int64)
    if n:
        right, right_common = prefix_order(context[:, reach:])
        left, left_common = prefix_order(context[:, :reach][:, ::-1])
        of_right, of_left = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for o in range(reach + 1):
            on = np.flatnonzero((low <= o) & (o <= high))
            if len(on) < 2:
                continue
            of_right[right] = np.cumsum(right_common < width - o)
            of_left[left] = np.cumsum(left_common < o)
            kind = of_right[on] * (n + 1) + of_left[on]
            order = np.argsort(kind, kind="stable")
            kind, own = kind[order], doc[on[order]]
            new = np.ones(len(on), bool)
            new[1:] = kind[1:] != kind[:-1]
            least = np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
            hit = on[order[own > least]]
            lowest[hit] = np.minimum(lowest[hit], o)
            highest[hit] = o
    found = np.flatnonzero(highest >= 0)
    return found, lowest[found], highest[found]


def contexts(data: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """Bytes of the windows from first to last around each token, zero where no own window reaches."""
    reach = width - TOKEN
    columns = np.arange(reach + width)
    at = place[:, None] - reach + columns
    inside = (at >= first[:, None]) & (at < last[:, None] + width)
    return np.where(inside, data[np.clip(at, 0, max(len(data) - 1, 0))], 0).astype(np.uint8)


def sample_tokens(rows: DataFrame, width: int, documents: int, most: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Leading words of suffixes of about ``documents`` documents, and hot tokens; ``most`` smallest hashes of each."""
    total = rows.count()
    share = min(1.0, documents / max(total, 1))

    def run(batches):
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                owner, place, *_, token = suffixes(data, offsets, width)
                order = np.lexsort((token, owner))
                owner, place, token = owner[order], place[order], token[order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])
                owner, place, token = owner[new], place[new], token[new]
                nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
                keep = nth < most
                lead = words_at(data)[place[keep]].byteswap()
                yield pa.RecordBatch.from_arrays([pa.array(lead.view(np.int64)), pa.array(token[keep].view(np.int64))], ["lead", "token"])

    drawn = (rows.sample(share, seed=11) if share < 1 else rows).select("text").limit(2 * documents)
    got = drawn.mapInArrow(run, "lead long, token long").toArrow()  # at most 2 x documents x most rows
    lead = np.sort(got.column("lead").to_numpy().view(U64))
    token, counts = np.unique(got.column("token").to_numpy().view(U64), return_counts=True)
    return lead, token[counts >= HOT]


def per_document(messages: DataFrame, n: int) -> DataFrame:
    """One row for each document: doc_id, rid and the joined bodies of its messages (blocks of doc, rid, 64-bit values)."""

    def run(bodies):
        doc, rid, value = unblock(bodies, [np.int64, np.int64, np.uint64])
        order = np.lexsort((rid, doc))
        doc, rid, value = doc[order], rid[order], value[order]
        cut = np.ones(len(doc), bool)
        cut[1:] = (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1])
        at = np.append(np.flatnonzero(cut), len(doc))
        for a in range(0, len(at) - 1, 20_000):
            own = at[a : a + 20_001]
            bodies = [value[x:y].tobytes() for x, y in zip(own[:-1], own[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[own[:-1]]), pa.array(rid[own[:-1]]), pa.array(bodies, pa.binary())], ["doc_id", "rid", "found"])

    return by_bucket(messages, n, run, "doc_id long, rid long, found binary")


def place_of(ident: np.ndarray, n: int) -> np.ndarray:
    return (mix64(ident.view(U64)) % U64(n)).astype(np.int32)


def message_blocks(doc, rid, value, n):
    order = np.argsort(doc, kind="stable")
    return blocks(place_of(rid[order], n), [doc[order], rid[order], value[order]])


def opened(batch: pa.RecordBatch, text: str) -> pa.RecordBatch:
    """A batch with the struct column ``row``, its text taken out as a column of its own."""
    body = pc.struct_field(batch.column("row"), text)
    return pa.RecordBatch.from_arrays([*batch.columns, body], [*batch.schema.names, "text"])


def removed_spans(df: DataFrame, key: str, text: str, width: int, sample: int) -> DataFrame:
    """Rows of ``df`` as a struct, with doc_id, __own (first of its text; else null), found (start << 32 | end of what goes, 64 bits each)."""
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    reach = width - TOKEN
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    doc = F.col(f"`{key}`").cast("long")
    h1, h2 = F.xxhash64(body), F.xxhash64(F.lit(17), body)
    slim = df.select(doc.alias("doc_id"), body.alias("text"), h1.alias("h1"), h2.alias("h2")).filter("doc_id is not null")
    lead, hot = sample_tokens(slim, width, sample)
    splitters = lead[np.linspace(0, len(lead) - 1, n + 1).astype(int)[1:-1]] if len(lead) else lead
    guide = spark.sparkContext.broadcast((np.unique(splitters), hot))  # n words, and at most the sample's tokens / HOT

    owners = slim.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.xxhash64("doc_id", "h1", "h2").alias("rid"), F.xxhash64("h1", "h2").alias("cid"), F.lit(True).alias("__own")).distinct()
    # both uses of the texts take the whole row, so that they read one exchange
    rows = df.select(doc.alias("doc_id"), F.xxhash64(doc, h1, h2).alias("rid"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))

    def name(batches):
        """Tokens by content (copies are one), five bytes of each hash; the bucket holds more of it."""
        _, hot = guide.value
        for batch in batches:
            held: list[list[np.ndarray]] = [[], []]
            for part, data, offsets in slices(batch, "text"):
                owner, *_, token = suffixes(data, offsets, width)
                cid = part.column("cid").to_numpy()[owner]
                cold = ~np.isin(token, hot)
                token, cid = token[cold], cid[cold]
                order = np.lexsort((token, cid))
                token, cid = token[order], cid[order]
                new = np.ones(len(token), bool)
                new[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])
                held[0].append(token[new])
                held[1].append(cid[new])
            token, cid = np.concatenate(held[0]), np.concatenate(held[1])
            if len(token):
                yield block_batch(list(blocks((token % U64(n)).astype(np.int32), [(token >> U64(32)).astype(np.uint32), (token >> U64(24)).astype(np.uint8), cid])))

    def shared(bodies):
        high, low, cid = unblock(bodies, [np.uint32, np.uint8, np.int64])
        token = (high.astype(U64) << U64(8)) | low
        order = np.argsort(token, kind="stable")
        token, cid = token[order], cid[order]
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        several = (np.minimum.reduceat(cid, at) < np.maximum.reduceat(cid, at))[group] if len(token) else np.zeros(0, bool)
        if several.any():
            cid, token = cid[several], token[several]
            yield block_batch(list(blocks(place_of(cid, n), [cid, (token >> U64(8)).astype(np.uint32), token.astype(np.uint8)])))

    def wanted_tokens(bodies):
        cid, high, low = unblock(bodies, [np.int64, np.uint32, np.uint8])
        token = (high.astype(U64) << U64(8)) | low
        order = np.argsort(cid, kind="stable")
        cid, token = cid[order], token[order]
        cut = np.flatnonzero(np.concatenate([np.ones(1, bool), cid[1:] != cid[:-1]])) if len(cid) else np.zeros(0, np.int64)
        at = np.append(cut, len(cid))
        for a in range(0, len(cut), 20_000):
            own = at[a : a + 20_001]
            yield pa.RecordBatch.from_arrays([pa.array(cid[own[:-1]]), pa.array([token[x:y].tobytes() for x, y in zip(own[:-1], own[1:], strict=True)], pa.binary())], ["cid", "wanted"])

    named = slim.select(F.xxhash64("h1", "h2").alias("cid"), "text").mapInArrow(name, "bucket int, body binary")
    candidates = by_bucket(by_bucket(named, n, shared, "bucket int, body binary"), n, wanted_tokens, "cid long, wanted binary")
    marks = owners.join(candidates, "cid", "left").select("doc_id", "rid", F.coalesce("wanted", F.lit(b"")).alias("wanted"))
    kinds = [np.int64, np.int64, np.int64, np.uint8, np.uint8, np.dtype(f"V{reach + width}")]

    def show(batches):
        splitters, hot = guide.value
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        sure: list[list[np.ndarray]] = [[], [], []]

        def ready():
            made = []
            if out[0]:
                bucket, *columns, shown = (np.concatenate(x) for x in out)
                made += blocks(bucket, [*columns, shown.view(f"V{reach + width}").ravel()])
            if sure[0] and sum(map(len, sure[0])):
                made += ((n + k, b) for k, b in message_blocks(*(np.concatenate(x) for x in sure), n))
            for x in (*out, *sure):
                x.clear()
            if made:
                yield block_batch(made)
            trim()

        for batch in batches:
            batch = batch.filter(batch.column("wanted").is_valid())  # the first documents of their contents
            for part, data, offsets in slices(opened(batch, text), "text"):
                owner, place, first, last, token = suffixes(data, offsets, width)
                if not len(owner):
                    continue
                wanted, at = raw_values(part.column("wanted"))
                short = token >> U64(24)
                pick = np.isin(token, hot)
                is_hot = pick.copy()
                edges = np.searchsorted(owner, np.arange(part.num_rows + 1))
                for r in np.flatnonzero(np.diff(at)):
                    a, b = edges[r], edges[r + 1]
                    pick[a:b] |= np.isin(short[a:b], wanted[at[r] : at[r + 1]])
                owner, place, first, last, is_hot = (x[pick] for x in (owner, place, first, last, is_hot))
                if not len(owner):
                    continue
                # hot ones: windows in three runs, each seen from a place that all of its windows hold
                third = -(-(reach + 1) // 3)
                step = np.where(is_hot, third, reach + 1)
                lows, highs = place - last, place - first
                turns = highs // step - lows // step + 1
                again = np.repeat(np.arange(len(owner)), turns)
                nth = ragged(np.zeros(len(owner), np.int64), turns) + (lows // step)[again]
                low, high = np.maximum(lows[again], nth * step[again]), np.minimum(highs[again], (nth + 1) * step[again] - 1)
                owner, is_hot = owner[again], is_hot[again]
                seen = place[again] - nth * step[again]
                first, last = place[again] - high, place[again] - low
                ids, rids = part.column("doc_id").to_numpy()[owner], part.column("rid").to_numpy()[owner]
                words = words_at(data)
                one, two = (span_hashes(words, first, last - first + width, seed) for seed in (1, 2))
                two = mix64(two ^ (seen - first).astype(U64))
                order = np.lexsort((ids, two, one))
                new = np.ones(len(order), bool)
                new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
                least = ids[order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]]
                later = np.zeros(len(order), bool)
                later[order] = ids[order] > least
                start = first - offsets[owner]
                sure[0].append(ids[later])
                sure[1].append(rids[later])
                sure[2].append(packed(start[later], (last - first)[later] + start[later] + width))
                keep = np.flatnonzero(~later)
                leading = words[seen[keep]].byteswap()
                bucket = np.searchsorted(splitters, leading, "right")
                heated = np.flatnonzero(is_hot[keep])
                core = span_hashes(words, seen[keep[heated]], np.full(len(heated), width - third + 1))
                bucket[heated] = (core % U64(n)).astype(np.int64)
                shown = contexts(data, seen[keep], first[keep], last[keep], width)
                own = [bucket.astype(np.int32), ids[keep], rids[keep], seen[keep] - offsets[owner[keep]], (seen - last)[keep].astype(np.uint8), (seen - first)[keep].astype(np.uint8), shown]
                for x, y in zip(out, own, strict=True):
                    x.append(y)
                if sum(len(x) for x in out[0]) * (reach + width) > SHOWN:
                    yield from ready()
        yield from ready()

    def compare(bodies):
        for pile in piles(bodies, kinds, reach):
            doc, rid, place, low, high, shown = unblock(pile, kinds)
            found, lowest, highest = repeated(shown.view(np.uint8).reshape(-1, reach + width), low, high, doc, width)
            if len(found):
                yield block_batch(list(message_blocks(doc[found], rid[found], packed(place[found] - highest, place[found] - lowest + width), n)))
            del pile, doc, rid, place, low, high, shown
            trim()

    # a left join like the last one below: an inner one would filter its rows first and need an exchange of its own
    shown = rows.join(marks, ["doc_id", "rid"], "left").select("doc_id", "rid", "row", "wanted").mapInArrow(show, "bucket int, body binary")

    def either(batches):
        """Suffixes are compared, what was certain before passes through."""
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(bucket, []).append(content)
        for bucket in sorted(held):
            bodies = held.pop(bucket)
            if bucket >= n:
                yield block_batch([(bucket - n, b) for b in bodies])
            else:
                yield from compare(bodies)

    messages = shown.repartition(n, "bucket").mapInArrow(either, "bucket int, body binary")
    out = rows.join(owners.select("doc_id", "rid", "__own"), ["doc_id", "rid"], "left").join(per_document(messages, n), ["doc_id", "rid"], "left")
    return out.select("doc_id", "row", "__own", F.coalesce("found", F.lit(b"")).alias("found"))


def piles(bodies: list[bytes], kinds: list, reach: int):
    """The bodies of a bucket, or where they hold more than PILE bytes, runs of its rows by their leading tokens, of about PILE bytes each.

    Only one body is open at a time; the others stay compressed. Rows with one leading token stay together.
    """
    count = -(-volume(bodies) // PILE)
    if count < 2:
        yield bodies
        return
    leading = lambda columns: np.ascontiguousarray(columns[-1].view(np.uint8).reshape(len(columns[-1]), -1)[:, reach : reach + TOKEN]).view(f"S{TOKEN}").ravel()
    some = np.sort(np.concatenate([leading(unblock([body], kinds))[:: max(1, len(bodies) // 16)] for body in bodies]))
    cuts = np.unique(some[np.linspace(0, len(some) - 1, count + 1).astype(int)[1:-1]])
    held: list[list[bytes]] = [[] for _ in range(len(cuts) + 1)]
    while bodies:
        columns = unblock([bodies.pop()], kinds)
        for k, body in blocks(np.searchsorted(cuts, leading(columns), "right"), columns):
            held[k].append(body)
    while held:
        yield held.pop(0)


def packed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (start.astype(U64) << U64(32)) | end.astype(U64)


def raw_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of a binary column, and the rows' offsets in them."""
    from .common import raw

    data, offsets = raw(column)
    return np.frombuffer(data.tobytes(), U64), offsets // 8


def joined(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of spans packed as start << 32 | end."""
    out: list[tuple[int, int]] = []
    if not len(spans):
        return out
    spans = np.sort(spans)
    start, end = (spans >> U64(32)).astype(np.int64), np.maximum.accumulate((spans & U64(0xFFFFFFFF)).astype(np.int64))
    new = np.ones(len(spans), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return list(zip(start[at].tolist(), end[np.append(at[1:], len(spans)) - 1].tolist(), strict=True))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 50, sample: int = 3000, kept: bool = True) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, kept_sha256 and (if asked for) the remaining bytes, kept, to each row.

    kept_text are these bytes as text, without what is left of characters that were cut in two. ``width`` may be 17 to 250 bytes. Texts must be shorter than 4 GiB.
    """
    added = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), *([("kept", "binary"), ("kept_text", "string")] if kept else [])]
    plain, schema = extended(df, added)
    names = plain.columns
    found = removed_spans(df, key, text, width, sample)
    rows = found.select("row", "found", (F.col("doc_id").isNotNull() & F.col("__own").isNull()).alias("copy"))

    def run(batches):
        for batch in batches:
            for part, data, offsets in slices(opened(batch, text), "text"):
                wanted, at = raw_values(part.column("found"))
                out: list[list] = [[], [], [], [], []]
                for r, copy in enumerate(part.column("copy").to_pylist()):
                    own = data[offsets[r] : offsets[r + 1]]
                    spans = joined(wanted[at[r] : at[r + 1]])
                    if copy:
                        spans = [(0, len(own))] if len(own) >= width else []
                    rest, last = [], 0
                    for a, b in spans:
                        rest.append(own[last:a].tobytes())
                        last = b
                    rest = b"".join([*rest, own[last:].tobytes()])
                    for column, value in zip(out, (len(own), len(own) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest), strict=True):
                        column.append(value)
                new = dict(zip(("n_bytes", "n_removed", "n_spans"), (pa.array(x, pa.int64()) for x in out), strict=False)) | {"kept_sha256": pa.array(out[3], pa.string())}
                if kept:
                    new["kept"] = pa.array(out[4], pa.binary())
                    new["kept_text"] = pa.array([b.decode("utf-8", "ignore") for b in out[4]], pa.string())
                whole = part.column("row")
                yield pa.RecordBatch.from_arrays([*(pc.struct_field(whole, c) for c in names), *new.values()], [*names, *new])

    return rows.mapInArrow(run, schema)
