"""Byte-level BPE: vocabulary files, a vectorised pre-tokeniser and three exact encoders.

The pre-tokeniser yields the matches of ``public_tokenizers.PATTERN`` over whole texts as byte spans.
It works on character classes instead of a regular expression engine: a match ends where the class of
characters changes, with the pattern's rules for one leading blank, white space runs and the seven
English contractions. The classes are asked of the tokenizer library itself, so both know the same
Unicode version.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

import numpy as np

from .common import U64, ragged, span_hashes, words_at

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
NEVER = np.int32(2**31 - 1)


def _alphabet() -> dict[str, int]:
    """The printable stand-ins that vocabulary files in JSON use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """tokens: bytes by id. pairs: (left id, right id) to the id of the merge; a smaller id merges first."""

    tokens: dict[int, bytes]
    pairs: dict[tuple[int, int], int]
    specials: dict[str, int] = field(default_factory=dict)

    @property
    def ids(self) -> dict[bytes, int]:
        return {b: i for i, b in self.tokens.items()}


@cache
def load_json(content: str) -> Vocabulary:
    doc, stand_in = json.loads(content), _alphabet()
    specials = {t["content"]: t["id"] for t in doc["added_tokens"]}
    vocab = {k: v for k, v in doc["model"]["vocab"].items() if k not in specials}
    pairs, last = {}, -1
    for left, right in (m if isinstance(m, list) else m.split(" ") for m in doc["model"]["merges"]):
        made = vocab[left + right]
        if made <= last:
            raise ValueError("merges must be in the order of their ids")
        pairs[vocab[left], vocab[right]] = last = made
    return Vocabulary({i: bytes(stand_in[c] for c in s) for s, i in vocab.items()}, pairs, specials)


@cache
def load_ranks(content: bytes) -> Vocabulary:
    """Rank files list no pairs: any two tokens whose joint bytes are a token may merge."""
    tokens = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, content.splitlines())}
    return Vocabulary(tokens, _all_pairs(tokens))


def _all_pairs(tokens: dict[int, bytes]) -> dict[tuple[int, int], int]:
    ids = {b: i for i, b in tokens.items()}
    return {(ids[b[:k]], ids[b[k:]]): i for i, b in tokens.items() for k in range(1, len(b)) if b[:k] in ids and b[k:] in ids}


def merge(piece: bytes, vocab: Vocabulary, byte_ids: list[int]) -> list[int]:
    """Plain BPE with a heap over linked neighbours: n log n also for one very long piece."""
    ids, n, pairs = [byte_ids[b] for b in piece], len(piece), vocab.pairs
    if n < 2:
        return ids
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := pairs.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        made, i, left, right = heapq.heappop(heap)
        j = after[i]
        if ids[i] != left or j < 0 or ids[j] != right:
            continue
        ids[i], ids[j], after[i] = made, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
            if (m := pairs.get((made, ids[after[j]]))) is not None:
                heapq.heappush(heap, (m, i, made, ids[after[j]]))
        if before[i] >= 0 and (m := pairs.get((ids[before[i]], made))) is not None:
            heapq.heappush(heap, (m, before[i], ids[before[i]], made))
    return [i for i in ids if i >= 0]


class Merger:
    """Merges many short pieces in step: one merge a round in every piece that has one left."""

    SHORT = 40

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        ids = vocab.ids
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.width = max(vocab.tokens) + 1
        keys = np.array([a * self.width + b for a, b in vocab.pairs], np.int64)
        made = np.fromiter(vocab.pairs.values(), np.int32, len(vocab.pairs))
        order = np.argsort(keys)
        self.keys, self.made = np.append(keys[order], -1), np.append(made[order], NEVER)
        lut = np.array(self.byte_ids, np.int64)
        self.byte_lut = lut.astype(np.int32)
        self.first = self.lookup((lut[:, None] * self.width + lut[None, :]).ravel()).reshape(256, 256)

    def lookup(self, pair: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys[:-1], pair)
        return np.where(self.keys[at] == pair, self.made[at], NEVER)

    def __call__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans, one after the other, and how many each has."""
        counts = np.zeros(len(starts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for low, high in ((0, 4), (4, 8), (8, 14), (14, 24), (24, self.SHORT)):
            group = np.flatnonzero((lengths > low) & (lengths <= high))
            for part in np.array_split(group, max(1, len(group) // 20_000)):
                if len(part):
                    ids, n = self._step(data, starts[part], lengths[part])
                    counts[part] = n
                    found.append((part, ids))
        rest = np.flatnonzero(lengths > self.SHORT)
        for i in rest:
            ids = merge(data[starts[i] : starts[i] + lengths[i]].tobytes(), self.vocab, self.byte_ids)
            counts[i] = len(ids)
            found.append((np.array([i]), np.array(ids, np.int32)))
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for part, ids in found:
            out[ragged(at[part], counts[part])] = ids
        return out, counts

    def _step(self, data, starts, lengths):
        n, width = len(starts), int(lengths.max())
        column = np.arange(width)
        inside = column[None, :] < lengths[:, None]
        raw = data[np.minimum(starts[:, None] + column, len(data) - 1)]
        ids = np.where(inside, self.byte_lut[raw], 0)
        rank = np.full((n, width), NEVER, np.int32)  # of the pair that starts at each place
        if width > 1:
            rank[:, :-1] = np.where(inside[:, 1:], self.first[raw[:, :-1], raw[:, 1:]], NEVER)
        size, row = lengths.copy(), np.arange(n)
        while True:
            at = rank[row].argmin(1)
            best = rank[row, at]
            go = best != NEVER
            if not go.any():
                break
            row, at, best = row[go], at[go], best[go]
            shift = np.minimum(column[None, :] + (column[None, :] > at[:, None]), width - 1)
            new = np.take_along_axis(ids[row], shift, 1)
            ranks = np.take_along_axis(rank[row], shift, 1)
            k = np.arange(len(row))
            new[k, at] = best
            ranks[:, -1] = NEVER
            size[row] -= 1
            left = at > 0
            ranks[k[left], at[left] - 1] = self.lookup(new[k[left], at[left] - 1].astype(np.int64) * self.width + best[left])
            ranks[k, at] = NEVER
            right = at + 1 < size[row]
            ranks[k[right], at[right]] = self.lookup(best[right].astype(np.int64) * self.width + new[k[right], at[right] + 1])
            ids[row], rank[row] = new, ranks
        return ids[column[None, :] < size[:, None]], size


class Backtracker:
    """Longest matches from an Aho-Corasick automaton, taken back where two neighbours can't stand side by side.

    Bytes are mapped to Latin-1 characters, as the automaton takes text. ``reach[i]`` is the longest token
    that starts at byte i. A token may follow another only if plain BPE of their joint bytes gives exactly
    these two; the answers are memoised. Where no token fits, the last one is shortened to its longest
    proper prefix in the vocabulary; a byte that has turned out a dead end is never entered again, so each
    piece takes time in proportion to its length.
    """

    MEMO = 400_000

    def __init__(self, vocab: Vocabulary):
        import ahocorasick

        self.vocab, self.tokens = vocab, vocab.tokens
        ids = vocab.ids
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for i, b in self.tokens.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.length = {i: len(b) for i, b in self.tokens.items()}
        self.shorter = {i: next((ids[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in ids), None) for i, b in self.tokens.items()}
        self.memo: dict[tuple[int, int], bool] = {}

    def fits(self, left: int, right: int) -> bool:
        known = self.memo.get((left, right))
        if known is None:
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            known = self.memo[left, right] = merge(self.tokens[left] + self.tokens[right], self.vocab, self.byte_ids) == [left, right]
        return known

    def encode(self, piece: bytes) -> list[int]:
        size, reach = len(piece), {}
        for end, (token, n) in self.automaton.iter(piece.decode("latin-1")):
            reach[end - n + 1] = token  # later ends are longer
        token, at, out, length = reach.get(0), 0, [], self.length
        dead = bytearray(size + 1)
        while at < size:
            end = at + length[token]
            if not dead[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                token = reach.get(at)
            elif (less := self.shorter[token]) is not None:
                token = less
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def __call__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], np.zeros(len(starts), np.int64)
        for i, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
            got = self.encode(data[a : a + n].tobytes())
            counts[i] = len(got)
            ids += got
        return np.array(ids, np.int32), counts


@cache
def classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library's own regular expressions see it."""
    import tiktoken

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(probe.encode_ordinary(everything)).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def split(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte starts of all pattern matches; no match crosses one of the texts' bounds (offsets into data)."""
    if not len(data):
        return np.zeros(0, np.int64)
    lead = (data & 0xC0) != 0x80
    if lead.all():
        kind, where = classes()[:128][data], None
        char = data
    else:
        char = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind, where = classes()[char], np.flatnonzero(lead)
    n = len(kind)
    first = np.zeros(n + 1, bool)  # characters that begin a text
    inner = bounds[bounds < len(data)]
    first[inner if where is None else np.searchsorted(where, inner)] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # a run of white space gives its last character away if something follows in the same text
    ends = space & ~first[1:]
    ends[:-1] &= ~space[1:]
    start |= ends
    taken = np.flatnonzero(ends & (char == 32)) + 1  # what a blank leads joins it
    start[taken] = False
    # contractions: an apostrophe that begins a match
    quote = np.flatnonzero(start & (char == 39))
    quote = quote[quote + 1 < n]
    if len(quote):
        padded = np.concatenate([char, np.zeros(2, char.dtype)])
        alone = ~first[quote + 1]
        pair = ~first[np.minimum(quote + 2, n)] & alone
        a, b = padded[quote + 1], padded[quote + 2]
        one = alone & np.isin(a, [ord(c) for c in "stmd"])
        two = pair & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for found, size in ((quote[one], 2), (quote[two], 3)):
            start[found + 1] = False
            if size == 3:
                start[found + 2] = False
            after = found + size
            start[after[after < n]] = True
            # an apostrophe right behind begins a match of its own; it is in `quote` already as the class changed
    return np.flatnonzero(start) if where is None else where[start]


class Encoder:
    """Splits texts and encodes each distinct match once; keeps what it has encoded, up to KEEP matches."""

    KEEP = 600_000

    def __init__(self, encode: Callable, sure: dict[bytes, int] | None = None):
        self.encode = encode
        self._clear()
        self.sure, self.sure_ids = np.zeros(0, U64), np.zeros(0, np.int32)
        if sure:
            names = list(sure)
            data = np.frombuffer(b"".join(names), np.uint8)
            n = np.array([len(b) for b in names], np.int64)
            h = span_hashes(words_at(data), np.cumsum(n) - n, n)
            order = np.argsort(h)
            self.sure, self.sure_ids = h[order], np.fromiter(sure.values(), np.int32, len(sure))[order]

    def _clear(self):
        self.known, self.at, self.n, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def matches(self, data: np.ndarray, bounds: np.ndarray):
        """Starts, lengths and hashes of all matches."""
        starts = split(data, bounds)
        lengths = np.diff(starts, append=len(data))
        return starts, lengths, span_hashes(words_at(data), starts, lengths)

    def whole(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the sure list of each match, or -1."""
        if not len(self.sure):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sure, hashes), len(self.sure) - 1)
        return np.where(self.sure[at] == hashes, at, -1)

    def distinct(self, data, starts, lengths, hashes):
        """Encodes distinct matches: for each match its place among them; their offsets into ids, counts, ids."""
        unique, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.KEEP:
            self._clear()
        place = np.searchsorted(self.known, unique)
        hit = self.known[np.minimum(place, len(self.known) - 1)] == unique if len(self.known) else np.zeros(len(unique), bool)
        new = np.flatnonzero(~hit)
        if len(new):
            ids, n = self.encode(data, starts[one[new]], lengths[one[new]])
            at = len(self.ids) + np.cumsum(n) - n
            self.ids = np.concatenate([self.ids, ids])
            self.known = np.insert(self.known, place[new], unique[new])
            self.at = np.insert(self.at, place[new], at)
            self.n = np.insert(self.n, place[new], n)
            place = np.searchsorted(self.known, unique)
        return back, self.at[place], self.n[place].astype(np.int64), self.ids

    def encode_all(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and offsets of the texts in them."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        starts, lengths, hashes = self.matches(data, bounds)
        back, at, n, ids = self.distinct(data, starts, lengths, hashes)
        counts = n[back]
        flat = ids[ragged(at[back], counts)]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        return flat, ends[np.searchsorted(starts, bounds)]


def pieces(data: np.ndarray, offsets: np.ndarray, specials: dict[bytes, int], limit: int = 1 << 20):
    """Cuts texts around special strings, and long ones before white space that follows something else.

    Yields (bounds of the cuts in data, text of each cut, id of a special string or -1), all of ``data`` in order.
    Neither cut changes any match: a special string is taken out before splitting, and a match never
    goes on from a non-blank to white space.
    """
    starts = [offsets[:-1][np.diff(offsets) > 0]]
    marks: dict[int, tuple[int, int]] = {}
    if specials:
        body = data.tobytes()
        for name, ident in specials.items():
            at = body.find(name)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(name) <= offsets[text + 1]:
                    marks[at] = (at + len(name), ident)
                    at = body.find(name, at + len(name))
                else:
                    at = body.find(name, at + 1)
        starts.append(np.array([x for a, (b, _) in marks.items() for x in (a, b)], np.int64))
    for i in np.flatnonzero(np.diff(offsets) > limit):
        body = data[offsets[i] : offsets[i + 1]]
        blank = np.isin(body, [9, 10, 11, 12, 13, 32])
        good = np.flatnonzero(blank[1:] & ~blank[:-1] & (body[:-1] < 128)) + 1
        at, chosen = limit, []
        while at < len(body):
            k = int(np.searchsorted(good, at))
            if k == len(good):
                break
            chosen.append(int(good[k]))
            at = chosen[-1] + limit
        starts.append(np.array(chosen, np.int64) + offsets[i])
    bounds = np.unique(np.concatenate(starts).astype(np.int64))
    bounds = bounds[bounds < len(data)]
    owner = np.searchsorted(offsets, bounds, "right") - 1
    ident = np.array([marks[b][1] if b in marks else -1 for b in bounds.tolist()], np.int64) if marks else np.full(len(bounds), -1)
    return np.append(bounds, len(data)), owner, ident
