"""Personal data: pattern rules, and a character-level bidirectional LSTM with a CRF on top that adds spans.

The rules find e-mail addresses, IP addresses, payment card numbers and phone numbers; each kind is
matched from left to right without overlaps, and matches that fail its check are dropped for good. The
network is trained here, in numpy, from labelled spans: sentences with personal data in usual and unusual
spellings, and look-alikes (dates, prices, versions, keys) that carry no label. It reads classes of
characters, so its size doesn't depend on the alphabet.

The network reads texts in windows of ``WINDOW`` characters that overlap by half, from the start of each
text. Each character takes its tag from the window in whose middle it lies; runs of one tag that cross
windows are one span. No kind can do without a digit or an ``@``, so windows that answer for neither are
read only where a run of tags reaches them: the spans are those of reading all windows. An added e-mail
address reaches to the ends of its unbroken run of address characters. Spans that touch one of the rules'
spans are left to the rules.

Null texts are empty. Rows that repeat and further columns pass through; columns named like added ones are replaced.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .tokens import extended, with_columns

KINDS = ("email", "ip", "card", "phone")
WINDOW = 64
EMBED, HIDDEN, TAGS = 8, 16, 1 + len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = _LOCAL - frozenset("_%+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind; in linear time also on long runs of digits or word characters."""
    found = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), 0))
            last = m.end()
        else:
            last = max(last, at)  # the local part can't reach over this sign
        at = text.find("@", max(last, at + 1))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


@cache
def char_classes() -> np.ndarray:
    """Class of each code point below 128, and one for all others; 0 stands for the outside of a text."""
    table = np.full(129, 1, np.int64)
    for c in range(128):
        ch = chr(c)
        table[c] = 2 if ch.isdigit() else 3 if ch.islower() else 4 if ch.isupper() else 5 if ch.isspace() else 1
    for k, ch in enumerate("@.-+()_/:,%#\"'=$"):
        table[ord(ch)] = 6 + k
    table[128] = 3
    return table


CLASSES = 22


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Two LSTMs and a linear-chain CRF. Gates stand in the order input, forget, output, candidate."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def fresh(rng: np.random.Generator) -> Tagger:
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        w = {"embed": draw(CLASSES, EMBED) * 3}
        for d in ("fw", "bw"):
            w[f"{d}_x"], w[f"{d}_h"], w[f"{d}_b"] = draw(EMBED, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN, np.float32)
            w[f"{d}_b"][HIDDEN : 2 * HIDDEN] = 1
        w |= {"out": draw(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        return Tagger(w)

    def _run(self, chars: np.ndarray, d: str, keep: bool):
        """States of one direction, time first; with what the way back needs."""
        steps, n = chars.shape
        table = self.w["embed"] @ self.w[f"{d}_x"] + self.w[f"{d}_b"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        states, kept = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "fw" else range(steps - 1, -1, -1):
            z = table[chars[t]] + h @ self.w[f"{d}_h"]
            gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before_h, before_c = h, c
            c = f * c + i * new
            squashed = np.tanh(c)
            h = o * squashed
            states[t] = h
            if keep:
                kept.append((t, i, f, o, new, before_h, before_c, squashed))
        return states, kept

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        fw, bw = self._run(chars, "fw", False)[0], self._run(chars, "bw", False)[0]
        return fw @ self.w["out"][:HIDDEN] + bw @ self.w["out"][HIDDEN:] + self.w["out_b"]

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """Best tags (windows x time) of windows x time character classes."""
        chars = np.ascontiguousarray(chars.T)
        e, trans = self.emissions(chars), self.w["trans"]
        steps, n, _ = e.shape
        score, back = e[0], np.zeros((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            way = score[:, :, None] + trans[None]
            back[t] = way.argmax(1)
            score = way.max(1) + e[t]
        tags = np.zeros((steps, n), np.int8)
        tags[-1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t, np.arange(n), tags[t]]
        return tags.T

    def gradients(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its gradients (arrays are time x windows)."""
        w, (steps, n) = self.w, chars.shape
        runs = {d: self._run(chars, d, True) for d in ("fw", "bw")}
        h = np.concatenate([runs["fw"][0], runs["bw"][0]], 2)
        e, trans = h @ w["out"] + w["out_b"], w["trans"]
        log_sum = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = log_sum(alpha[t - 1][:, :, None] + trans[None], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = log_sum(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = log_sum(alpha[-1], 1)
        gold = np.take_along_axis(e, tags[:, :, None], 2).sum((0, 2)) + trans[tags[:-1], tags[1:]].sum(0)
        de = np.exp(alpha + beta - total[None, :, None])
        pair = np.exp(alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]).sum((0, 1))
        np.add.at(pair, (tags[:-1].ravel(), tags[1:].ravel()), -1)
        np.put_along_axis(de, tags[:, :, None], np.take_along_axis(de, tags[:, :, None], 2) - 1, 2)
        de /= n
        g = {"trans": pair / n, "out": np.einsum("tnh,tnk->hk", h, de), "out_b": de.sum((0, 1)), "embed": np.zeros_like(w["embed"])}
        dh_all = de @ w["out"].T
        for k, d in enumerate(("fw", "bw")):
            dh_next, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            gx, gh = np.zeros((CLASSES, 4 * HIDDEN), np.float32), np.zeros_like(w[f"{d}_h"])
            for t, i, f, o, new, before_h, before_c, squashed in reversed(runs[d][1]):
                dh = dh_all[t, :, k * HIDDEN : (k + 1) * HIDDEN] + dh_next
                dc = dc + dh * o * (1 - squashed**2)
                dz = np.concatenate([dc * new * i * (1 - i), dc * before_c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], 1)
                np.add.at(gx, chars[t], dz)
                gh += before_h.T @ dz
                dh_next, dc = dz @ w[f"{d}_h"].T, dc * f
            g[f"{d}_h"], g[f"{d}_b"], g[f"{d}_x"] = gh, gx.sum(0), w["embed"].T @ gx
            g["embed"] += gx @ w[f"{d}_x"].T
        return float((total - gold).mean()), g


def labelled(rng: np.random.Generator, n: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts of about one window with their labelled spans."""
    pick = lambda *xs: xs[rng.integers(len(xs))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("etaoinshrdluécmfwyp"), rng.integers(1, 9)))
    hexa = lambda k: "".join(rng.choice(list("0123456789abcdef"), k))

    def card():
        body = num(int(rng.integers(12, 19)))
        body += next(c for c in "0123456789" if luhn(body + c))
        gap = pick("", "", " ", "-", ".")
        return gap.join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return pick(f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)}{a}{b}{c}", f"00{num(2)} {a} {b}{c}")

    makers = (
        lambda: f"{word()}{pick('.', '_', '')}{pick(word(), num(2))}@{word()}{pick('', num(1))}{pick('.com', '.example.com', '.org', '.de', '')}",
        lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)) + pick("", "", ":" + num(4)),
        card,
        phone,
    )
    plain = (
        lambda: f"{num(4)}-{num(2)}-{num(2)}",
        lambda: f"{num(2)}:{num(2)}",
        lambda: f"${num(2)},{num(3)}.{num(2)}",
        lambda: f"version {rng.integers(0, 9)}.{rng.integers(0, 20)}.{rng.integers(0, 9)}",
        lambda: f"{rng.integers(0, 9)}.{rng.integers(0, 9)}.",
        lambda: num(int(rng.integers(1, 8))),
        lambda: f'"{hexa(int(rng.integers(24, 40)))}"',
        lambda: f"token = {hexa(32)}",
        lambda: f"{word()} @ {word()}",
        lambda: f"{num(3)}%",
    )
    out = []
    for _ in range(n):
        parts, spans, at = [], [], 0
        for _ in range(int(rng.integers(4, 9))):
            x = rng.random()
            if x < 0.28:
                kind = int(rng.integers(4))
                piece = makers[kind]()
                end = at + len(piece) - (len(piece) - piece.rfind(":") if kind == 1 and ":" in piece else 0)
                spans.append((at, end, kind))
            else:
                piece = plain[rng.integers(len(plain))]() if x < 0.5 else word()
            gap = pick(" ", " ", " ", ", ", ". ", "\n", " (", '" ', "!! ", "### ")
            parts.append(piece + gap)
            at += len(piece) + len(gap)
        out.append(("".join(parts), spans))
    return out


def windows_of(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 128)
    chars, tags = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
    n = min(len(codes), WINDOW)
    chars[:n] = char_classes()[codes[:n]]
    for a, b, kind in spans:
        tags[a : min(b, WINDOW)] = kind + 1
    return chars, tags


@cache
def trained(seed: int = 5, examples: int = 1600, epochs: int = 5, batch: int = 32, rate: float = 0.02) -> Tagger:
    """Trained with Adam on labelled spans; always the same for the same arguments."""
    rng = np.random.default_rng(seed)
    pairs = []
    for text, spans in labelled(rng, examples):
        cut = int(rng.integers(0, max(1, len(text) - WINDOW)))
        pairs.append(windows_of(text[cut:], [(max(0, a - cut), b - cut, k) for a, b, k in spans if b > cut]))
    chars, tags = (np.stack(x) for x in zip(*pairs, strict=True))
    model = Tagger.fresh(rng)
    m1, m2, step = {k: np.zeros_like(v) for k, v in model.w.items()}, {k: np.zeros_like(v) for k, v in model.w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(examples)
        for a in range(0, examples, batch):
            own = order[a : a + batch]
            _, g = model.gradients(np.ascontiguousarray(chars[own].T), np.ascontiguousarray(tags[own].T))
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            for k, x in g.items():
                x = x * min(1.0, 5 / max(norm, 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * x
                m2[k] = 0.99 * m2[k] + 0.01 * x * x
                now = rate * 0.5**epoch
                model.w[k] = (model.w[k] - now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def tagged(model: Tagger, codes: np.ndarray, bounds: np.ndarray, whole: bool = False) -> np.ndarray:
    """Tag of every character; bounds are the texts' offsets in ``codes``.

    Unless ``whole``, windows in reach of no digit, ``@`` or run of tags that begins at one are not read and give 0.
    """
    out = np.zeros(len(codes), np.int8)
    trigger = np.arange(len(codes)) if whole else np.flatnonzero(((codes >= 48) & (codes < 58)) | (codes == 64))
    half, classes = WINDOW // 2, char_classes()
    count = np.maximum(1, -(-(np.diff(bounds) - half) // half))
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])  # windows are numbered through all texts
    read = np.zeros(first[-1], bool)
    text = np.searchsorted(bounds, trigger, "right") - 1
    asked = np.unique(first[text] + np.clip((trigger - bounds[text] - half // 2) // half, 0, count[text] - 1))
    while len(asked):
        read[asked] = True
        more = []
        for a in range(0, len(asked), 4096):
            own = asked[a : a + 4096]
            of = np.searchsorted(first, own, "right") - 1
            begin, stop = bounds[of] + half * (own - first[of]), bounds[of + 1]
            at = begin[:, None] + np.arange(WINDOW)
            inside = at < stop[:, None]
            seen = np.minimum(codes[np.minimum(at, len(codes) - 1)], 128)
            tags = model.decode(np.where(inside, classes[seen], 0))
            # each window answers for its middle half, the outer ones also for the ends of the text
            head, tail = own == first[of], own == first[of + 1] - 1
            low, high = np.where(head, 0, half // 2), np.where(tail, WINDOW, half + half // 2)
            mine = inside & (np.arange(WINDOW) >= low[:, None]) & (np.arange(WINDOW) < high[:, None])
            out[at[mine]] = tags[mine]
            row = np.arange(len(own))
            more += [own[~head & (tags[row, low] > 0)] - 1, own[~tail & (tags[row, high - 1] > 0)] + 1]
        asked = np.unique(np.concatenate(more))
        asked = asked[~read[asked]]
    return out


def added_spans(text: str, tags: np.ndarray, rules: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of one tag, trimmed, addresses to their ends, plausible for their kind, that touch none of the rules' spans."""
    edges = np.flatnonzero(np.diff(tags, prepend=0, append=0))
    out, last = [], 0
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        kind = int(tags[a]) - 1
        a = max(a, last)  # the span before may have been widened
        if kind < 0 or a >= b:
            continue
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if kind == 0 and "@" in text[a:b].strip("@"):
            low, high = max([last, *(y for _, y, _ in rules if y <= a)]), min([len(text), *(x for x, *_ in rules if x >= b)])
            while a > low and text[a - 1] in _LOCAL:
                a -= 1
            while b < high and text[b] in _HOST:
                b += 1
            b = a + len(text[a:b].rstrip(".-"))
        piece = text[a:b]
        digits = sum(c in "0123456789" for c in piece)
        letters = any(c.isalpha() for c in piece)
        fits = ("@" in piece.strip("@"), piece.count(".") == 3 and digits >= 4 and not letters, 12 <= digits <= 19 and not letters and luhn("".join(c for c in piece if c in "0123456789")), 9 <= digits <= 15 and not letters and not piece.isdigit())[kind]
        if fits and not any(x < b and a < y for x, y, _ in rules):
            out.append((a, b, kind))
            last = b
    return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by their kind in brackets; of overlapping ones the first decides, to the end of the last."""
    out, last = [], 0
    for a, b, k in sorted(spans):
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def find_personal_data(df: DataFrame, text: str = "text", model: Tagger | None = None, clean: bool = True) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone (spans of the rules), base_sha256, spans (all) and, if asked for, clean_text.

    Spans are kind:start:end in code points, end exclusive, joined by commas, ordered by start, then kind.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model or trained())  # a few thousand weights
    added = [*((f"n_{k}", "long") for k in KINDS), ("base_sha256", "string"), ("spans", "string"), *([("clean_text", "string")] if clean else [])]
    df, schema = extended(df, added)
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, text):
                body = data.tobytes()
                codes = np.frombuffer(body.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
                lead = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
                bounds = lead[offsets]
                tags = tagged(shipped.value, codes, bounds)
                busy = np.concatenate([np.zeros(1, np.int64), np.cumsum(((codes >= 48) & (codes < 58)) | (codes == 64))])
                busy = busy[bounds[1:]] > busy[bounds[:-1]]
                n = rows.num_rows
                counts, digests, all_spans = np.zeros((len(KINDS), n), np.int64), [nothing] * n, [""] * n
                cleaned = rows.column(text).to_pylist() if clean else []
                for r in np.flatnonzero(busy).tolist():
                    own = body[offsets[r] : offsets[r + 1]].decode("utf-8", "replace")
                    rules = rule_spans(own)
                    for *_, k in rules:
                        counts[k, r] += 1
                    digests[r] = hashlib.sha256(shown(rules).encode()).hexdigest()
                    spans = sorted([*rules, *added_spans(own, tags[bounds[r] : bounds[r + 1]], rules)], key=lambda s: (s[0], s[2]))
                    all_spans[r] = shown(spans)
                    if clean and spans:
                        cleaned[r] = redacted(own, spans)
                new = {f"n_{k}": pa.array(c) for k, c in zip(KINDS, counts, strict=True)} | {"base_sha256": pa.array(digests), "spans": pa.array(all_spans)}
                if clean:
                    new["clean_text"] = pa.array(cleaned, pa.string())
                yield with_columns(rows, new)

    return df.mapInArrow(run, schema)
