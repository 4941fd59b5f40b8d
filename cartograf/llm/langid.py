"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed 1- to 3-grams of lower-cased code points, everything but letters taken as blanks.
Document frequencies are counted over all learnable texts; the weights are fitted on at most about
``sample`` of them by follow-the-regularised-leader with an elastic-net penalty (per-coordinate rates,
weights below the L1 threshold stay exactly zero). One in five of the sampled texts is kept back to fit
the temperature that calibrates the scores.

A text that is null or has no letter gets ``und`` with score 0, and so does every text if nothing can be
learnt from. Null or missing labels are not learnt from. Only text is an input of a prediction. Rows that
repeat are predicted each; further columns pass through, those with the names of added ones are replaced.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LETTER, classes
from .common import slices
from .tokens import extended, with_columns

DIMS = 1 << 15
UNKNOWN = "und"


@cache
def _folded() -> np.ndarray:
    """Lower-case code point of each letter, a blank for everything else."""
    table = np.full(0x110000, 32, np.uint32)
    for c in np.flatnonzero(classes() == LETTER):
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else c
    return table


def features(data: np.ndarray, offsets: np.ndarray):
    """For each text: feature numbers in order and their counts; None if it has no letter."""
    if len(data) and (data < 128).all():
        chars, bounds = _folded()[:128][data], offsets
    else:
        lead = np.cumsum(np.concatenate([np.zeros(1, np.int64), ((data & 0xC0) != 0x80)]))
        chars = _folded()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
        bounds = lead[offsets]
    letter = np.concatenate([np.zeros(1, np.int64), np.cumsum(chars != 32)])
    h, grams = np.zeros(len(chars), np.uint32), []
    for n in range(3):
        tail = chars[n:]
        h = (h[: len(tail)] ^ tail) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        grams.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(17)).astype(np.int32))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if letter[b] == letter[a]:
            yield None
            continue
        if 3 * (b - a) < DIMS // 8:  # sorting a short text's grams costs less than counters for all features
            yield np.unique(np.concatenate([grams[n][a : max(a, b - n)] for n in range(3)]), return_counts=True)
            continue
        counts = np.zeros(DIMS, np.int64)
        for n in range(3):
            if b - n > a:
                counts += np.bincount(grams[n][a : b - n], minlength=DIMS)
        at = np.flatnonzero(counts)
        yield at, counts[at]


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf
    return x / np.sqrt((x * x).sum())


class Model:
    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.labels, self.idf, self.weights, self.bias, self.temperature = labels, idf, weights, bias, temperature

    def logits(self, found) -> np.ndarray:
        at, counts = found
        return weigh(counts, self.idf[at]) @ self.weights[at] + self.bias

    def predict(self, found) -> tuple[str, float]:
        if found is None or not self.labels:
            return UNKNOWN, 0.0
        z = self.logits(found) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3, seed: int = 3) -> Model:
    """FTRL-proximal, one text at a time: z and n are kept for each feature and language; the last row is the bias."""
    labels = sorted({label for *_, label in rows})
    place, rng = {c: k for k, c in enumerate(labels)}, np.random.default_rng(seed)
    kept_back = [k for k in range(len(rows)) if k % 5 == 4] if len(rows) >= 25 else []
    learnt = [k for k in range(len(rows)) if k % 5 != 4] if kept_back else list(range(len(rows)))
    z, n = np.zeros((DIMS + 1, len(labels))), np.zeros((DIMS + 1, len(labels)))

    def weights(at):
        own, root = z[at], np.sqrt(n[at])
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + root) / alpha + l2))

    inputs = [(np.append(at, DIMS), np.append(weigh(c, idf[at]), 1.0)) for at, c, _ in rows]
    for _ in range(epochs):
        for k in rng.permutation(learnt):
            at, x = inputs[k]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[place[rows[k][2]]] -= 1
            g = x[:, None] * p[None, :]
            before = n[at]
            n[at] = before + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(before)) / alpha * w
    full = weights(np.arange(DIMS + 1))
    model = Model(labels, idf, full[:-1].astype(np.float64), full[-1], 1.0)
    if kept_back:
        logits = np.array([model.logits(rows[k][:2]) for k in kept_back])
        truth = np.array([place[rows[k][2]] for k in kept_back])

        def loss(t):
            s = logits / t
            s = s - s.max(1, keepdims=True)
            return -(s[np.arange(len(s)), truth] - np.log(np.exp(s).sum(1))).mean()

        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
        model.temperature = float(min(grid, key=loss))
    return model


def train(df: DataFrame, text: str = "text", label: str = "lang", sample: int = 3000) -> Model:
    """Learn from all rows of ``df`` that have text and a label (see above for what is sampled)."""
    rows = df.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).filter(F.col("text").isNotNull() & F.col("label").isNotNull())

    def frequency(batches):
        seen, texts = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                for found in features(data, offsets):
                    texts += 1
                    if found is not None:
                        seen[found[0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*seen[at].tolist(), texts], pa.int64())], ["feature", "n"])

    counted = rows.select("text").mapInArrow(frequency, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # at most DIMS + 1 rows
    df_of, total = np.zeros(DIMS), 0
    for feature, n in zip(counted.column("feature").to_pylist(), counted.column("n").to_pylist(), strict=True):
        if feature < 0:
            total = n
        else:
            df_of[feature] = n
    idf = np.log((1 + total) / (1 + df_of)) + 1
    if not total:
        return Model([], idf, np.zeros((DIMS, 0)), np.zeros(0), 1.0)
    share = min(1.0, sample / total)
    drawn = rows.filter(F.pmod(F.xxhash64("text", F.lit("draw")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * sample)

    def extract(batches):
        for batch in batches:
            for own, data, offsets in slices(batch, "text"):
                out = [(f, c) for f, c in zip(features(data, offsets), own.column("label").to_pylist(), strict=True) if f is not None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0].astype(np.int16).tobytes() for f, _ in out], pa.binary()), pa.array([f[1].astype(np.int32).tobytes() for f, _ in out], pa.binary()), pa.array([c for _, c in out], pa.string())],
                    ["at", "counts", "label"],
                )

    got = drawn.mapInArrow(extract, "at binary, counts binary, label string").collect()  # at most 2 x sample rows of at most DIMS entries
    found = sorted(((bytes(r.at), bytes(r.counts), r.label) for r in got))
    examples = [(np.frombuffer(a, np.int16).astype(np.int64), np.frombuffer(c, np.int32).astype(np.int64), label) for a, c, label in found]
    order = np.random.default_rng(1).permutation(len(examples))
    return fit([examples[k] for k in order], idf) if examples else Model([], idf, np.zeros((DIMS, 0)), np.zeros(0), 1.0)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (calibrated probability) to each row."""
    shipped = df.sparkSession.sparkContext.broadcast(model)  # DIMS weights a language
    df, schema = extended(df, [("lang_pred", "string"), ("score", "double")])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, text):
                got = [shipped.value.predict(f) for f in features(data, offsets)]
                yield with_columns(rows, {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())})

    return df.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Whether a row is kept out of learning: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
