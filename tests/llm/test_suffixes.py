import hashlib
import random

import numpy as np
import pytest

from cartograf.llm import suffixes as S


def brute(rows, width):
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - width + 1):
                w = b[k : k + width]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        if i is not None:
            for k in range(len(b) - width + 1):
                if first[b[k : k + width]] < i:
                    gone[k : k + width] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(b)]).sum())
        out.append((i, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    letters = "abcdefghé ñ"
    passages = ["".join(rng.choices(letters, k=rng.choice([30, 50, 51, 60, 120]))) for _ in range(8)]
    texts = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            x = rng.random()
            if x < 0.4:
                parts.append(rng.choice(passages))
            elif x < 0.5 and texts:
                t = rng.choice(texts) or ""
                a = rng.randrange(len(t) + 1)
                parts.append(t[a : a + rng.choice([20, 49, 50, 55, 90])])
            elif x < 0.58:
                parts.append(rng.choice(["-", "ab", "a"]) * rng.choice([20, 49, 50, 80]))
            else:
                parts.append("".join(rng.choices(letters, k=rng.randint(1, 90))))
        texts.append(rng.choice([None, "", texts[-1] if texts else ""]) if rng.random() < 0.12 else "".join(parts))
    return texts


@pytest.mark.parametrize("seed,sample,limit", [(1, 3000, 2 << 20), (2, 5, 2 << 20), (3, 3000, 400)])
def test_against_brute_force(spark, monkeypatch, seed, sample, limit):
    if seed == 2:  # many small piles, each cut by quicksort
        monkeypatch.setattr(S, "PILE", 3000)
        monkeypatch.setattr(S, "SMALL", 4)
        monkeypatch.setattr(S, "SHOWN", 5000)
    texts = corpus(seed, 150)
    rng = random.Random(seed)
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts))
    rows += [(None, rows[3][1]), rows[5], rows[6], (ids[7], texts[8])]  # no id, repeated rows, another text under one id
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, N_SPANS int").repartition(4)
    got = S.remove_repeats(df, sample=sample)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"]
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=str)
    assert found == brute(rows, 50)
    assert sum(r[2] for r in found) > 500


@pytest.mark.parametrize("width", [20, 100])
def test_other_widths_and_tokens_at_the_end(spark, width):
    texts = [t for t in corpus(9, 90) if t] + ["z" * 60 + "tail of a text that ends here!!", "q" * 60 + "tail of a text that ends here!!"] * 3
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df, width=width).collect()), key=str)
    assert found == brute(rows, width)


def test_empty_and_short(spark):
    df = spark.createDataFrame([(1, "short"), (2, "short"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in S.remove_repeats(df).collect()) == [(1, 0), (2, 0), (3, 0)]
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_equal_windows_name_one_token():
    rng = random.Random(8)
    passage = bytes(rng.choices(b"abcdef ", k=50))
    texts = [bytes(rng.choices(b"abcdef ", k=rng.randint(0, 60))) + passage + bytes(rng.choices(b"abcdef ", k=rng.randint(0, 60))) for _ in range(30)]
    seen = set()
    for t in texts:
        _, place, first, last, _ = S.suffixes(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 50)
        at = t.find(passage)
        k = np.flatnonzero((first <= at) & (at <= last))
        seen.add(int(place[k[0]] - at))
    assert len(seen) == 1


def test_multikey_order():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 3, (500, 19), dtype=np.uint8)
    order, common = S.prefix_order(rows)
    strings = [bytes(r) for r in rows]
    assert [strings[i] for i in order] == sorted(strings)
    for k in range(1, 500):
        a, b = strings[order[k - 1]], strings[order[k]]
        assert common[k] == next((i for i in range(19) if a[i] != b[i]), 19)


@pytest.mark.parametrize("n", [0, 1, 5, 40, 3000])
def test_multikey_quicksort(monkeypatch, n):
    monkeypatch.setattr(S, "SMALL", 20)
    rng = np.random.default_rng(n)
    words = rng.integers(0, 4, (n, 5)).astype(np.uint64)
    words[::3] = words[: len(words[::3])] if n else words
    got = words[S.multikey_order(words)]
    assert (got == words[np.lexsort(words.T[::-1])]).all()


def test_piles_keep_leading_tokens_together(monkeypatch):
    monkeypatch.setattr(S, "PILE", 4000)
    rng = np.random.default_rng(3)
    reach, width = 34, 50
    rows = rng.integers(0, 3, (2000, reach + width)).astype(np.uint8)
    rows[:, reach + 3 : reach + 16] = 7
    kinds, doc = [np.int64, np.dtype(f"V{reach + width}")], np.arange(2000)
    bodies = [b for a in range(0, 2000, 300) for _, b in S.blocks(np.zeros(len(doc[a : a + 300]), np.int32), [doc[a : a + 300], np.ascontiguousarray(rows[a : a + 300]).view(f"V{reach + width}").ravel()])]
    seen, tokens = [], []
    for pile in S.piles(bodies, kinds, reach):
        own, shown = S.unblock(pile, kinds)
        seen += own.tolist()
        tokens.append({rows[k, reach : reach + 16].tobytes() for k in own.tolist()})
    assert sorted(seen) == doc.tolist() and len(tokens) > 10
    assert sum(map(len, tokens)) == len(set().union(*tokens))
