import random
import re

import duckdb
import numpy as np
import pytest

from cartograf.llm import neardup
from cartograf.llm import components as components_module
from cartograf.llm.components import components, least_reachable, union_find


def sets(texts, size):
    out = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def brute(ids, texts, size, percent):
    """Exact components by an inverted index over shingles."""
    s, where, edges = sets(texts, size), {}, []
    for k, x in enumerate(s):
        met = {}
        for e in x:
            for j in where.setdefault(e, []):
                met[j] = met.get(j, 0) + 1
            where[e].append(k)
        edges += [(ids[k], ids[j]) for j, c in met.items() if 100 * c >= percent * (len(x) + len(s[j]) - c)]
    found = union_find(edges)
    return {i: (len(x), found.get(i, i)) for i, x in zip(ids, s)}


def test_shingles_match_plain_code():
    texts = ["", "one", "One two", "a b c d", "a b c d e a b c d", " x\ty\nz\x0bq é Ü ", "a b c  d", "   ", "tail end "] * 3
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    got, at = neardup.shingle_sets(data, np.cumsum([0, *(len(t.encode()) for t in texts)]), 4)
    want = sets(texts, 4)
    assert np.diff(at).tolist() == [len(x) for x in want]
    own = [set(got[a:b].tolist()) for a, b in zip(at, at[1:])]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(own[i] & own[j]) == len(want[i] & want[j])


def test_signature_is_the_published_sequence():
    rng = np.random.default_rng(2)
    m, e = 16, rng.integers(0, 2**63, 40, dtype=np.uint64)
    got = neardup.super_minhash(e, np.array([0, 3, 40]), m)
    for doc, part in enumerate((e[:3], e[3:])):
        want = np.full(m, 2**64 - 1, np.uint64)
        for x in part:  # element by element, without stopping early
            p = list(range(m))
            for rank in range(m):
                noise = int(neardup.mix64(np.array([x], np.uint64) + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))[0])
                k = rank + (noise & 0xFFFFFFFF) % (m - rank)
                p[rank], p[k] = p[k], p[rank]
                want[p[rank]] = min(int(want[p[rank]]), rank << 32 | noise >> 32)
        assert got[doc].tolist() == want.tolist()


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        e = rng.integers(0, 2**63, 300, dtype=np.uint64)
        sig = neardup.super_minhash(np.concatenate([e[:200], e[100:]]), np.array([0, 200, 400]))
        errors.append((sig[0] == sig[1]).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.02


def test_long_document_in_several_turns(monkeypatch):
    e = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = neardup.super_minhash(e, np.array([0, 1000]), 64)
    monkeypatch.setattr(neardup, "FIT", 130)
    assert (neardup.super_minhash(e, np.array([0, 1000]), 64) == whole).all()


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.25:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.7:
            w = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.choice([1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
        elif kind < 0.75:
            texts.append(rng.choice(["", None, " ", "Hi", "hi", "a b c"]))
        else:
            texts.append(" ".join(rng.choices(vocab, k=rng.choice([5, 20, 60, 150, 400]))))
    return texts


@pytest.mark.parametrize("seed,reps", [(1, 8), (2, 1)])
def test_groups_match_brute_force(spark, monkeypatch, seed, reps):
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(10_000), len(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, KEPT int").repartition(3)
    want = brute(ids, texts, 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, size=4).collect()}
    assert got == want


@pytest.mark.parametrize("copies", [300, 3000])
def test_stars_are_joined_by_their_centre(spark, copies):
    """Copies edited each at places of its own: similar enough to the base, not to one another."""
    rng = random.Random(copies)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(base)]
    for k in range(copies):
        own = list(base)
        for at in rng.sample(range(0, 200, 4), 5):
            own[at] = f"x{k}y{at}"
        texts.append(" ".join(own))
    own = sets(texts[:60], 4)
    assert all(len(x & own[0]) >= 0.8 * len(x | own[0]) for x in own)
    assert sum(len(x & y) >= 0.8 * len(x | y) for x in own[1:] for y in own[1:] if x is not y) < 60
    ids = rng.sample(range(10**6), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, size=4).collect()}
    assert got == dict.fromkeys(ids, min(ids))


def test_wide_bands_of_several_groups(spark):
    """Documents that share half of their text meet in wide bands without being alike."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for k in range(40):
        half = base[:140] + [f"k{k}v{i}" for i in range(60)]
        for j in range(6):
            own = list(half)
            for at in rng.sample(range(0, 200, 4), 4):
                own[at] = f"x{k}y{j}z{at}"
            texts.append(" ".join(own))
    ids = rng.sample(range(10**6), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, size=4).collect()}
    assert got == brute(ids, texts, 4, 80)


def test_empty_null_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (3, None), (4, ""), (5, "A b c d e")], "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in neardup.near_duplicates(df, size=4).collect())))
    assert got == sorted(map(str, [(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (3, 0, 3, True), (4, 0, 4, True), (5, 2, 1, False)]))
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    want = union_find([e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in components(df).collect()} == want


def test_recall_on_the_corpus(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = duckdb.sql(f"select doc_id, text from '{path}'").fetchall()
    want = brute([r[0] for r in rows], [r[1] for r in rows], 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.read.parquet(path), size=4).collect()}
    assert got == want


def family(n, pairs, seed=4):
    """Texts of 100 shingles around one template, 88 of 112 shingles in common; of ``pairs`` of them two more are shared (90 of 110)."""
    rng = random.Random(seed)
    body = [f"t{k}" for k in range(103)]
    texts = []
    for k in range(n + pairs):
        w, own = list(body), lambda j, k=k: f"u{k}x{j}"
        w[0], w[1], w[40], w[60], w[101], w[102] = (own(j) for j in range(6))
        if k >= n:  # partner of a document before
            w[0], w[1] = f"u{k - n}x0", f"u{k - n}x1"
        texts.append(" ".join(w))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts)), {ids[k + n]: min(ids[k], ids[k + n]) for k in range(pairs)} | {ids[k]: min(ids[k], ids[k + n]) for k in range(pairs)}


def test_links_inside_a_boilerplate_family(spark):
    rows, partner = family(500, 60)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=4, percent=80)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: partner.get(i, i) for i, _ in rows}


def test_overlaps_count_shared_elements(monkeypatch):
    monkeypatch.setattr(neardup, "FEW", 5)
    rng = np.random.default_rng(6)
    own = [np.unique(rng.integers(0, 60, rng.integers(0, 25))).astype(np.uint32) for _ in range(40)]
    got = neardup.overlaps(np.concatenate(own), np.cumsum([0, *map(len, own)]))
    for i in range(40):
        for j in range(i):
            assert got[i, j] == got[j, i] == len(np.intersect1d(own[i], own[j]))


def test_alike_pairs_of_two_blocks():
    own = [np.arange(10, dtype=np.uint32)] * 4
    block, group = np.array([0, 0, 1, 1]), np.array([1, 2, 1, 3])
    i, j = neardup.alike(block, np.full(4, 10), group, np.concatenate(own), np.arange(0, 41, 10), 80)
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 3), (1, 2), (1, 3)]


def test_wide_bands_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 40)
    rows, partner = family(150, 20, seed=9)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=4, percent=80)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: partner.get(i, i) for i, _ in rows}


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components_by_rounds_and_by_one_task(spark, monkeypatch, one_task):
    monkeypatch.setattr(components_module, "ONE_TASK", one_task)
    rng = random.Random(one_task)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 2000 + k) for k in range(50)]
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(4))
    want = union_find([e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in got.collect()} == want
    node, least = least_reachable(*np.array(edges).T)
    assert {k: v for k, v in zip(node.tolist(), least.tolist()) if k in want} == want
