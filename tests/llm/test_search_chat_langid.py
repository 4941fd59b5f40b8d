import zlib

import duckdb
import numpy as np
import pytest

from cartograf.llm import ann, chat, langid


def exact(ids, x, every, k):
    out = {}
    for a, q in zip(ids, x):
        if a % every == 0:
            s = x @ q
            out[a] = sorted(((-v, i) for v, i in zip(s, ids) if i != a))[:k]
    return out


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 24)) * rng.uniform(0.3, 2, (700, 1))
    x[50:90] = x[49]  # many equal vectors
    rows = [(i, [float(v) for v in x[i]], "x") for i in range(700)]
    bad = [(1000, None, ""), (1020, [0.0] * 24, ""), (1040, [float("nan")] * 24, ""), (1060, [float("inf")] + [1.0] * 23, ""), (1080, [1.0] * 3, ""), (1100, [None] + [1.0] * 23, ""), (1120, [], "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in ann.search(df, block=100).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want, hits = exact(list(range(700)), x, 20, 20), []
    assert sorted(got) == sorted(want)
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert all(abs(r[2] - x[q] @ x[r[1]]) < 1e-9 for r in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        hits.append(len({r[1] for r in rows} & {i for _, i in want[q]}) / 20)
    assert np.mean(hits) >= 0.9


def test_search_small_and_empty(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in (0, 1, 2)], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert ann.search(df.limit(0)).collect() == []
    assert ann.search(df.limit(1)).collect() == []


def test_search_decides_by_codes(spark):
    """At most 64 + 48 + 32 + 11 x 24 of 4000 vectors are multiplied exactly for a query (10 %)."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 30))[rng.integers(0, 40, 4000)] + 0.7 * rng.normal(size=(4000, 30))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, cells=16, probes=14).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(list(range(4000)), x, 20, 20)
    assert np.mean([len(got[q] & {i for _, i in w}) / 20 for q, w in want.items()]) >= 0.9


def test_table_scan_gives_products_with_decoded_vectors():
    rng = np.random.default_rng(3)
    for d in (5, 12, 32):
        x, asked = rng.normal(size=(500, d)).astype(np.float32), rng.normal(size=(7, d)).astype(np.float32)
        q = ann.fit(x, 2)
        packed = q.encode(x, np.ones(500, int))
        codes = ann.unpacked(packed, len(q.books))
        decoded = q.centres[1] + np.concatenate([b[codes[:, m]] for m, b in enumerate(q.books)], 1)
        assert packed.shape[1] == -(-len(q.books) // 2) and np.allclose(q.scores(asked, packed, 1), asked @ decoded.T, atol=1e-3)


def test_largest_takes_the_first_of_equal_ones():
    s = np.array([[1.0, 3, 3, 2, 3, -np.inf], [0, 0, 0, 0, 0, 0]])
    assert ann.largest(s, 2).tolist() == [[1, 2], [0, 1]] and ann.largest(s, 4).tolist() == [[1, 2, 3, 4], [0, 1, 2, 3]] and ann.largest(s, 9).shape == (2, 6)


def test_anisotropic_codes_beat_plain_ones_on_large_products():
    rng = np.random.default_rng(1)
    x = ann._directions(rng.normal(size=(3000, 32)))
    errors = []
    for threshold in (0.0, 0.4):
        q = ann.fit(x, 1, threshold=threshold)
        codes = ann.unpacked(q.encode(x.astype(np.float32), np.zeros(len(x), int)), len(q.books))
        decoded = q.centres[0] + np.concatenate([b[codes[:, m]] for m, b in enumerate(q.books)], 1)
        errors.append(np.abs(((x - decoded) * x).sum(1)).mean())
    assert errors[1] < errors[0]


def test_perspectives(spark):
    rows = [
        (1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "?"), (1, 3, None, "?"),
        (2, 0, "user", "a\nb"), (2, 1, "assistant", "é😀"), (None, 0, "user", "x"), (3, 0, "system", "alone"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, mask string")
    out = chat.rotate_perspectives(df)
    got = sorted(map(str, (tuple(r) for r in out.collect())))
    conversations = df.drop("mask").toPandas()
    con = duckdb.connect()
    con.register("c", conversations)
    con.sql("create view conversations as select conv_id::bigint conv_id, turn::int turn, role, text from c")
    names = ", ".join(out.columns)
    want = sorted(map(str, con.sql(f"select {names} from ({chat.SQL})").fetchall()))
    assert got == want
    first = {(r.perspective, r.turn): r for r in out.collect() if r.conv_id == 1}
    assert first["ann", 1].rendered == "<|im_start|>assistant\nhi<|im_end|>\n" and first["ann", 1].mask == 1
    assert first["bob", 1].rendered == "<|im_start|>user name=ann\nhi<|im_end|>\n" and first["bob", 1].mask == 0
    r = first["ann", 1]
    assert r.rendered[r.learn_start : r.learn_start + r.learn_chars] == "hi<|im_end|>\n"
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


WORDS = {"en": ["the", "thing", "shore", "other", "wherein"], "de": ["über", "schön", "nicht", "zwischen", "straße"], "fr": ["être", "oiseau", "leçon", "eaux", "qu'une"]}


def sentences(n):
    rng = np.random.default_rng(4)
    return [(i, " ".join(rng.choice(WORDS[c], 12)), c) for i in range(n) for c in [sorted(WORDS)[i % 3]]]


def test_language_id(spark):
    rows = [*sentences(240), (900, None, "en"), (901, "12 !", "en"), (902, "", None), (903, "schön über nicht " * 9000, None), (904, "the thing", None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, SCORE int").withColumn("held_out", langid.held_out())
    model = langid.train(df.filter("not held_out"))
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    for i, text, lang in rows[:240]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == lang
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "de", "en"]
    assert (model.weights == 0).mean() > 0.5


def test_language_id_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    r = langid.identify(df, langid.train(df)).collect()[0]
    assert (r.lang_pred, r.score) == ("und", 0.0)


@pytest.mark.parametrize("text", ["", "aÄb", "x" * 70000])
def test_features_count_n_grams(text):
    data = np.frombuffer(text.encode(), np.uint8)
    got = next(iter(langid.features(data, np.array([0, len(data)]))))
    if not text:
        assert got is None
    else:
        assert got[1].sum() == 3 * len(text) - 3
