"""Cases that every operator has to settle: empty tables, repeated rows, very long texts, clashing names; features by plain code."""

import hashlib

import numpy as np
import pytest

from cartograf.llm import ann, chat, flac
from cartograf.llm.neardup import near_duplicates

LONG = "the quick naïve fox, it's  1234 lines\n" * 20_000


def test_token_counts_of_repeated_rows(spark):
    tokens = pytest.importorskip("cartograf.llm.tokens")
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, None), (2, LONG)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(df).collect())
    assert got[0] == (1, 0, 0) and got[1] == got[2] and got[1][:2] == (1, 3) and got[3][1] == len(LONG.encode())


def test_round_trip_of_empty_table_long_text_and_clashing_names(spark):
    tokens = pytest.importorskip("cartograf.llm.tokens")
    df = spark.createDataFrame([(1, LONG, "x", 5), (1, LONG, "y", 6), (2, "", "z", 7)], "doc_id long, text string, IDS string, N_Tokens int")
    out = tokens.encode_bytes(df)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    rows = sorted(out.collect(), key=lambda r: r.doc_id)
    assert rows[0][2:] == rows[1][2:] and rows[0].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert (rows[2].n_tokens, rows[2].ids, rows[2].decoded_sha256) == (0, [], hashlib.sha256(b"").hexdigest())
    assert tokens.encode_bytes(df.limit(0)).collect() == []


def test_proof_is_shipped(spark):
    tokens = pytest.importorskip("cartograf.llm.tokens")
    content = tokens.vocabulary(tokens.tokenizer_file("byte_bpe_50k.json"))
    vocab = tokens.load_json(content.decode())
    whole = tokens.provably_whole(vocab)
    encoder, _ = tokens.merging_encoder(content, tokens.proof(content))
    assert len(encoder.sure) == len(whole) and set(encoder.sure_ids.tolist()) == set(whole.values())


def test_media_features_by_plain_code(spark):
    texts = ["", "a", "héllo \x00\x7f" * 70, "x" * 192, LONG[:70_001], None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.feature for r in flac.read_back(flac.store(df)).collect()}
    for i, text in enumerate(texts):
        body = (text or "").encode()
        x = [b - 128 for b in body + b" " * (max(192, -(-len(body) // 192) * 192) - len(body))]
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        want = f"samples={len(x)};peak={max(map(abs, x))};energy={sum(v * v for v in x)};turns={turns};steps={sum(abs(b - a) for a, b in zip(x, x[1:]))}"
        assert got[i] == want


def test_near_copies_of_very_long_texts(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in rng.integers(0, 40_000, 60_000)]
    other = list(words)
    other[::40] = ["new"] * len(other[::40])  # four of 40 shingles differ: 36 of 44 are shared
    rows = [(5, " ".join(words)), (3, " ".join(other)), (9, " ".join(words[::-1])), (4, "word " * 100_000), (4, None), (7, "word " * 90_000)]
    got = sorted((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, Kept int"), size=4, percent=80).collect())
    sets = {i: len(set(zip(w, w[1:], w[2:], w[3:]))) for i, t in rows if t and i != 4 for w in [t.split()]}
    assert [g[:3] for g in got if g[0] != 4] == [(3, 3, True), (5, 3, False), (7, 4, False), (9, 9, True)]
    assert all(g[3] == sets[g[0]] for g in got if g[0] != 4)


def test_perspectives_of_very_long_texts_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, "ann", LONG, "x"), (1, 1, "bob", "ok", "y")], "conv_id long, turn int, role string, text string, Rendered string")
    got = {(r.perspective, r.turn): r for r in chat.rotate_perspectives(df).collect()}
    assert sorted(got) == [("ann", 0), ("ann", 1), ("bob", 0), ("bob", 1)]
    r = got["ann", 0]
    assert r.rendered == f"<|im_start|>assistant\n{LONG}<|im_end|>\n" and r.rendered[r.learn_start : r.learn_start + r.learn_chars] == LONG + "<|im_end|>\n"


def test_search_of_repeated_ids_and_clashing_names(spark):
    rows = [(0, [1.0, 0.0], 9, "a"), (0, [0.0, 1.0], 9, "a"), (1, [2.0, 1.0], 9, "a"), (1, [2.0, 1.0], 9, "a"), (2, [1.0, 3.0], 9, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, Score int, query_id string")
    out = ann.search(df)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    got = out.collect()
    assert {r.query_id for r in got} == {0} and all(r.vec_id != 0 for r in got)
    assert max(r.score for r in got) == 3.0
