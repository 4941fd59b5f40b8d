import base64
import hashlib

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from cartograf.llm import tokens as K  # noqa: E402
from cartograf.llm.bpe import Backtracker, Encoder, Merger, load_json, load_ranks, merge, split  # noqa: E402

JSON = open(P.path("byte_bpe_50k.json"), "rb").read()
RANKS = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
SAMPLES = [
    "", " ", "  ", "a", "it's 'twas we'll  they've\tI'd you're O'Neil's''s .'s \t's", "x  y\n\n z \n", "tail   ", "ÄÖ über été 中文字 ١٢٣ x²",
    "a b　 c  d", "<|endoftext|>mid<|endoftext|> <|endoftext", "😀 ok’s ’s", "a" * 300, " " * 50 + "x", "\r\n\r\n", "'re'reretro 's's", "1'd 2'll'll3",
    "'", "''", "'s", " 's", "\n's", "it'", "we'l", "we'v", "q're", "\x1c\x1d a\x85b", "്‍ abc" ,
]


def naive(texts):
    pattern = regex.compile(P.PATTERN)
    return [[m.group().encode() for m in pattern.finditer(t)] for t in texts]


def ours(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    starts = split(data, bounds)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        s = [x for x in starts if a <= x < b]
        out.append([data[x:y].tobytes() for x, y in zip(s, [*s[1:], b])])
    return out


def test_split_matches_pattern():
    assert ours(SAMPLES) == naive(SAMPLES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="a'strevlmd 1\n\t.é !", max_size=14), max_size=5))
def test_split_random(texts):
    assert ours(texts) == naive(texts)


def library(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_str(JSON.decode()).encode_batch(texts, add_special_tokens=False)]


def tik(texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [e.encode_ordinary(t) for t in texts]


def test_counts_and_ids_match_library(spark):
    rows = [(i, t, "x") for i, t in enumerate([*SAMPLES, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string")
    got = {r.doc_id: r for r in K.count_tokens(df, limit=10).collect()}
    want = library([t or "" for _, t, _ in rows])
    for i, t, _ in rows:
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(want[i]), len((t or "").encode()), len(want[i]) > 10), t
    assert K.count_tokens(df.limit(0)).count() == 0
    encoder, specials = K.merging_encoder(JSON, K.proof(JSON))
    data = np.frombuffer("".join(SAMPLES).encode(), np.uint8)
    flat, at = K.encode_slice(encoder, specials, data, np.cumsum([0, *(len(t.encode()) for t in SAMPLES)]))
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == want[:-1]


def test_round_trip_matches_library(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*SAMPLES, None])], "doc_id long, text string")
    want = tik([*SAMPLES, ""])
    for r in K.encode_bytes(df).collect():
        assert r.ids == want[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_long_texts_are_cut_only_where_no_match_goes_on():
    text = "word, it's  fine\n" * 200
    encoder, _ = K.merging_encoder(JSON, K.proof(JSON))
    data = np.frombuffer(text.encode(), np.uint8)
    from cartograf.llm.bpe import pieces

    bounds, owner, _ = pieces(data, np.array([0, len(data)]), {}, limit=100)
    assert len(bounds) > 20
    assert split(data, bounds[:-1]).tolist() == split(data, np.array([0])).tolist()


def test_encoders_agree_on_corpus_words():
    import duckdb

    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' where text is not null limit 60").fetchall()]
    words = sorted({w for t in naive(texts) for w in t})
    vocab = load_ranks(RANKS)
    back, step = Backtracker(vocab), Merger(vocab)
    data = np.frombuffer(b"".join(words), np.uint8)
    n = np.array([len(w) for w in words])
    flat, counts = step(data, np.cumsum(n) - n, n)
    at = np.cumsum(counts) - counts
    for k, w in enumerate(words):
        plain = merge(w, vocab, step.byte_ids)
        assert back.encode(w) == plain == flat[at[k] : at[k] + counts[k]].tolist()
    assert tik(texts) == [list(x) for x in _ids(Encoder(back), texts)]
    assert library(texts) == [list(x) for x in _ids(Encoder(Merger(load_json(JSON.decode()))), texts)]


def _ids(encoder, texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    flat, at = encoder.encode_all(data, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    return [flat[a:b].tolist() for a, b in zip(at, at[1:])]
