import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from cartograf.llm import packing  # noqa: E402
from cartograf.llm.packing import FRACTION, Mixture, pack  # noqa: E402
from cartograf.llm.tokens import tokenizer_file  # noqa: E402


def brute(totals, quanta):
    """The queue of each token and the counters before each round, by plain deficit round-robin."""
    left, counters, out, before = list(totals), [Fraction(0)] * len(totals), [], []
    while any(left):
        before.append(list(counters))
        for q in range(len(totals)):
            counters[q] += quanta[q]
            while left[q] and counters[q] >= 1:
                out.append(q)
                left[q] -= 1
                counters[q] -= 1
            if not left[q]:
                counters[q] = Fraction(0)
    return out, before


@pytest.mark.parametrize("seed", range(30))
def test_mixture_is_deficit_round_robin(seed):
    rng = random.Random(seed)
    n, window = rng.randint(1, 6), rng.choice([8, 50, 100])
    totals = [rng.randint(1, 90) for _ in range(n)]
    weights = totals if seed % 2 else [rng.randint(1, 9) for _ in range(n)]
    mixture = Mixture(totals, weights, window)
    turn = max(1, window // 16)
    quanta = [Fraction(int(x), 1 << FRACTION) for x in mixture.quantum]
    assert all(abs(x - Fraction(w * turn, sum(weights))) <= Fraction(1, 1 << FRACTION) for x, w in zip(quanta, weights))
    order, before = brute(totals, quanta)
    places = list(range(len(order) + 2))
    rng.shuffle(places)
    for position in places:
        assert mixture.given(position).tolist() == [order[:position].count(q) for q in range(n)]
    for r, counters in enumerate(before):
        assert [Fraction(int(x), 1 << FRACTION) for x in mixture.deficits(r)] == counters
    for q in range(n):
        ranks = [k for k, x in enumerate(order) if x == q]
        for i in range(totals[q]):
            w = mixture.find(q, i)
            assert w == ranks[i] // window
            begin, end, offsets = mixture.at(w)
            assert begin[q] <= i < end[q] and offsets[q] == sum(int(e - b) for b, e in zip(begin[:q], end[:q]))


def test_windows_hold_the_targets_far_into_a_large_stream():
    totals = [70_000_000_000, 30_000_000_001, 999_999, 3]
    mixture = Mixture(totals, totals, 2048)
    for w in (0, 1, 17, 10_000_000, 48_828_000):
        begin, end, _ = mixture.at(w)
        assert (end - begin).sum() == 2048 and abs(int((end - begin)[0]) - 2048 * 0.7) <= 128


def test_pack_tiles_documents_and_sequences(spark):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    words = ["alpha", "beta", "<|endoftext|>", "γάμμα", "x1", "\n", "don't"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 900]))) if i % 9 else None, rng.choice(["a", "b", "b", "b", None]), i) for i in range(60)]
    rows += rows[3:6]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Length long").repartition(5)
    got = pack(df, window=256).collect()
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids == want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
    copies = {i: [x[0] for x in rows].count(i) for i, *_ in rows}
    for i, ids in want.items():
        assert sum(r.length for r in by_doc[i]) == copies[i] * len(ids)
    total = sum(copies[i] * len(ids) for i, ids in want.items())
    for s, spans in by_sequence.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == min(256, total - 256 * s)
    assert sorted(by_sequence) == list(range(-(-total // 256)))
    assert pack(df.limit(0)).count() == 0


def test_targets_hold_in_each_window(spark):
    df = spark.createDataFrame([(i, "word " * 40, "a" if i % 2 else "b") for i in range(60)], "doc_id long, text string, source string")
    got = pack(df, window=100, targets={"a": 3, "b": 1}).collect()
    source = {i: "a" if i % 2 else "b" for i in range(60)}
    first = [r for r in got if r.sequence_id < 10]
    for s in range(10):
        assert abs(sum(r.length for r in first if r.sequence_id == s and source[r.doc_id] == "a") - 75) <= 6  # one turn


def test_more_sources_than_queues_keep_their_targets(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_QUEUES", 4)
    df = spark.createDataFrame([(i, "word " * 40, None if i == 1 else "big" if i % 2 else f"s{i % 20}") for i in range(120)], "doc_id long, text string, source string")
    got = pack(df, window=100, targets={"big": 30}).collect()  # ten others of weight 1, and null
    first = [r for r in got if r.sequence_id < 10]
    assert abs(sum(r.length for r in first if r.doc_id % 2) - 1000 * 30 / 41) < 40
    assert {r.doc_id for r in got} == set(range(120)) and max(max(r.ids) for r in pack(df, end_id=70_000).collect()) == 70_000
