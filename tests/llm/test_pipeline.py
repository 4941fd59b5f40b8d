import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from cartograf.llm.tokens import tokenizer_file  # noqa: E402

from .test_neardup import brute as groups  # noqa: E402
from .test_search_chat_langid import WORDS  # noqa: E402


def documents():
    rng = random.Random(11)
    said = lambda lang, n: " ".join(rng.choices(WORDS[lang], k=n - 3) + ["".join(rng.choices("abcdefgh", k=9)) for _ in range(3)])
    rows, passage = [], " ".join("".join(rng.choices("klmnopq", k=6)) for _ in range(60))
    for i in range(150):
        lang = sorted(WORDS)[i % 3]
        text = " ".join("".join(rng.choices("etaoin", k=4)) if rng.random() < 0.3 else rng.choice(WORDS[lang]) for _ in range(rng.choice([8, 40, 120])))
        if i % 10 == 1:
            text = f"{text} {passage} {said(lang, 12)}"
        if i % 10 == 2:
            text += f" bob{i}@mail1.example.com und +1 (811) 555-3281"
        if i % 10 == 3 and i > 20:
            words = rows[i - 19][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if i % 10 == 4 and i > 20:
            text = rows[rng.randrange(20)][1]
        if i % 25 == 7:
            text = rng.choice([None, "", "12 34 !"])
        rows.append((1000 + (i * 37) % 150, text, lang if i % 11 else None, f"s{i % 4}" if i % 13 else None, len(text or "")))
    return rows


def cut_repeats(rows, width):
    first = {}
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - width + 1):
            first[b[k : k + width]] = min(first.get(b[k : k + width], i), i)
    out = {}
    for i, t in rows:
        b, gone = t.encode(), bytearray(len(t.encode()))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        out[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore") if any(gone) else t
    return {i: t for i, t in out.items() if t.strip(" ")}


def test_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    from cartograf.llm.pii import redacted, rule_spans

    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    texts = {i: t for i, t, *_ in rows}
    assert seen["language"] == {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    left = seen["language"]
    want = groups(list(left), list(left.values()), 5, 80)
    assert seen["near_copies"] == {i: t for i, t in left.items() if want[i][1] == i}
    assert len(seen["near_copies"]) < len(left)
    assert seen["repeated_passages"] == cut_repeats(list(seen["near_copies"].items()), corpus_pipeline.PASSAGE)
    assert seen["repeated_passages"] != seen["near_copies"]
    for i, t in seen["repeated_passages"].items():
        rules = redacted(t, rule_spans(t))
        assert seen["personal_data"][i] == rules or not rule_spans(t)
    assert any("[EMAIL]" in t and "[PHONE]" in t for t in seen["personal_data"].values())
    library, got = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), {}
    for r in docs.collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for i, t in seen["personal_data"].items():
        n, at = len(library.encode(t, add_special_tokens=False).ids) + 1, 0
        for start, length, total in sorted(got.pop(i)):
            assert (start, total) == (at, n)
            at += length
        assert at == n
    assert not got


def test_run_and_empty(spark, tmp_path):
    df = spark.createDataFrame(documents()[:12], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "a/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() > 0
    df.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
