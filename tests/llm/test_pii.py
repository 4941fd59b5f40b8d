import hashlib
import re

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from cartograf.llm import pii


def contract(text):
    """The rules as regular expressions, word for word."""
    found = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == 1 and any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or "0") > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], s[2]))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1.@-+ (_0é", max_size=40))
@example("a@b.c@d.e_x@f.g h@i. @j.k a@b..c x@y-.z")
@example("1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3.4.")
@example("+1 (811) 555-3281--- +12 +1234567890123456")
def test_rules(text):
    assert pii.rule_spans(text) == contract(text)


def test_long_parts_of_addresses():
    for part, found in (("0" * 5000 + "1", 1), ("0" * 9000, 1), ("9" * 5000, 0), ("0" * 5000 + "256", 0), ("0" * 5000 + "255", 1)):
        text = "ip 1.2.3." + part + " end"
        assert [s for s in pii.rule_spans(text) if s[2] == 1] == [s for s in contract(text) if s[2] == 1] == [(3, 9 + len(part), 1)] * found


def test_rules_on_long_runs():
    assert pii.rule_spans("1" * 60_000 + "a" * 60_000 + "." * 60_000 + "+1" + " " * 60_000) == []


def test_gradients():
    rng = np.random.default_rng(0)
    model = pii.Tagger.fresh(rng)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    chars, tags = rng.integers(0, pii.CLASSES, (7, 3)), rng.integers(0, pii.TAGS, (7, 3))
    _, g = model.gradients(chars, tags)
    for name, w in model.w.items():
        at = tuple(rng.integers(0, s) for s in w.shape) if name != "embed" else (int(chars[2, 1]), 3)
        old = w[at]
        w[at] = old + 1e-3
        up, _ = model.gradients(chars, tags)
        w[at] = old - 1e-3
        down, _ = model.gradients(chars, tags)
        w[at] = old
        assert (up - down) / 2e-3 == pytest.approx(g[name][at], rel=0.02, abs=2e-4), name


def test_decoding_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    model = pii.Tagger.fresh(rng)
    model.w["trans"] = rng.normal(size=(pii.TAGS, pii.TAGS)).astype(np.float32)
    chars = rng.integers(0, pii.CLASSES, (2, 4))
    e = model.emissions(np.ascontiguousarray(chars.T))
    for k, got in enumerate(model.decode(chars)):
        score = lambda p: sum(e[t, k, y] for t, y in enumerate(p)) + sum(model.w["trans"][a, b] for a, b in zip(p, p[1:]))
        assert score(got) == pytest.approx(max(map(score, itertools.product(range(pii.TAGS), repeat=4))), abs=1e-4)


def test_held_out_accuracy():
    model, hit, false, total = pii.trained(), 0, 0, 0
    for text, spans in pii.labelled(np.random.default_rng(99), 200):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        tags = pii.tagged(model, codes, np.array([0, len(codes)]))
        for a, b, k in spans:
            total += 1
            hit += bool((tags[a:b] == k + 1).mean() > 0.8)
        outside = np.ones(len(codes), bool)
        for a, b, _ in spans:
            outside[a:b] = False
        false += int((tags[outside] > 0).sum())
    assert hit / total > 0.85 and false / total < 2


def test_long_stretches_agree_across_windows():
    model = pii.trained()
    text = "call (555) 123-4567 now 12:30 or " * 40
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    tags = pii.tagged(model, codes, np.array([0, len(codes)]))
    found = pii.added_spans(text, tags, [])
    assert sum(text[a:b] == "(555) 123-4567" for a, b, _ in found) >= 36


def test_windows_read_suffice():
    model, rng = pii.trained(), np.random.default_rng(4)
    texts = [t for t, _ in pii.labelled(rng, 60)] + ["", "a" * 200, "x" * 150 + "@" + "y" * 150]
    texts = ["".join(texts[k] if rng.random() < 0.5 else "plain words here, " * int(rng.integers(1, 12)) for k in rng.integers(0, len(texts), 6)) for _ in range(60)] + texts
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    bounds = np.cumsum([0, *map(len, texts)])
    some, every = pii.tagged(model, codes, bounds), pii.tagged(model, codes, bounds, whole=True)
    for t, a, b in zip(texts, bounds, bounds[1:]):
        rules = pii.rule_spans(t)
        assert pii.added_spans(t, some[a:b], rules) == pii.added_spans(t, every[a:b], rules)


@pytest.mark.parametrize("local", [10, 25, 38, 70])
@pytest.mark.parametrize("host", ["localhost", "mailhost-of-the-intranet-of-this-house"])
def test_long_addresses_are_whole(spark, local, host):
    address = ("margarethe_von_" * 8)[: local - 1] + "a@" + host
    texts = [before + address + after for before in ("", "please write to ", "word " * 30) for after in ("", " about it")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.clean_text for r in pii.find_personal_data(df).collect()}
    assert got == {k: t.replace(address, "[EMAIL]") for k, t in enumerate(texts)}


def test_columns(spark):
    rows = [(1, "é mail bob.9@mail7.example.com, 10.0.0.1 and 4652511922028856 or +1 (811) 555-3281.", 1), (2, None, 2), (3, "nothing here", 3), (4, "", 4), (5, "call 555-123-4567 or root@server today", 5), (6, "word " * 20000 + "9.9.9.9", 6), (6, "word " * 20000 + "9.9.9.9", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Spans long")
    out = pii.find_personal_data(df)
    assert out.columns == ["doc_id", "text", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "clean_text"]
    got = {r.doc_id: r for r in out.collect()}
    for i, t, _ in rows:
        base = contract(t or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == j for s in base) for j in range(4)]
        assert got[i].base_sha256 == hashlib.sha256(pii.shown(base).encode()).hexdigest()
        assert set(filter(None, pii.shown(base).split(","))) <= set(got[i].spans.split(","))
    assert got[1].clean_text == "é mail [EMAIL], [IP] and [CARD] or [PHONE]."
    assert got[2].clean_text is None and got[3].spans == "" and got[6].clean_text.endswith("word [IP]")
    assert out.count() == len(rows) and pii.find_personal_data(df.limit(0)).count() == 0
