"""Language identification against plain code: features, document frequencies, FTRL steps, temperature, scores."""

import math
from collections import Counter

import numpy as np
import regex

from cartograf.llm import langid

WORDS = {"en": ["the", "thing", "shore", "other", "wherein"], "de": ["über", "schön", "nicht", "zwischen", "straße"], "fr": ["être", "oiseau", "leçon", "eaux", "qu'une"]}


def texts(n):
    rng = np.random.default_rng(4)
    return [(i, " ".join(rng.choice(WORDS[c], 12)) + " " + " ".join(rng.choice(WORDS["en"], 4)), c) for i in range(n) for c in [sorted(WORDS)[i % 3]]]


def plain_features(text):
    """Counts of hashed 1- to 3-grams; empty for a text without letters."""
    chars = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in (c if regex.match(r"\p{L}", c) else " " for c in text)]
    if all(c == 32 for c in chars):
        return Counter()
    out, mask = Counter(), 0xFFFFFFFF
    for size in (1, 2, 3):
        for at in range(len(chars) - size + 1):
            h = 0
            for c in chars[at : at + size]:
                h = ((h ^ c) * 0x9E3779B1) & mask
                h ^= h >> 15
            out[((h * 0x85EBCA6B) & mask) >> 17] += 1
    return out


def plain_idf(corpus):
    seen = Counter(f for t in corpus for f in plain_features(t))
    return lambda f: math.log((1 + len(corpus)) / (1 + seen[f])) + 1


def plain_weights(counts, idf):
    x = {f: (1 + math.log(c)) * idf(f) for f, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {f: v / norm for f, v in x.items()}


def softmax(s):
    e = [math.exp(v - max(s)) for v in s]
    return [v / sum(e) for v in e]


def plain_fit(rows, idf, alpha=1.0, beta=1.0, l1=0.02, l2=0.02, epochs=3, seed=3):
    labels = sorted({label for *_, label in rows})
    z, n = Counter(), Counter()

    def weight(f, k):
        v = z[f, k]
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n[f, k])) / alpha + l2)

    inputs = [plain_weights(c, idf) | {-1: 1.0} for c, _ in rows]
    score = lambda x: [sum(v * weight(f, k) for f, v in x.items()) for k in range(len(labels))]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation([k for k in range(len(rows)) if k % 5 != 4]):
            x = inputs[r]
            p = softmax(score(x))
            for k, label in enumerate(labels):
                for f, v in x.items():
                    g = v * (p[k] - (label == rows[r][1]))
                    w = weight(f, k)
                    z[f, k] += g - (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) / alpha * w
                    n[f, k] += g * g
    back = [(score(inputs[k]), labels.index(rows[k][1])) for k in range(4, len(rows), 5)]
    loss = lambda t: -sum(math.log(softmax([v / t for v in s])[k]) for s, k in back)
    grid = [math.exp(math.log(0.05) + j * (math.log(5) - math.log(0.05)) / 59) for j in range(60)]
    return labels, weight, score, min(grid, key=loss)


def found(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return next(iter(langid.features(data, np.array([0, len(data)]))))


def test_features_are_those_of_plain_code():
    for text in ["", "12 ?!", "Ab c", "ÄöÜ ß, İx\n\n中文 é", "the thing " * 5, "x" * 9000 + " Ωmega", "naïve " * 7000]:
        got = found(text)
        assert ({} if got is None else dict(zip(got[0].tolist(), got[1].tolist()))) == plain_features(text), text[:20]
        assert got is None or (np.diff(got[0]) > 0).all()


def test_steps_and_temperature_are_those_of_plain_code():
    rows = texts(40)
    idf = plain_idf([t for _, t, _ in rows])
    table = np.array([idf(f) for f in range(langid.DIMS)])
    model = langid.fit([(*found(t), c) for _, t, c in rows], table)
    labels, weight, score, temperature = plain_fit([(plain_features(t), c) for _, t, c in rows], idf)
    assert model.labels == labels and abs(model.temperature - temperature) < 1e-9
    used = sorted({f for _, t, _ in rows for f in plain_features(t)})
    assert np.allclose(model.weights[used], [[weight(f, k) for k in range(3)] for f in used], atol=1e-9)
    assert np.allclose(model.bias, [weight(-1, k) for k in range(3)], atol=1e-9)
    assert not model.weights[[f for f in range(langid.DIMS) if f not in set(used)]].any()
    for text in ("über the leçon", "zwischen", "q"):
        p = softmax([v / temperature for v in score(plain_weights(plain_features(text), idf) | {-1: 1.0})])
        got = model.predict(found(text))
        assert got[0] == labels[p.index(max(p))] and abs(got[1] - max(p)) < 1e-9


def test_frequencies_are_counted_over_all_learnable_texts(spark):
    rows = [*texts(30), (30, None, "en"), (31, "unlabelled words", None), (32, "", "de"), (33, "42", "fr"), (34, "the thing", "en"), (34, "the thing", "en")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    idf = plain_idf([t for _, t, c in rows if t is not None and c is not None])
    assert np.allclose(model.idf, [idf(f) for f in range(langid.DIMS)])


def test_empty_tables_and_repeated_rows(spark):
    df = spark.createDataFrame([*texts(30), (1, "the thing", "en"), (1, "the thing", "en")], "doc_id long, text string, lang string").withColumnRenamed("doc_id", "Lang_Pred")
    model = langid.train(df)
    out = langid.identify(df, model)
    assert out.columns == ["text", "lang", "lang_pred", "score"]
    got = [(r.text, r.lang_pred, r.score) for r in out.collect()]
    assert len(got) == 32 and len({g for g in got if g[0] == "the thing"}) == 1
    assert langid.identify(df.limit(0), model).collect() == []
    nothing = langid.train(df.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.identify(df, nothing).collect()} == {("und", 0.0)}
