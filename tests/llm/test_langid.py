import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import langid, queries
from tests.llm.util import SF, documents


def test_families_and_unknown():
    assert langid.family_of("de") == langid.family_of("en") != langid.family_of("fr") and langid.family_of("xx") == "xx"
    model = langid.fit(np.zeros((0, langid.DIMS), np.float32), [])
    assert model.predict("some text") == ("und", 0.0, "und", 0.0)


@pytest.mark.parametrize("text", [None, "", " \n\t", "1234 !!! ???", "\U0001f600"])
def test_texts_without_letters(text):
    assert langid.features(text) is None


def test_long_texts_are_counted_whole(monkeypatch):
    text = " ".join(documents().text.tolist()[:20])
    whole = langid.features(text)
    monkeypatch.setattr(langid, "CHUNK", 100)
    assert np.allclose(whole, langid.features(text), atol=1e-6)
    assert abs(np.linalg.norm(whole) - 1) < 1e-5


def test_hierarchy_of_three_families():
    rng = np.random.default_rng(1)
    alphabets = {"en": "abcdef", "de": "abcdeß", "fr": "éèghij", "ru": "жзийкл", "qq": "xyzwvu"}
    texts = [("".join(rng.choice(list(a), 200)), v) for v, a in alphabets.items() for _ in range(30)]
    model = langid.fit(np.array([langid.features(t) for t, _ in texts]), [v for _, v in texts])
    assert model.families == ["germanic", "qq", "romance", "slavic"]
    fresh = [("".join(rng.choice(list(a), 200)), v) for v, a in alphabets.items() for _ in range(10)]
    got = [model.predict(t) for t, _ in fresh]
    assert np.mean([g[0] == v for g, (_, v) in zip(got, fresh, strict=True)]) > 0.95 and all(0 <= g[1] <= 1 for g in got)


def test_query_is_accurate_on_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.op1_language(spark, SF).collect()}
    docs = documents()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[int(d)].lang_pred, v) for d, v in zip(docs.doc_id, docs.lang, strict=True) if got[int(d)].held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.93


def test_defined_cases(spark):
    rows = [(1, "the quick brown fox and the dog", "en"), (1, "the quick brown fox and the dog", "en"), (None, None, None), (3, "", "en"), (4, "...", None), (5, "le chat et la souris " * 9000, "fr"), (6, "der hund und die katze", "de"), (7, "the cat and the hat", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred", "1 as _t")
    model = langid.train(df, F.lit(True))
    got = langid.identify(df, model)
    assert got.columns == ["doc_id", "text", "lang", "_t", "lang_pred", "lang_score", "lang_family", "lang_fit"]
    out = got.collect()
    assert len(out) == len(rows) and {r.lang_pred for r in out if not (r.text or "").strip(".")} == {"und"}
    assert {r.lang_pred for r in out if r.doc_id == 5} == {"fr"}
    empty = df.limit(0)
    assert langid.identify(empty, langid.train(empty, F.lit(True))).count() == 0


def plain_features(text):
    """Square roots of the counts of hashed 2- to 4-grams, by going over every one."""
    m = 0xFFFFFFFF
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    kept = [" ", *(c for i, c in enumerate(kept) if not (c == " " and i and kept[i - 1] == " ")), " "]
    counts = np.zeros(langid.DIMS)
    for n in (2, 3, 4):
        for at in range(len(kept) - n + 1):
            h = ord(kept[at]) * 0x9E3779B1 & m
            for c in kept[at + 1 : at + n]:
                h = ((h ^ h >> 15) * 0x85EBCA77 + ord(c) * 0x9E3779B1) & m
            counts[((h ^ h >> 13) * 0xC2B2AE3D & m) >> 20] += 1
    return np.sqrt(counts / counts.sum())


@pytest.mark.parametrize("text", ["a", "Two words", "  It's 12 o'clock -- über ﬁ  ", "\U0001f600 x \U0001f600", *documents().text.tolist()[:3]])
def test_features_against_plain_counting(text):
    assert np.allclose(langid.features(text), plain_features(text), atol=1e-6)


def loss(w, x, y, c=20.0):
    """What a machine minimises, with its bias on a constant of 0.3."""
    slack = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    return (w[:-1] @ w[:-1] + (w[-1] / 0.3) ** 2) / 2 + c * (share * slack**2).sum()


def test_machines_are_at_their_minimum():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.where(x[:, 0] + 0.4 * x[:, 1] + 0.2 * rng.normal(size=90) > 0.1, 1, -1).astype(np.float32)
    w = langid.linear_svm(x, y)
    plain = np.zeros(7)
    for _ in range(20_000):  # plain descent along numeric slopes
        grad = np.zeros(7)
        slack = np.maximum(0, 1 - y * (x @ plain[:-1] + plain[-1]))
        share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        grad[:-1] = plain[:-1] - 40 * x.T @ (share * y * slack)
        grad[-1] = plain[-1] / 0.09 - 40 * (share * y * slack).sum()
        plain -= 0.005 * grad
    assert loss(w.astype(float), x, y) <= loss(plain, x, y) * 1.001


def test_votes_against_a_plain_count():
    texts = documents()
    x = np.array([langid.features(t) for t in texts.text])
    model = langid.fit(x, texts.lang.tolist(), texts.text.str.len().to_numpy())
    for row in x[:60]:
        margins = {f: float(w[:-1] @ row + w[-1]) for f, w in zip(model.families, model.family_w, strict=False)}
        family = model.families[0] if margins[model.families[0]] >= 0 else model.families[1]
        names, (pairs, weights) = model.members[model.families.index(family)], model.pairs[model.families.index(family)]
        won = dict.fromkeys(names, 0)
        for (a, b), w in zip(pairs, weights, strict=True):
            won[names[a] if w[:-1] @ row + w[-1] >= 0 else names[b]] += 1
        lang, score, got = model.classify(row)
        assert got == family and won[lang] == max(won.values()) and 0 <= score <= 1


def test_ties_of_votes_go_to_margins_then_to_the_alphabet():
    names, pairs = ["aa", "bb", "cc"], [(0, 1), (0, 2), (1, 2)]
    def machine(*biases):
        w = np.zeros((3, langid.DIMS + 1), np.float32)
        w[:, -1] = biases
        return langid.LanguageModel(["f"], np.zeros((0, langid.DIMS + 1), np.float32), [names], [(pairs, w)], {}, np.ones(5))
    x = np.zeros(langid.DIMS, np.float32)
    assert machine(1, -3, 1).classify(x)[0] == "cc"  # one vote each, the largest margin
    assert machine(1, -1, 1).classify(x)[0] == "aa"  # all equal


def test_fit_tells_unknown_texts():
    texts = documents()
    model = langid.fit(np.array([langid.features(t) for t in texts.text]), texts.lang.tolist(), texts.text.str.len().to_numpy())
    assert np.mean([model.predict(t)[3] >= 1 for t in texts.text]) > 0.995
    rng = np.random.default_rng(7)
    odd = ["".join(rng.choice(list(a), 400)) for a in ("привет мирязык ", "qxzjwkvg bp", "日本語漢字文 ") for _ in range(10)]
    assert all(model.predict(t)[3] < 1 for t in odd)
