import math
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import quality, queries
from tests.llm.util import SF, documents


def test_statistics_are_finite_for_odd_texts():
    for t in (None, "", " ", "\n\n", "a", "###", "word " * 50_000, "\U0001f600é"):
        s = quality.statistics(t)
        assert s.shape == (len(quality.STATS),) and np.isfinite(s).all()


def test_a_long_text_takes_little_more_memory_than_itself():
    text = "".join(f"Word {i % 991} of the long text, and {i % 13} more.\n" for i in range(200_000))
    tracemalloc.start()
    try:
        quality.statistics(text)
        assert tracemalloc.get_traced_memory()[1] < 6 * len(text)
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("chunk", [1, 7, 300])
def test_pieces_change_nothing(monkeypatch, chunk):
    rng = np.random.default_rng(chunk)
    texts = ["".join(rng.choice(["a", "The ", "the ", "!", "#", "|", "é", "\n", " ", ".", "\U0001f600", "word\n"], n)) for n in (0, 1, 2, 5, 60, 400, 900)] + ["x" * 700, "|" * 700, "again " * 200]
    whole = [quality.statistics(t) for t in texts]
    monkeypatch.setattr(quality, "CHUNK", chunk)
    assert np.array_equal(whole, [quality.statistics(t) for t in texts])


def test_worst_window():
    hits = np.array([0, 1, 1, 0, 1, 0, 0, 0], bool)
    assert quality.worst(hits, 3) == 2 / 3 and quality.worst(hits[:0], 3) == 0 and quality.worst(hits[:2], 4) == 1 / 4


def test_pairs_rank_and_threshold():
    rng = np.random.default_rng(2)
    raw = rng.normal(size=(800, len(quality.STATS))).astype(np.float32)
    good = raw[:, 3] + 0.3 * raw[:, 7] > -1
    model = quality.fit(raw, good)
    score = model.score(raw)
    assert (score[good][:, None] > score[~good][None]).mean() > 0.97
    assert ((score >= quality.CUT) == good).mean() > 0.93
    assert np.allclose(quality.fit(raw, np.ones(800, bool)).score(raw[:3]), quality.CUT)


def test_query_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op4_quality(spark, SF).collect()}
    labels = duckdb.sql(f"select doc_id, quality from read_parquet('{SF}/labels.parquet')").fetchall()
    held = [(got[d].score, q, got[d].predicted) for d, q in labels if got[d].held_out]
    good, bad = [s for s, q, _ in held if q], [s for s, q, _ in held if not q]
    assert good and np.mean([p == q for _, q, p in held]) > 0.85
    assert not bad or np.mean([[g > b for g in good] for b in bad]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_defined_cases(spark):
    rows = [(1, "Plain words follow here."), (1, "Plain words follow here."), (None, None), (3, ""), (4, "### $$$ %%%"), (5, "long " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as quality_score", "2 as _good")
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (None, 0), (5, None)], "doc_id long, quality int")
    model = quality.train(df, labels, F.lit(True))
    got = quality.grade(df, model)
    assert got.columns == ["doc_id", "text", "_good", "quality_score", "quality_strength"]
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= r.quality_score <= 1 for r in out)
    nothing = quality.train(df.limit(0), labels.limit(0), F.lit(True))
    assert quality.grade(df.limit(0), nothing).count() == 0


def plain_statistics(text):
    """STATS by going over characters, words and lines one by one."""
    n = max(len(text), 1)
    def kind(c):
        if ord(c) > 255:
            return "lower"
        for name, hit in (("upper", c.isupper()), ("lower", c.isalpha()), ("digit", c.isdigit()), ("newline", c == "\n"), ("space", c.isspace()), ("stop", c == "."), ("comma", c == ","), ("sign", c in "#*@$%&!?"), ("pipe", c == "|"), ("quote", c in "\"'()[]{}<>")):
            if hit:
                return name
        return "mark"

    kinds = [kind(c) for c in text]
    share = lambda name: kinds.count(name) / n
    words = re.findall(quality.WORD.pattern, text)
    w = max(len(words), 1)
    marked = [k in ("sign", "pipe", "quote", "mark") for k in kinds]
    blank = [k in ("space", "newline") for k in kinds]
    after_blank = [i for i in range(1, len(text)) if blank[i - 1] and not blank[i]]
    before_blank = [i for i in range(len(text) - 1) if not blank[i] and blank[i + 1]]
    same = [a == b for a, b in zip(words, words[1:], strict=False)]
    lines = text.split("\n")
    filled = [x for x in lines if x.strip()]
    letters = [sum(min(ord(c), 255) == i for c in text) / n for i in range(256)]

    def worst(hits, span):
        wide = min(span, len(hits))
        return max(sum(hits[i : i + wide]) for i in range(len(hits) - wide + 1)) / span if hits else 0.0

    return [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)), share("upper"), share("lower"), share("digit"), share("space"), share("newline"), sum(ord(c) > 127 for c in text) / n, share("stop"), share("comma"),
        share("sign"), share("pipe"), share("quote"), share("mark"), sum(a and b for a, b in zip(marked, marked[1:], strict=False)) / n, sum(map(len, words)) / w if words else 0.0, sum(len(x) > 14 for x in words) / w, sum(len(x) < 3 for x in words) / w,
        sum(kinds[i] == "upper" for i in after_blank) / w, sum(marked[i] for i in before_blank) / w, sum(kinds[i] == "stop" for i in before_blank) / w, len(set(words)) / w, sum(same) / len(same) if same else 0.0, max(map(words.count, words)) / w if words else 0.0,
        -sum(p * math.log(p) for p in letters if p), 1 - len(set(filled)) / max(len(filled), 1), len(zlib.compress(text.encode(), 1)) / n, worst(same, 40), worst(marked, 256), worst([k == "upper" for k in kinds], 256), worst([k == "pipe" for k in kinds], 256),
    ]


@pytest.mark.parametrize("text", ["", "a", "One word, two words. Two words!\n\nTHREE | lines || here ### (x)", "É\U0001f600 \t12", *documents().text.str[:600].tolist()[:12]])
def test_statistics_against_plain_counting(text):
    assert np.allclose(quality.statistics(text), plain_statistics(text), atol=1e-5)


def test_scores_against_loops():
    raw = np.array([quality.statistics(t) for t in documents().text.tolist()[:120]])
    good = np.arange(120) % 3 > 0
    model = quality.fit(raw, good, pairs=3000)
    for row in raw[:20]:
        strength = sum(model.weights[i * (quality.BINS - 1) + j] for i in range(len(quality.STATS)) for j in range(quality.BINS - 1) if row[i] > model.edges[i, j])
        z = model.slope * (strength - model.threshold) + math.log(quality.CUT / (1 - quality.CUT))
        assert abs(model.score(row[None])[0] - 1 / (1 + math.exp(-z))) < 1e-4


def test_weights_are_at_the_least_loss_of_pairs():
    rng = np.random.default_rng(4)
    raw = rng.normal(size=(60, len(quality.STATS))).astype(np.float32)
    good = raw[:, 0] + rng.normal(size=60) > 0
    pairs, ridge, seed = 2000, 2e-4, 7
    model = quality.fit(raw, good, pairs=pairs, rounds=3000, ridge=ridge, seed=seed)
    x = quality.expand(raw, model.edges).astype(float)
    draw = np.random.default_rng(seed)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    a, b = up[draw.integers(0, len(up), pairs)], down[draw.integers(0, len(down), pairs)]
    loss = lambda w: np.log1p(np.exp(-(x[a] - x[b]) @ w)).mean() + ridge / 2 * w @ w
    w = np.zeros(x.shape[1])
    for _ in range(4000):  # plain descent on differences of features
        d = x[a] - x[b]
        w += 0.5 * ((d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) - ridge * w)
    assert loss(model.weights.astype(float)) <= loss(w) * 1.01


def test_conflicting_labels_take_the_lower(spark):
    docs = spark.createDataFrame([(i, ("Plain words follow. " if i % 2 else "### $$$ | ") * 5) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0)], "doc_id long, quality int")
    twice = quality.train(docs, labels, F.lit(True))
    once = quality.train(docs, labels.where("NOT (doc_id = 1 AND quality = 1)"), F.lit(True))
    assert np.allclose(twice.weights, once.weights)
