import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import katz, queries
from tests.llm.util import SF, documents


class Brute:
    """The model in plain Python, over tuples of words; contexts are filled up with start marks."""

    def __init__(self, texts, order=katz.ORDER):
        self.order = order
        self.grams = [Counter() for _ in range(order + 1)]
        for t in texts:
            for h, w in self.events(t):
                for n in range(1, order + 1):
                    self.grams[n][(*h[order - n :], w)] += 1
        self.n = sum(self.grams[1].values())
        self.uni = Counter({g[0]: c for g, c in self.grams[1].items()})
        self.b = [0.0, *(katz.slope([sum(1 for v in c.values() if v == r) for r in range(1, katz.FIT + 1)]) for c in self.grams[1:])]
        self.contexts = [Counter() for _ in range(order + 1)]
        self.after = defaultdict(list)
        for n in range(2, order + 1):
            for g, c in self.grams[n].items():
                self.contexts[n][g[:-1]] += c
                self.after[g[:-1]].append(g[-1])
        self.unknown = 1 - sum(self.d(c, 1) for c in self.uni.values()) / self.n if self.n else 1.0

    @staticmethod
    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), None]

    def events(self, t):
        words = [*["<s> "] * (self.order - 1), *self.tokens(t)]
        return [(tuple(words[i - self.order + 1 : i]), words[i]) for i in range(self.order - 1, len(words))]

    def d(self, c, n):
        return c * (1 + 1 / c) ** (self.b[n] + 1)

    def p(self, h, w):
        """By the definition, recursively."""
        n = len(h) + 1
        if n == 1:
            return self.d(self.uni[w], 1) / self.n if self.uni[w] else self.unknown
        if (*h, w) in self.grams[n]:
            return self.d(self.grams[n][(*h, w)], n) / self.contexts[n][h]
        return (self.weight(h) if self.contexts[n][h] else 1) * self.p(h[1:], w)

    def weight(self, h):
        n = len(h) + 1
        seen = sum(self.d(self.grams[n][(*h, x)], n) for x in self.after[h]) / self.contexts[n][h]
        return (1 - seen) / (1 - sum(self.p(h[1:], x) for x in self.after[h]))

    def score(self, t):
        w = self.tokens(t)
        base = sum(math.log10((self.uni[x] + 0.1) / (self.n + 0.1 * (len(self.uni) + 1))) for x in w)
        return len(w), sum(1 for x in w if self.uni[x]), self.n, base, sum(math.log10(self.p(h, x)) for h, x in self.events(t))


def same(got, want):
    return got[:3] == want[:3] and all(abs(a - b) <= 1e-8 * max(1, abs(b)) for a, b in zip(got[3:], want[3:], strict=True))


def test_probabilities_add_up():
    model = Brute(documents().text.tolist()[:40])
    histories = [h for t in documents().text.tolist()[:3] for h, _ in model.events(t)[:6]]
    for h in [*histories, ("<s> ", "the"), ("never", "seen"), ("the",), ()]:
        assert abs(sum(model.p(h, w) for w in [*model.uni, "never seen"]) - 1) < 1e-9


@pytest.mark.parametrize("n", [[100, 40, 20, 12, 8, 6], [10, 20, 30, 40, 50, 60], [0, 0, 0, 0, 0, 0], [5, 0, 1, 0, 0, 0], [7, 0, 0, 0, 0, 0], [0, 0, 0, 9, 0, 0]])
def test_every_count_gives_something_up(n):
    b = katz.slope(n)
    counts = np.array([0, 1, 2, 3, 10, 1000, 10**9, 10**12])
    up = katz.given_up(counts, b)
    assert up[0] == 0 and (up[1:] > 0).all() and (up[1:] < counts[1:]).all()
    assert np.allclose(katz.discounted(counts, b)[1:5], counts[1:5] * (1 + 1 / counts[1:5]) ** (b + 1))


def test_the_fit_is_good_turing_on_a_straight_line():
    n = [10_000 * r**-1.7 for r in range(1, katz.FIT + 1)]
    b = katz.slope(n)
    assert abs(b + 1.7) < 1e-9
    for r in range(1, katz.FIT):
        assert abs(katz.discounted(np.array([r]), b)[0] - (r + 1) * n[r] / n[r - 1]) < 1e-9


@pytest.mark.parametrize("top", [3, 1 << 20, 1 << 62])
def test_numbers_of_keys(top):
    keys = np.random.default_rng(2).integers(0, top, 3000)
    distinct, number = katz.numbered(keys)
    want = np.unique(keys, return_inverse=True)
    assert (distinct == want[0]).all() and (number == want[1]).all()
    assert [len(x) for x in katz.numbered(keys[:0])] == [0, 0]


def test_squeezed_arrays_come_back():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (katz.swell_sorted(katz.squeeze_sorted(keys)) == keys).all()
    for a, kind in ((np.arange(7, dtype=np.uint32), "u4"), (np.array([0.5, -1]), "f8"), (np.zeros(0, np.uint8), "u1")):
        assert (katz.swell(katz.squeeze(a), kind) == a).all()


ROWS = [(1, "The cat sat the cat ran"), (2, "the cat\tsat.\nthe dog ran"), (3, None), (4, ""), (5, "unknown words the cat zebra the"), (6, "the cat sat the cat ran"), (6, "the cat sat the cat ran"), (None, "the dog"), (7, "w " * 3000), (8, "licence line of one kind " * 40), *[(10 + i, " ".join(f"w{(i * j) % 13}" for j in range(i % 30))) for i in range(120)]]
HELD = {5, 12, 17, 40}


def equal(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(want, key=lambda r: (str(r[0]), r[2])), strict=True):
        assert g[:2] == w[:2] and same(g[2:], w[2:]), (g, w)


@pytest.mark.parametrize(("order", "buckets"), [(1, 2), (2, 3), (3, 1), (3, 7), (4, 4)])
def test_blocks_and_buckets_equal_brute_force(spark, order, buckets):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as block", "2 as held").repartition(3)
    got = katz.score(df, F.col("doc_id").isin(*HELD) & F.col("doc_id").isNotNull(), order=order, block_tokens=200, buckets=buckets).collect()
    model = Brute([t for d, t in ROWS if d not in HELD], order)
    equal([tuple(r) for r in got], [(d, d in HELD, *model.score(t)) for d, t in ROWS])


def test_empty_tables_and_no_training(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert katz.score(df.limit(0), F.lit(False)).count() == 0
    nothing = katz.score(df.limit(3), F.lit(True)).collect()
    assert all(r.score == 0 and r.base_score == 0 for r in nothing) and len(nothing) == 3


def test_a_context_of_frequent_followers_only_keeps_mass_for_others(spark):
    rows = [(i, "one licence line") for i in range(60)]
    df = spark.createDataFrame([*rows, (100, "one licence text")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in katz.score(df, F.col("doc_id") == 100).collect()}
    assert -8 < got[100] < got[0] < 0


def test_a_stored_model_scores_other_texts(spark, tmp_path):
    df = spark.createDataFrame([(d, t) for d, t in ROWS if d not in HELD], "doc_id long, text string")
    katz.score(df, order=3, block_tokens=300, buckets=2, keep=f"{tmp_path}/model").collect()
    other = [(900, "the cat sat on the w3 w6"), (901, None), (902, "licence line of w1"), *[r for r in ROWS if r[0] in HELD]]
    got = katz.score(spark.createDataFrame(other, "doc_id long, text string").repartition(2), model=f"{tmp_path}/model", block_tokens=5).collect()
    model = Brute([t for d, t in ROWS if d not in HELD])
    equal([tuple(r) for r in got], [(d, True, *model.score(t)) for d, t in other])
    grams = spark.read.parquet(f"{tmp_path}/model/grams")
    assert {r.level for r in grams.select("level").distinct().collect()} == {1, 2, 3}


def test_query(spark):
    rows = [(int(r.doc_id), r.text) for r in documents().itertuples()]
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 10 == 0}
    model = Brute([t for d, t in rows if d not in held])
    got = {r.doc_id: tuple(r) for r in queries.op2_perplexity(spark, SF).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        assert got[d][1] == (d in held) and same(got[d][2:], model.score(t))
    assert sum(got[d][6] for d in held) > sum(got[d][5] for d in held)
