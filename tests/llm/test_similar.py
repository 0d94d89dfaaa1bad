import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import simhash
from tests.llm.test_pipeline import print5
from tests.llm.util import DOC, closure


def copies():
    """Texts with copies that differ in some words, and what is planted for the odd cases."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(60):
        words = [f"w{int(x)}" for x in rng.integers(0, 3000, 150)]
        rows.append(" ".join(words))
        for edits in (1, 2, 3, 4, 9):
            new = list(words)
            for at in rng.choice(150, edits, replace=False):
                new[at] = f"new{g}"
            rows.append(" ".join(new))
    passage = "the same long passage again and again " * 30
    return [*rows, passage + " ".join(f"a{i}" for i in range(40)), passage + " ".join(f"b{i}" for i in range(40)), "", " ", "short text", "SHORT\ttext"]


def brute(texts):
    def parts(t):
        w = t.lower().split()
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = [parts(t) for t in texts]
    return [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]


def test_stage_finds_all_of_similarity_four_fifths(spark):
    texts = copies()
    pairs = brute(texts)
    want = closure(range(len(texts)), pairs)
    by_bits = [(i, j) for i, j in pairs if (print5(texts[i]) ^ print5(texts[j])).bit_count() <= 3]
    assert closure(range(len(texts)), by_bits) != want
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, "short text", "en", "s", 10)], DOC)
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert sorted(x for x in got if x is not None) == [i for i in want if want[i] == i] and got.count(None) == 1


def test_fingerprints_bring_candidates_that_are_compared(spark, monkeypatch):
    """Without any min-hash bucket, what agrees within three bits is linked, if it is alike."""
    signed = simhash._signed
    monkeypatch.setattr(simhash, "_signed", lambda docs, shingle: signed(docs, shingle).withColumn("buckets", F.array().cast("array<long>")))
    texts = copies()
    pairs = [(i, j) for i, j in brute(texts) if (print5(texts[i]) ^ print5(texts[j])).bit_count() <= simhash.BITS]
    want = closure(range(len(texts)), pairs)
    got = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r.doc_id: r.component_id for r in got}
    assert len({a for a, _ in pairs}) > 10 and all(found[a] == found[b] for a, b in pairs)
    whole = closure(range(len(texts)), brute(texts))
    assert all(whole[d] == whole[c] for d, c in found.items()) and len(set(found.values())) <= len(set(want.values()))


def test_defined_cases(spark):
    rows = [(5, None), (2, ""), (9, "same words here again"), (7, "SAME words\there again"), (7, "SAME words\there again"), (None, "same words here again"), (1, "w " * 40000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, code string")
    got = sorted([tuple(r) for r in simhash.similar_documents(df).select('doc_id', 'component_id').collect()], key=str)
    assert got == sorted([(5, 2), (2, 2), (9, 7), (7, 7), (7, 7), (None, None), (1, 1)], key=str)
    assert simhash.similar_documents(df.limit(0)).count() == 0


def test_the_bit_limit_loses_no_pair_of_two(spark):
    """Groups of two only, with fingerprints of both signs."""
    rng = np.random.default_rng(9)
    rows = []
    for g in range(300):
        words = [f"v{int(x)}" for x in rng.integers(0, 9000, 120)]
        new = list(words)
        new[int(rng.integers(0, 120))] = f"n{g}"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(new))]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d // 2 * 2 for d, _ in rows}
    prints = {r.doc_id: r.fp for r in got}
    assert any(prints[2 * g] ^ prints[2 * g + 1] < 0 for g in range(300))  # of different signs
