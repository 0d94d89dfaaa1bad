import math
import re
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import lexsearch, queries
from tests.llm.util import DOC

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """(item, rank, doc, score) by scoring every document for every item; the items have distinct ids."""
    found = [(d, terms_of(t)) for d, t in docs]
    found = [(d, len(t), Counter(t)) for d, t in found if t]
    n_docs, total = len(found), sum(n for _, n, _ in found)
    df = Counter(t for _, _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, n, c in found:
            m = 10 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d if d is not None else 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def corpus(rng, n):
    words = [*"the of and a in".split(), *(f"w{i}" for i in range(60)), "été", "日本", "Ünï", "MiX"]
    odds = 1 / np.arange(1, len(words) + 1)
    odds /= odds.sum()
    return [" ".join(rng.choice(words, int(rng.integers(0, 40)), p=odds)) for _ in range(n)]


def shown(rows, k=("item_id", "rank", "doc_id", "score")):
    return sorted(map(str, [tuple(r[c] for c in k) for r in rows]))


@pytest.mark.parametrize(("k", "block_terms", "cells", "batch"), [(3, 1 << 16, 1 << 21, 1 << 18), (1, 20, 40, 50), (10, 60, 300, 7), (500, 1 << 16, 1 << 21, 1 << 18)])
def test_equals_scoring_everything(spark, monkeypatch, k, block_terms, cells, batch):
    rng = np.random.default_rng(k)
    docs = [(i if i % 50 else None, t) for i, t in enumerate(corpus(rng, 400))]
    docs += [(1000 + i, t) for i, (_, t) in enumerate(docs[:80])] + [(2000, None), (2001, ""), (2002, "... !!"), (5, docs[5][1])]
    items = [(i, t) for i, t in enumerate(corpus(rng, 20))] + [(100, None), (101, "absent"), (102, "The THE the")]
    for name, value in (("CELLS", cells), ("ROWS", batch), ("SUMMED", max(cells, 64))):
        monkeypatch.setattr(lexsearch, name, value)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    assert shown(lexsearch.search(d, q, k, block_terms=block_terms).collect()) == shown([dict(zip(("item_id", "rank", "doc_id", "score"), r, strict=True)) for r in brute(docs, items, k)])


def test_terms():
    assert lexsearch.terms_of("A-b9_Çé\x00İx\n日本、z") == [x.encode() for x in terms_of("A-b9_Çé\x00İx\n日本、z")] == ["a".encode(), b"b9", "Çé".encode(), "İx".encode(), "日本、z".encode()]
    assert lexsearch.terms_of(None) == []


def test_lists_are_spread(spark):
    """A term of all documents weighs nothing; one of most is in several files."""
    rng = np.random.default_rng(1)
    docs = [(i, "common " + " ".join(f"w{int(x)}" for x in rng.integers(0, 3000, 20))) for i in range(4000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    terms = spark.createDataFrame([(b"common", 0), (b"w7", 1), (b"w8", 2)], "term binary, term_no long")
    _, lists = lexsearch.posting_lists(d, terms, "doc_id", "text")
    assert lists.where("term_no = 0").count() == 0  # it weighs nothing
    docs = [(i, t if i % 10 else t[7:]) for i, t in docs]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        _, lists = lexsearch.posting_lists(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), terms, "doc_id", "text")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = lists.where("term_no = 0").selectExpr("input_file_name() f", "score").groupBy("f").agg({"score": "max"}).count()
    assert files >= 2


def test_defined_cases(spark, tmp_path):
    rows = [(1, "word " * 60_000 + "rare", "en", "a", 0), (2, None, None, None, None), (3, "again rare", "en", "a", 5), (3, "again rare", "en", "a", 5), (None, "no id", None, "b", 5), (4, "", "en", "a", 0), (5, "x y z", "en", "a", 5)]
    df = spark.createDataFrame(rows, DOC)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Rare!"), (1, "Rare!"), (None, "again"), (2, "nowhere"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op11_search(spark, str(tmp_path)).collect()
    assert sorted((r.item_id or 0, r["rank"], r.doc_id) for r in got) == [(0, 1, 3), (0, 2, 3), *[(1, 1, 3)] * 2, *[(1, 2, 3)] * 2, *[(1, 3, 1)] * 2]
    items = spark.createDataFrame([(7, "rare", 1, 2)], "item_id long, text string, query long, score long")
    odd = df.selectExpr("*", "1 as term", "2 as row", "3 as n", "4 as score")
    assert [r.doc_id for r in lexsearch.search(odd, items).orderBy("rank").collect()] == [3, 3, 1]
    assert lexsearch.search(df.limit(0), items).count() == 0 and lexsearch.search(df, items.limit(0)).count() == 0
