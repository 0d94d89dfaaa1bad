import re

import numpy as np
import pytest
import xxhash

from tesserae.llm import queries, simhash
from tesserae.llm.components import components
from tests.llm.util import SF, closure, documents


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(p.encode(), 42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(values, bits=3):
    return [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= bits]


def test_fingerprint_of_spark_and_python_hash(spark):
    assert spark.sql("select xxhash64('a bc d') x").first().x & (1 << 64) - 1 == xxhash.xxh64(b"a bc d", 42).intdigest()
    for t in (None, "", " \t\n", "one", "One  TWO", "Ä b C d e", "a b c d e f g " * 9000):
        assert simhash.fingerprint(t.encode() if t is not None else None) == brute_print(t)


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 60).astype(np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False))) for _ in range(1500)]
    codes = np.unique(np.array([base[int(rng.integers(0, 60))] ^ f for f in flips], np.uint64))
    want = {tuple(sorted(p)) for p in near([int(c) for c in codes])}
    got = [tuple(sorted(p)) for x, y in simhash.GrayIndex(codes).join(3, budget=5000) for p in zip(x.tolist(), y.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and want
    top = (1 << 16) - 1 << 48
    got = {tuple(sorted(p)) for x, y in simhash.GrayIndex(codes).join(3, exact=top) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == {(a, b) for a, b in want if int(codes[a]) >> 48 == int(codes[b]) >> 48}
    assert list(simhash.GrayIndex(np.zeros(0, np.uint64)).join(3)) == []


@pytest.mark.parametrize("limit", [3, 2000])
def test_links_reach_all_components(spark, limit):
    rng = np.random.default_rng(6)
    base = [int(x) for x in rng.integers(0, 1 << 62, 12)]
    codes = sorted({base[int(rng.integers(0, 12))] ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 4)), replace=False)) for _ in range(260)})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, code long")
    got = {r.node: r.component for r in components(simhash.links(df, group_limit=limit)).collect()}
    want = closure(range(len(codes)), near(codes))
    assert {i: got.get(i, i) for i in want} == want


def test_query_equals_brute_force(spark):
    docs = documents()
    prints = {int(r.doc_id): brute_print(r.text) for r in docs.itertuples()}
    ids = sorted(prints)
    want = closure(ids, [(ids[i], ids[j]) for i, j in near([prints[i] for i in ids])])
    got = queries.op7_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_defined_cases(spark):
    rows = [(5, None), (2, ""), (9, "same words here again"), (7, "SAME words\there again"), (7, "SAME words\there again"), (None, "same words here again"), (1, "w " * 40000)]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, fp string, id int")
    got = sorted([(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()], key=str)
    assert got == sorted([(5, 2), (2, 2), (9, 7), (7, 7), (7, 7), (None, None), (1, 1)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1400)] + [(3, 3), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in [7, *range(1000, 1400)]}}
