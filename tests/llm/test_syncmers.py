import hashlib

import numpy as np
import pytest
import xxhash

from tesserae.llm import queries, syncmers
from tests.llm.util import SF, documents


def brute_rows(rows):
    """Edited texts by plain Python; rows (doc_id, text) with distinct ids."""
    ordered = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -(1 << 63)))
    out = {}
    for i, (d, t) in enumerate(ordered):
        t, following = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        third = len(t) // 3
        new = t[: len(t) - third] + following[:third]
        out[d] = (len(t), hashlib.sha256(new.encode()).hexdigest(), new, following)
    return out


def test_anchors_are_context_free_and_closed():
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(400)]
    text = " ".join(words) + "é\U0001f600"
    places, hashes = syncmers.anchors(text)
    assert len(places) > len(text) / 5
    by_kmer = {}
    for p, h in zip(places.tolist(), hashes.tolist(), strict=True):
        assert by_kmer.setdefault(text[p : p + syncmers.K], h) == h
    moved, same = syncmers.anchors("xyz" + text[100:900] + "w")
    inside = {(p - 3 + 100, h) for p, h in zip(moved.tolist(), same.tolist(), strict=True) if 3 <= p <= 803 - syncmers.K}
    assert inside == {(p, h) for p, h in zip(places.tolist(), hashes.tolist(), strict=True) if 100 <= p <= 900 - syncmers.K}


def plain_inner(points):
    """The hash of an inner string, in plain integers."""
    m = 0xFFFFFFFF
    h = points[0] * 0x9E3779B1 & m
    for p in points[1:]:
        h = ((h ^ h >> 15) * 0x2C1B3C6D + p * 0x297A2D39) & m
    return plain_mix(h)


def plain_mix(h):
    m = 0xFFFFFFFF
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    return h ^ h >> 16


def plain_anchors(text, k, s):
    """Closed syncmers by looking at every k-mer on its own."""
    out = []
    for at in range(len(text) - k + 1):
        inner = [plain_inner([ord(c) for c in text[at + i : at + i + s]]) for i in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            whole = 0
            for i in [*range(0, k - s + 1, s), k - s]:
                whole = plain_mix((whole * 31 + inner[i]) & 0xFFFFFFFF)
            out.append((at, whole))
    return out or [(0, xxhash.xxh32_intdigest(text.encode()))] * bool(text)


def plain_likeness(a, b, k, s):
    """Common occurrences in the longest common order, of all occurrences, by a quadratic search."""
    def occurrences(t):
        seen, out = {}, {}
        for at, h in plain_anchors(t, k, s):
            seen[h] = seen.get(h, 0) + 1
            out[h, seen[h]] = at
        return out

    x, y = occurrences(a), occurrences(b)
    if not x or not y:
        return float(len(x) == len(y))
    ends = [y[e] for e in sorted(x.keys() & y.keys(), key=lambda e: (x[e], y[e]))]
    best = []
    for i, v in enumerate(ends):
        best.append(1 + max([best[j] for j in range(i) if ends[j] < v], default=0))
    return max(best, default=0) / (len(x) + len(y) - len(x.keys() & y.keys()))


@pytest.mark.parametrize(("k", "s"), [(syncmers.K, syncmers.S), (5, 2), (6, 6), (9, 1)])
def test_anchors_and_likeness_against_plain_enumeration(k, s):
    texts = ["", "ab", "abcdefgh", "a" * 40, "the cat sat on the mat " * 8, "the mat sat on the cat " * 7 + "é😀 end", *[t[:260] for t in documents().text.tolist()[:6]]]
    for t in texts:
        places, hashes = syncmers.anchors(t, k, s)
        assert list(zip(places.tolist(), hashes.tolist(), strict=True)) == plain_anchors(t, k, s)
        for u in texts:
            assert syncmers.likeness(syncmers.fingerprint(t, k, s), syncmers.fingerprint(u, k, s)) == pytest.approx(plain_likeness(t, u, k, s), abs=1e-12)


def test_chunks_do_not_show(monkeypatch):
    text = documents().text.iloc[0] * 3
    whole = syncmers.anchors(text)
    monkeypatch.setattr(syncmers, "CHUNK", 50)
    parts = syncmers.anchors(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_likeness():
    a, b = documents().text.iloc[:2]
    fa, fb = syncmers.fingerprint(a), syncmers.fingerprint(b)
    assert syncmers.likeness(fa, fa) == 1 and syncmers.likeness(fa, fb) < 0.1
    assert (syncmers.read(syncmers.written(fa)) == fa).all()
    empty = syncmers.fingerprint("")
    assert syncmers.likeness(empty, empty) == 1 and syncmers.likeness(empty, fa) == 0
    assert len(syncmers.fingerprint("ab")) == 1


@pytest.mark.parametrize("rows", [[(1, "alone, but not short at all")], [(5, "some text " * 20), (None, None), (3, ""), (-4, "x"), (9, "y" * 90_000), (2, "some text " * 20)], [(i * i, f"text number {i} " * (i % 40)) for i in range(300)]])
def test_every_row_meets_its_successor(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as bucket")
    got = syncmers.compare_edits(df).collect()
    want = brute_rows(rows)
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == {d: v[:2] for d, v in want.items()} and len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        a, e, n = syncmers.fingerprint(text), syncmers.fingerprint(want[r.doc_id][2]), syncmers.fingerprint(want[r.doc_id][3])
        assert (r.fingerprint, r.edited_fingerprint) == (syncmers.written(a), syncmers.written(e))
        assert (r.near_edited, r.near_next) == (syncmers.likeness(a, e), syncmers.likeness(a, n))


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one one one one"), (1, "one one one one"), (1, "other text here")], "doc_id long, text string")
    got = syncmers.compare_edits(df)
    assert got.count() == 3
    assert syncmers.compare_edits(df.limit(0)).count() == 0


def test_query(spark):
    rows = [(int(r.doc_id), r.text) for r in documents().itertuples()]
    got = queries.op9_fingerprint(spark, SF).collect()
    want = brute_rows(rows)
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == {d: v[:2] for d, v in want.items()}
    long = [r for r in got if r.n_chars > 300]
    print(np.quantile([r.near_edited for r in long], [0, 0.1, 0.5, 0.9]), np.quantile([r.near_next for r in long], [0.5, 0.9, 0.99, 1]))
    assert np.mean([r.near_edited > 0.3 for r in long]) > 0.97 and np.mean([r.near_next < 0.1 for r in long]) > 0.9


def test_long_texts_are_compared_whole():
    rng = np.random.default_rng(4)
    one, two = ("".join(map(chr, rng.integers(97, 123, 100_000))) for _ in range(2))
    shared = one[:50_000] + two[50_000:50_400] + one[50_400:]
    a, b, c = (syncmers.fingerprint(t) for t in (one, two, shared))
    assert len(a) > 20_000 and (syncmers.read(syncmers.written(a)) == a).all()
    assert 0.98 < syncmers.likeness(a, c) < 1 and 0.001 < syncmers.likeness(b, c) < 0.02
