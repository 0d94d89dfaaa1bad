import hashlib

from tesserae.llm import linededup, queries
from tests.llm.util import DOC, SF, documents


def brute(rows):
    """{doc_id: (n_lines, n_dropped, text)} over (doc_id, text) rows."""
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    lower = {c: c + 32 for c in range(65, 91)}
    key = lambda line: line.strip(strip).translate(lower)
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or len(key(x)) < 10 or min(holders[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    got = queries.op5_line_dedup(spark, SF).collect()
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute([(int(r.doc_id), r.text) for r in documents().itertuples()])]
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    assert sum(r["n_dropped"] for r in got) > 0


def test_defined_cases(spark):
    shared, other = "a line that is shared", "x" * 50_000
    rows = [(3, f"{shared}\nown line of three"), (1, f"  {shared.upper()}\t\nshort\n\n"), (2, None), (4, ""), (5, other + "\n" + shared), (5, other + "\n" + shared), (None, shared), (6, "short\nshort"), (7, "\n" * 300 + other)]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOC).selectExpr("*", "'x' as n_lines", "1 as block", "2 as _id")
    got = linededup.drop_repeated_lines(df, min_chars=10)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "block", "_id", "n_lines", "n_dropped"]
    have = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()], key=str)
    assert have == brute(rows)
    assert linededup.drop_repeated_lines(df.limit(0)).count() == 0


def test_small_blocks_and_many_holders(spark):
    rows = [(i, f"the very common line\nline number {i}\nline number {i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.drop_repeated_lines(df.repartition(5), block_lines=7)
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()], key=str) == brute(rows)
