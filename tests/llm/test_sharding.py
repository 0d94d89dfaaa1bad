import itertools
import math
import zlib

import pytest

from tesserae.llm import queries, sharding
from tests.llm.util import DOC, SF, documents


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (3, 1), (4, 2)])
def test_the_curve_visits_neighbours(spark, n, bits):
    points = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame([(list(p),) for p in points], "p array<int>")
    got = sorted((r.h, r.p) for r in df.select("p", sharding.hilbert_index("p", n, bits).alias("h")).collect())
    assert [h for h, _ in got] == list(range(len(points)))
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for (_, a), (_, b) in itertools.pairwise(got))


def check(rows, shards, law):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert set(by) <= set(range(shards))
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    return by


def plain_index(point, bits):
    """Skilling's transform in plain integers."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0], x[i] = x[0] ^ t, x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out * 2 + (v >> b & 1)
    return out


def plain_shards(rows, shards, bits):
    """(doc_id, crc): (hilbert, shard, slot) of rows (source, lang, size, doc_id, crc), by sorting in one list."""
    cells = 1 << bits

    def numeric(values):  # the least value that a share of all is not above
        v = sorted(values)
        return {v[max(math.ceil(i / cells * len(v)) - 1, 0)] for i in range(1, cells)}

    def text(values):
        v = sorted(x.encode() for x in values if x is not None)
        return {v[i * len(v) // cells] for i in range(1, cells)} if v else set()

    edges = [text([r[0] for r in rows]), text([r[1] for r in rows]), numeric([float(r[2]) for r in rows])]
    cell = lambda r: tuple(0 if v is None else sum(e < (v.encode() if isinstance(v, str) else v) for e in es) for v, es in zip(r[:3], edges, strict=True))
    ordered = sorted(((plain_index(cell(r), bits), r[3], r[4]) for r in rows), key=lambda k: (k[0], k[1] is not None, k[1] or 0, k[2]))
    out, firsts = {}, {}
    for rank, (h, d, c) in enumerate(ordered):
        s = rank * shards // len(ordered)
        out[d, c] = (h, s, rank - firsts.setdefault(s, rank))
    return out


def test_query_against_a_plain_sort(spark):
    got = {(r.doc_id, r.text_crc32): (r.hilbert, r.shard, r.slot) for r in queries.op10_sharding(spark, SF).collect()}
    rows = [(r.source, r.lang, len(r.text.encode()) + 16, int(r.doc_id), zlib.crc32(r.text.encode())) for r in documents().itertuples()]
    assert got == plain_shards(rows, 40, sharding.BITS)


def test_query_on_null_and_very_long_texts(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "x" * 500_000, "en", "b", 500_000), (4, "same", "en", "a", 4), (4, "same", "en", "a", 4), (None, "no id", "de", None, 5)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_sharding(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == [(False, 1, 16), (False, 2, 16), (False, 3, 500_016), (False, 4, 20), (False, 4, 20), (True, 0, 21)]
    check(got, 40, "rows")


def test_strings_are_compared_whole(spark):
    df = spark.range(400).selectExpr("id doc_id", "concat('https://one.and.the.same/path/', lpad(cast(id % 32 as string), 3, '0')) source", "16L size")
    got = sharding.shard(df, 8, ["source"], ["doc_id"], "size").collect()
    by = check(got, 8, "rows")
    assert max(len({r.source for r in own}) for own in by.values()) <= 6


def test_query(spark):
    got = queries.op10_sharding(spark, SF).collect()
    docs = documents()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((int(r.doc_id), len(r.text.encode()) + 16, zlib.crc32(r.text.encode())) for r in docs.itertuples())
    by = check(got, 40, "rows")
    source = dict(zip(docs.doc_id, docs.source, strict=True))
    spread = sum(len({source[r.doc_id] for r in own}) for own in by.values()) / len(by)
    assert spread < docs.source.nunique() / 3  # a filter on source skips most shards


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_defined_cases(spark, law):
    rows = [(None, None, None, 16), (3, "a", 1.0, 16), (3, "a", 1.0, 16), (4, "a", None, 90_000), *[(i, "hot", 2.0, 20) for i in range(100, 400)]]
    df = spark.createDataFrame(rows, "doc_id long, source string, x double, size long").selectExpr("*", "'s' as shard", "0 as _part")
    got = sharding.shard(df.drop("_part"), 7, ["source", "x"], ["doc_id"], "size", law).collect()
    assert len(got) == len(rows)
    check(got, 7, law)
    few = sharding.shard(df.drop("_part").limit(3), 7, ["source", "x"], ["doc_id"], "size", law).collect()
    check(few, 7, law)
    assert sharding.shard(df.drop("_part").limit(0), 7, ["source"], ["doc_id"], "size", law).count() == 0


def test_bytes_are_near_equal(spark):
    df = spark.range(2000).selectExpr("id doc_id", "concat('s', id % 9) source", "16 + (id * 37) % 900 size")
    got = sharding.shard(df, 10, ["source", "size"], ["doc_id"], "size", "bytes").groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 2 * 916


def test_string_quantiles_are_those_of_all_rows(spark):
    """Over more rows than a sample would hold, nearly all of them different, and beside a column of few values with nulls."""
    n = 60_000
    df = spark.range(n).selectExpr("lpad(cast((id * 7919) % 59999 as string), 6, '0') a", "CASE WHEN id % 3 > 0 THEN concat('v', id % 5) END b", "cast(null as string) c")
    got = {c: sorted(set(v)) for c, v in sharding.string_edges(df, ["a", "b", "c"], 32).items()}
    columns = {"a": sorted(f"{i * 7919 % 59999:06d}" for i in range(n)), "b": sorted(f"v{i % 5}" for i in range(n) if i % 3 > 0)}
    assert got == {c: sorted({v[i * len(v) // 32] for i in range(1, 32)}) for c, v in columns.items()} | {"c": []}
