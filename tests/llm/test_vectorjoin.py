import duckdb
import numpy as np
import pytest

from tesserae.llm import queries, vectorjoin
from tests.llm.util import SF, closure


def brute(rows, t=0.9):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and len(v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    pairs, count = [], [0] * len(good)
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                pairs.append((good[a][0], good[b][0]))
                count[a] += 1
                count[b] += 1
    links = {}
    for (i, _), c in zip(good, count, strict=True):
        links[i] = c
    return links, closure([i for i, _ in rows if i is not None], pairs)


@pytest.mark.parametrize(("cell", "block"), [(4096, 2048), (40, 16), (10, 7)])
def test_cells_and_blocks_lose_nothing(spark, cell, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 6))
    rows = []
    for i in range(600):
        c = centres[0] if i % 3 == 0 else centres[int(rng.integers(0, 25))]
        rows.append((i, [float(np.float32(v)) for v in c + rng.normal(size=6) * float(rng.choice([0, 0.05, 0.4]))]))
    rows += [(1000, None), (1001, []), (1002, [0.0] * 6), (1003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1004, [float("nan")] * 6), (1005, [float("inf")] * 6), (1006, [1.0, 0.0]), (1007, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as n", "'c' as class")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectorjoin.near_vectors(df, cell=cell, block=block).collect()}
    links, component = brute(rows)
    assert got == {i: (links.get(i, 0), component[i]) for i, _ in rows}


def test_a_block_keeps_a_forest():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(3, 8)), 300, axis=0) + rng.normal(size=(900, 8)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(900)
    block = vectorjoin.BlockJoin(ids, np.ones(900, np.int64), x, 0.9)
    assert len(block.edges) < 1900 and set(block.counts.tolist()) == {299}
    assert set(closure(range(900), block.edges).values()) == {0, 300, 600}
    linked, n = block.meet(np.array([1000, 1001]), np.array([2, 1]), np.array([x[0], -x[0]]))
    assert linked.tolist() == [1000] and n.tolist() == [300] and set(block.counts[:300].tolist()) == {301}


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (9, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted([(r.vec_id, r.n_links, r.component_id) for r in vectorjoin.near_vectors(df).collect()], key=str)
    assert got == sorted([(None, 0, None), (4, 2, 4), (4, 2, 4), (9, 2, 4)], key=str)
    assert vectorjoin.near_vectors(df.limit(0)).count() == 0


def test_one_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (7, [-1.0, 0.0]), (7, [-1.0, 0.001]), (7, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectorjoin.near_vectors(df, cell=2, block=2).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (7, 2, 7), (7, 2, 7), (7, 2, 7)]


def test_of_two_blocks_one_hosts():
    blocks = np.arange(40)
    for b in range(40):
        sends = vectorjoin._hosts(blocks, b)
        back = np.array([vectorjoin._hosts(np.array([b]), int(o))[0] for o in blocks])
        assert (sends != back)[blocks != b].all() and 10 < sends.sum() < 30


def test_query(spark):
    rows = duckdb.sql(f"select vec_id, embedding from read_parquet('{SF}/embeddings.parquet')").fetchall()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op3_vectors(spark, SF).collect()}
    links, component = brute(rows)
    assert got == {i: (links[i], component[i], component[i] == i) for i, _ in rows}
