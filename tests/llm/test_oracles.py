import duckdb
import pytest

from tesserae.llm import queries
from tests.llm.util import SF


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = c.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*names).collect())) == sorted(map(key, want.select(*names).fetchall()))
