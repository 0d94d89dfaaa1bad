"""Every registered query against its DuckDB statement on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from tesserae.plans.registry import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v if v is None or isinstance(v, (bool, int)) else str(v)


def rows(names, found):
    """The rows as text, their columns in the order of names."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.oracle])
def test_equals_oracle(spark, duck, name):
    got, want = REGISTRY[name].run(spark, SF), duck.sql(REGISTRY[name].oracle)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 125
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_domain_schedule_equals_brute_force(spark):
    got = {(r.host, r.event_id): (r.starts, r.refused) for r in REGISTRY["domain_schedule"].run(spark, SF).collect()}
    events = duckdb.sql(f"select user_id, event_id, floor(epoch(ts))::bigint s, event_type from read_parquet('{SF}/events.parquet') order by user_id, s, event_id").fetchall()
    last, pages = {}, {}
    for user, event, now, kind in events:
        host = str(user)
        if kind != "view" and pages.get(host, 0) >= 20:
            assert got[host, event] == (None, True)
            continue
        pages[host] = pages.get(host, 0) + (kind != "view")
        last[host] = now if host not in last else max(now, last[host] + 3600)
        assert got[host, event] == (last[host], False)


def test_capture_pipeline(spark):
    out = REGISTRY["capture_pipeline"].run(spark, SF).toPandas()
    assert len(out) and out.captured_html_path.str.match(r"captures/[0-9a-f]{64}\.html").all() and (out.review_chars == 0).all()
