"""The source of stored responses."""

import json
import os

import pytest

from tesserae.sources import cursor


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ads") / "stored")
    rows = []
    for key, country, pages in (("a/b", "US", [["1", "2"], ["3"], ["4", "5"]]), ("c", "US", [["6"], None, ["7"]]), ("c", "DE", [["8"]]), ("é.", "DE", [["9"], []]), ("long", "FR", [[str(100 + i)] for i in range(14)])):
        for i, ads in enumerate(pages):
            rows.append((key, country, None if i == 0 else f"p{i}", f"p{i + 1}" if i + 1 < len(pages) else None, 500 if ads is None else 200, ads, i))
    cursor.store_responses(spark.createDataFrame(rows, f"{cursor.RESPONSES}, at long").repartition(3), f"file://{path}", "at")
    return path


def scan(spark, path, where=None, **options):
    df = spark.read.format("stored_ads").options(**options).load(path)
    rows = (df.where(where) if where else df).collect()
    return sorted((r.country, r.key, r.page_no, r.pos, r.ad, r.is_partial) for r in rows)


def test_keys_are_followed_on_their_own(spark, stored):
    got = scan(spark, stored)
    assert [g for g in got if g[1] != "long"] == [("DE", "c", 0, 0, "8", False), ("DE", "é.", 0, 0, "9", False), ("US", "a/b", 0, 0, "1", False), ("US", "a/b", 0, 1, "2", False), ("US", "a/b", 1, 0, "3", False), ("US", "a/b", 2, 0, "4", False), ("US", "a/b", 2, 1, "5", False), ("US", "c", 0, 0, "6", True)]
    assert [g[2] for g in got if g[1] == "long"] == list(range(10))
    assert len([g for g in scan(spark, stored, requests=3) if g[1] == "long"]) == 3
    assert [g[4] for g in scan(spark, stored, "key = 'a/b'", limit=3)] == ["1", "2", "3"]


def test_filters_go_into_the_source(spark, stored, monkeypatch):
    assert {g[4] for g in scan(spark, stored, "key = 'c' AND country = 'US'")} == {"6"} and {g[4] for g in scan(spark, stored, "key IN ('c', 'é.') AND page_no = 0")} == {"6", "8", "9"}
    assert scan(spark, stored, "key = 'c' AND key = 'é.'") == [] and scan(spark, stored, "country = 'XX'") == []
    reader = cursor.Reader({"path": stored})
    left = list(reader.pushFilters([cursor.EqualTo(("key",), "c"), cursor.EqualTo(("page_no",), 0)]))
    assert [f.attribute for f in left] == [("page_no",)]
    parts = reader.partitions()
    assert {(p.country, p.bucket) for p in parts} == {("US", cursor.bucket_of("c")), ("DE", cursor.bucket_of("c"))}
    plan = spark.read.format("stored_ads").load(stored).where("key = 'c'")._jdf.queryExecution().executedPlan().toString()
    assert "= c" not in plan  # nothing is left to compare


def test_broken_and_missing_responses(spark, tmp_path):
    def put(key, lines):
        folder = tmp_path / "s" / "US" / cursor.bucket_of(key)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{cursor.quote_name(key)}.jsonl").write_text("\n".join(lines))

    page = lambda c, n, ads: json.dumps({"cursor": c, "next": n, "status": 200, "ads": ads})
    put("broken", [page(None, "x", ["1"]), "{not json", page("y", None, ["2"])])
    put("gap", [page(None, "x", ["3"])])
    put("none", [])
    put("loop", [page(None, "x", ["4"]), page("x", "x", ["5"])])
    put("odd", [page(None, None, "text")])
    got = scan(spark, str(tmp_path / "s"))
    assert [(g[1], g[4], g[5]) for g in got] == [("broken", "1", True), ("gap", "3", True), ("loop", "4", False), *[("loop", "5", False)] * 9]
    assert scan(spark, str(tmp_path / "nowhere")) == [] and not os.path.exists(tmp_path / "nowhere")
