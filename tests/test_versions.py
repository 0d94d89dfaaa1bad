"""Versioned state: two writers, broken state, and what is kept."""

import threading

import pytest

from tesserae.sources import versions


def calls(spark, *rows):
    return spark.createDataFrame(list(rows), "key long, call long, seconds long")


def answers(df):
    return {r.call: (r.admitted, r.reason) for r in df.collect()}


def test_batches_see_what_came_before(spark, tmp_path):
    path = f"file://{tmp_path}/guard"
    assert answers(versions.decide(spark, path, calls(spark, (1, 1, 0), (1, 2, 10), (2, 3, 10)), 2, 3)) == {1: (True, None), 2: (True, None), 3: (True, None)}
    assert answers(versions.decide(spark, path, calls(spark, (1, 4, 3000), (1, 5, 4000), (1, 6, 4001)), 2, 3)) == {4: (False, "hour"), 5: (True, None), 6: (False, "day")}
    assert answers(versions.decide(spark, path, calls(spark, (1, 7, 86_405)), 2, 3)) == {7: (True, None)}
    number, rows = versions.newest(spark, path)
    assert number == 3 and sorted((r.key, r.seconds) for r in rows.collect()) == [(1, 10), (1, 4000), (1, 86_405), (2, 10)]


def test_the_last_place_is_taken_once(spark, tmp_path, monkeypatch):
    """Another writer comes between a writer's reading and its writing."""
    path = f"file://{tmp_path}/guard"
    create, others = versions.create, []

    def interrupted(*args):
        if not others:
            others.append(None)
            others[0] = answers(versions.decide(spark, path, calls(spark, (1, 2, 5)), 1, 1))
        return create(*args)

    monkeypatch.setattr(versions, "create", interrupted)
    assert answers(versions.decide(spark, path, calls(spark, (1, 1, 5)), 1, 1)) == {1: (False, "hour")}
    assert others == [{2: (True, None)}] and versions.numbers(spark, path) == [1, 2]


def test_writers_at_once(spark, tmp_path):
    path, got = f"file://{tmp_path}/guard", {}

    def run(i):
        got.update(answers(versions.decide(spark, path, calls(spark, (1, i, 7)), 3, 3)))

    threads = [threading.Thread(target=run, args=(i,)) for i in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(got) == 5 and sum(a for a, _ in got.values()) == 3
    assert versions.numbers(spark, path)[-1] == 5 and versions.newest(spark, path)[1].count() == 3


@pytest.mark.parametrize("broken", ["marker", "empty", "data", "rows", "missing"])
def test_broken_state_blocks(spark, tmp_path, broken):
    path = f"file://{tmp_path}/guard"
    versions.decide(spark, path, calls(spark, (1, 1, 0)), 5, 5)
    marker = tmp_path / "guard" / "v1"
    data = next(p for p in (tmp_path / "guard").glob("data-*"))
    if broken in ("marker", "empty"):
        marker.write_text("{not json" if broken == "marker" else "")
    for p in data.iterdir():
        if broken in ("data", "missing") or broken == "rows" and p.suffix == ".json":
            p.unlink()
            if broken == "data":
                p.write_text("{not json")
    if broken == "missing":
        data.rmdir()
    with pytest.raises(versions.StateBlocked):
        versions.decide(spark, path, calls(spark, (1, 2, 1)), 5, 5)
    assert answers(versions.guarded(spark, path, calls(spark, (1, 2, 1)), 5, 5)) == {2: (False, "state")}
    assert versions.numbers(spark, path) == [1]


def test_what_cannot_be_written_blocks(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/guard"
    monkeypatch.setattr(versions, "create", lambda *a: (_ for _ in ()).throw(OSError("full")))
    assert answers(versions.guarded(spark, path, calls(spark, (1, 2, 1)), 5, 5)) == {2: (False, "state")}
    monkeypatch.setattr(versions, "create", lambda *a: False)
    with pytest.raises(versions.StateBlocked, match="others"):
        versions.decide(spark, path, calls(spark, (1, 2, 1)), 5, 5, attempts=2)


def test_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "KEPT", 2)
    path = f"file://{tmp_path}/guard"
    for i in range(4):
        versions.decide(spark, path, calls(spark, (i, i, i)), 5, 5)
    assert versions.numbers(spark, path) == [3, 4] and len(list((tmp_path / "guard").glob("data-*"))) == 2
