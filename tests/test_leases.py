"""Leases with timers, as a stream."""

import datetime

import pytest
from pyspark.sql import functions as F

from tesserae.operators import jobs
from tesserae.streaming import drain, lease_events

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
SCHEMA = "job string, job_kind string, wanted string, claimant string, at timestamp"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def streamed(spark, tmp_path, batches):
    """(batch, job, event, status, holder, milliseconds) that come out; each batch is a list of (job, kind, wanted, claimant, seconds)."""
    got = []
    for i, rows in enumerate(batches):
        spark.createDataFrame([(j, k, w, c, at(s)) for j, k, w, c, s in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = lease_events(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).withColumn("ms", F.unix_millis("at") - 1000 * int(START.timestamp()))
        drain(out, str(tmp_path / "cp"), lambda batch, _, i=i: got.extend((i, r.job, r.event, r.status, r.holder, r.ms) for r in batch.collect()))
    return got


def test_expiry_alone_puts_a_job_back(spark, tmp_path):
    got = streamed(spark, tmp_path, [
        [("a", "scrape", "claimed", "w1", 0), ("b", "collect", "claimed", "w2", 0), ("b", "collect", "running", "w2", 5), ("b", "collect", "done", "w2", 9), ("c", "scrape", "claimed", "w3", 0)],
        [("c", "scrape", "beat", "w3", 500), ("c", "scrape", "beat", "w9", 590), ("a", "scrape", "running", "w8", 30)],
        [("x", "none", "claimed", "w", 700)],  # only the watermark moves
        [("a", "scrape", "claimed", "w4", 800)],
        [("x", "none", "claimed", "w", 5000)],
    ])
    moved = [(i, j, e, s, h, t) for i, j, e, s, h, t in got if e == "moved"]
    assert sorted(moved) == [(0, "a", "moved", "claimed", "w1", 0), (0, "b", "moved", "claimed", "w2", 0), (0, "b", "moved", "done", "w2", 9000), (0, "b", "moved", "running", "w2", 5000), (0, "c", "moved", "claimed", "w3", 0), (3, "a", "moved", "claimed", "w4", 800_000)]
    assert sorted(g for g in got if g[2] == "reaped") == [(2, "a", "reaped", "queued", "w1", 600_001), (4, "a", "reaped", "queued", "w4", 1_400_001), (4, "c", "reaped", "queued", "w3", 1_100_001)]
    assert {(g[1], g[4]) for g in got if g[2] == "rejected"} == {("c", "w9"), ("a", "w8"), ("x", "w")}


def test_a_late_event_finds_the_lease_gone(spark, tmp_path):
    got = streamed(spark, tmp_path, [[("a", "verify", "claimed", "w1", 0), ("a", "verify", "running", "w1", 300), ("a", "verify", "done", "w1", 601), ("b", "verify", "claimed", "w2", 0), ("b", "verify", "running", "w2", 200), ("b", "verify", "done", "w2", 300)]])
    assert [g[2:] for g in sorted(got, key=lambda g: g[5]) if g[1] == "a"] == [("moved", "claimed", "w1", 0), ("moved", "running", "w1", 300_000), ("reaped", "queued", "w1", 600_001), ("rejected", "queued", "w1", 601_000)]
    assert [g[2:] for g in got if g[1] == "b"] == [("moved", "claimed", "w2", 0), ("moved", "running", "w2", 200_000), ("moved", "done", "w2", 300_000)]


def test_equals_the_reaper(spark, tmp_path):
    kinds = list(jobs.LEASE_SECONDS)
    claims = [(f"j{i}", kinds[i % 4], "claimed", "w", (i * 37) % 1000) for i in range(60)]
    now = 1000
    got = streamed(spark, tmp_path, [claims, [("end", "none", "claimed", "w", now)]])
    table = spark.createDataFrame([(j, k, "claimed", s) for j, k, _, _, s in claims], "job string, job_kind string, status string, claimed_at long")
    stale = {r.job for r in jobs.reaped(table, jobs.lease_table(spark), "claimed_at", F.lit(now)).where("stale").collect()}
    assert {g[1] for g in got if g[2] == "reaped"} == stale and 10 < len(stale) < 60


def test_without_timers_it_is_an_error(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="timers"):
            lease_events(spark.createDataFrame([], SCHEMA))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
