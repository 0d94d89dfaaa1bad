"""Leases of jobs as state with timers: a claim sets a timer, a beat moves it, and its expiry alone puts the job back."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tesserae.operators.jobs import LEASE_SECONDS, NEXT
from tesserae.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "job string, job_kind string, event string, status string, holder string, at timestamp"
_STATE = "job_kind string, status string, holder string, due long"


class Leases(StatefulProcessor):
    """The state of a job is its kind, status, holder and when its lease is due, in milliseconds; it goes with the lease."""

    def __init__(self, seconds: dict[str, int]):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.lease = handle, handle.getValueState("lease", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        job = key[0]
        held = self.lease.get() if self.lease.exists() else None
        kind, status, holder, due = held or (None, "queued", None, None)
        before = due
        for at, wanted, claimant, kind_now in sorted((r["at_ms"], r["wanted"], r["claimant"] or "", r["job_kind"]) for r in rows):
            if due is not None and at > due:  # its timer has not come yet, as the batch brings what is later
                yield row(job, kind, "reaped", "queued", holder, due + 1)
                kind, status, holder, due = None, "queued", None, None
            if wanted == "beat" and status in ("claimed", "running") and claimant == holder:
                due = at + 1000 * self.seconds[kind]
            elif wanted in NEXT[status] and (status == "queued" or claimant == holder) and (kind or kind_now) in self.seconds:
                kind, status, holder = kind or kind_now, wanted, claimant
                due = at + 1000 * self.seconds[kind] if status in ("claimed", "running") else None
                yield row(job, kind, "moved", status, holder, at)
                if due is None:  # done or failed: nothing is left to remember
                    kind, status, holder = None, "queued", None
            else:
                yield row(job, kind or kind_now, "rejected", status, claimant, at)
        if before is not None and before != due:
            self.handle.deleteTimer(before + 1)
        if due is not None:
            self.lease.update((kind, status, holder, due))
            if due != before:
                self.handle.registerTimer(due + 1)
        elif held is not None:
            self.lease.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.lease.exists():
            kind, _, holder, due = self.lease.get()
            if due + 1 == expiredTimerInfo.getExpiryTimeInMs():
                self.lease.clear()
                yield row(key[0], kind, "reaped", "queued", holder, due + 1)

    def close(self) -> None:
        pass


def row(job, kind, event, status, holder, at_ms) -> Row:
    import datetime

    return Row(job=job, job_kind=kind, event=event, status=status, holder=holder, at=datetime.datetime.fromtimestamp(at_ms / 1000, datetime.UTC))


def lease_events(events: DataFrame, seconds: dict[str, int] | None = None, late: str = "0 seconds") -> DataFrame:
    """OUT of a stream with job, job_kind, wanted (a status, or `beat`), claimant and at (timestamp).

    `moved` and `rejected` rows answer events; a `reaped` row comes when a lease runs out: more than the kind's seconds after the
    claim, the move to running or the last beat of its holder. It comes with a later event of the job, or when the watermark passes,
    without any event of the job. A reaped job can be claimed again; a job that is done or failed is forgotten. Events of a
    micro-batch are taken in the order of their times. Kinds without a lease are rejected.
    """
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"timers need spark.sql.streaming.stateStore.providerClass={PROVIDER}")
    ship(spark)
    rows = events.withWatermark("at", late).select(F.col("job").cast("string").alias("job"), "job_kind", "wanted", F.col("claimant").cast("string").alias("claimant"), "at", F.unix_millis("at").alias("at_ms"))
    return rows.groupBy("job").transformWithState(Leases(seconds or LEASE_SECONDS), OUT, "Append", "EventTime", eventTimeColumnName="at")
