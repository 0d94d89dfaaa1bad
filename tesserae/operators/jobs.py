"""The job queue as tables: claims, leases, guarded transitions, reaping."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.folds import kind, streamed
from tesserae.operators.pick import top_by

# Seconds after which a claimed job counts as stale, by kind.
LEASE_SECONDS = {"scrape": 600, "collect": 300, "verify": 300, "synthesize": 600}


def lease_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, v, min(v // 3, 30)) for k, v in LEASE_SECONDS.items()], "job_kind string, lease_seconds long, heartbeat_seconds long")


def claimable(jobs: DataFrame, created: str, key: str, kinds: list[str] | None = None, n: int = 1) -> DataFrame:
    """The n oldest queued jobs of each kind, `claim_rank` their turn; kinds in the order given come first."""
    queued = jobs.where(F.col("status") == "queued")
    if kinds:
        queued = queued.where(F.col("job_kind").isin(*kinds))
    return top_by(queued, ["job_kind"], [F.col(created), F.col(key)], n, "claim_rank")


def reaped(jobs: DataFrame, leases: DataFrame, claimed_at: str, now: Column) -> DataFrame:
    """jobs with `stale`: claimed or running for longer than their kind's lease. Stale jobs go back to the queue."""
    out = jobs.join(F.broadcast(leases), "job_kind", "left")
    stale = F.coalesce(F.col("status").isin("claimed", "running") & (F.col(claimed_at) < now - F.col("lease_seconds")), F.lit(False))
    return out.withColumn("stale", stale).withColumn("status", F.when(stale, "queued").otherwise(F.col("status"))).drop("lease_seconds", "heartbeat_seconds")


def heartbeat_gaps(beats: DataFrame, job: str, seconds: str, tie: str, timeout: int) -> DataFrame:
    """Beats that came later than the timeout after the one before, with `gap`."""
    gap = F.col(seconds) - F.lag(seconds).over(Window.partitionBy(job).orderBy(seconds, tie))
    return beats.withColumn("gap", gap).where(F.col("gap") > timeout)


# The transitions that a job may make.
NEXT = {"queued": ("claimed",), "claimed": ("running", "failed"), "running": ("done", "failed"), "done": (), "failed": ()}


def folded_states(events: DataFrame, job: str, order: list[str], wanted: str, claimant: str) -> DataFrame:
    """(job, status, holder, accepted, rejected): events in order move a job only along NEXT, and only its
    holder may move it after the claim; all else is rejected and changes nothing. Events of a job are streamed."""

    def fold(k, rows):
        status, holder, accepted, rejected = "queued", None, 0, 0
        for row in rows:
            w, c = row[-2:]
            if w in NEXT[status] and (status == "queued" or holder == c):
                status, holder, accepted = w, c, accepted + 1
            else:
                rejected += 1
        yield k, status, holder, accepted, rejected

    rows = events.select(job, *[o for o in order if o != job], F.col(wanted).alias("_w"), F.col(claimant).cast("string").alias("_c"))
    return streamed(rows, job, order, ["_w", "_c"], f"{job} {kind(events, job)}, status string, holder string, accepted long, rejected long", fold)


def reaped_counts(jobs: DataFrame) -> DataFrame:
    """(job_kind, reaped) over what `reaped` returned, and a row for all kinds together."""
    n = F.count(F.when(F.col("stale"), 1)).alias("reaped")
    return jobs.groupBy("job_kind").agg(n).unionByName(jobs.agg(n).withColumn("job_kind", F.lit("all")))
