"""Queries over events as calls, jobs and ledger entries."""

from pyspark.sql import functions as F

from tesserae.functions.rules import cents
from tesserae.functions.text import attempt_key, job_key, slug
from tesserae.operators import jobs, ledger, limits, pick
from tesserae.plans.registry import query
from tesserae.sources import table

_KINDS = "CASE event_id % 4 WHEN 0 THEN 'scrape' WHEN 1 THEN 'collect' WHEN 2 THEN 'verify' ELSE 'synthesize' END"
_STATUS = "CASE event_type WHEN 'click' THEN 'claimed' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'queued' END"
_LEASES = "(VALUES ('scrape', 600), ('collect', 300), ('verify', 300), ('synthesize', 600)) AS leases (job_kind, lease_seconds)"
NOW = 1_704_110_400  # 2024-01-01 12:00:00 UTC


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("seconds", F.unix_seconds(F.col("ts").cast("timestamp")))


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_hour,
count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS in_day FROM (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events)""")
def rolling_counts(spark, sf_dir):
    """Rows of each key in the last hour and day."""
    return limits.rolling_counts(_events(spark, sf_dir), "user_id", "seconds").select("event_id", "user_id", "in_hour", "in_day")


@query("""WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s FROM events),
f AS (SELECT user_id, list_reduce(list([{'id': event_id, 's': s, 'r': ''}] ORDER BY s, event_id), lambda a, x: a || [{'id': x[1].id, 's': x[1].s, 'r':
  CASE WHEN len(list_filter(a, lambda y: y.r = '' AND x[1].s - y.s <= 3600)) >= 2 THEN 'hour' WHEN len(list_filter(a, lambda y: y.r = '' AND x[1].s - y.s <= 86400)) >= 3 THEN 'day' ELSE '' END}]) AS folded FROM e GROUP BY 1),
u AS (SELECT user_id, unnest(folded) AS x FROM f)
SELECT user_id, x.id AS event_id, x.s AS seconds, x.r = '' AS admitted, CASE WHEN x.r <> '' THEN x.r END AS reason FROM u""")
def rolling_admission(spark, sf_dir):
    """Calls that pass two an hour and three a day for each user; refused ones use up nothing."""
    return limits.admissions(_events(spark, sf_dir), "user_id", "seconds", "event_id", 2, 3).drop("warned")


@query(f"""WITH j AS (SELECT event_id, {_KINDS} AS job_kind, {_STATUS} AS status, floor(epoch(ts))::BIGINT AS claimed_at FROM events)
SELECT event_id, job_kind, status IN ('claimed', 'running') AND claimed_at < {NOW} - lease_seconds AS stale,
CASE WHEN status IN ('claimed', 'running') AND claimed_at < {NOW} - lease_seconds THEN 'queued' ELSE status END AS status FROM j JOIN {_LEASES} USING (job_kind)""")
def lease_reaper(spark, sf_dir):
    """Jobs whose lease ran out go back to the queue."""
    rows = _events(spark, sf_dir).select("event_id", F.expr(_KINDS).alias("job_kind"), F.expr(_STATUS).alias("status"), F.col("seconds").alias("claimed_at"))
    return jobs.reaped(rows, jobs.lease_table(spark), "claimed_at", F.lit(NOW)).select("event_id", "job_kind", "stale", "status")


@query(f"""WITH e AS (SELECT user_id, ts, event_id, {_STATUS} AS w, (event_id % 2)::VARCHAR AS c FROM events),
f AS (SELECT user_id, list_reduce([{{'w': '', 'c': '', 'st': 'queued', 'h': NULL::VARCHAR, 'a': 0::BIGINT, 'r': 0::BIGINT}}] || list({{'w': w, 'c': c, 'st': '', 'h': NULL::VARCHAR, 'a': 0::BIGINT, 'r': 0::BIGINT}} ORDER BY ts, event_id),
  lambda s, x: CASE WHEN (s.st = 'queued' AND x.w = 'claimed') OR (s.h = x.c AND ((s.st = 'claimed' AND x.w IN ('running', 'failed')) OR (s.st = 'running' AND x.w IN ('done', 'failed'))))
  THEN {{'w': '', 'c': '', 'st': x.w, 'h': x.c, 'a': s.a + 1, 'r': s.r}} ELSE {{'w': '', 'c': '', 'st': s.st, 'h': s.h, 'a': s.a, 'r': s.r + 1}} END) AS s FROM e GROUP BY 1)
SELECT user_id, s.st AS status, s.h AS holder, s.a AS accepted, s.r AS rejected FROM f""")
def job_state_fold(spark, sf_dir):
    """Guarded transitions: what each key's events lead to, and how many were turned down."""
    events = table(spark, sf_dir, "events").withColumn("wanted", F.expr(_STATUS)).withColumn("claimant", (F.col("event_id") % 2).cast("string"))
    return jobs.folded_states(events, "user_id", ["ts", "event_id"], "wanted", "claimant")


_EST = "ceil((l_quantity * 3.0 + l_linenumber * 15.0) / 1000000.0 * 100)"
_ACTUAL = "ceil((l_quantity * 2500.0 * 3.0 + l_linenumber * 900.0 * 15.0) / 1000000.0 * 100)"


@query(f"""SELECT o_custkey, coalesce(sum(CASE WHEN l_linestatus = 'F' THEN {_ACTUAL}::BIGINT END), 0)::BIGINT AS settled_cents, coalesce(sum(CASE WHEN l_linestatus <> 'F' THEN 25 END), 0)::BIGINT AS reserved_cents,
(coalesce(sum(CASE WHEN l_linestatus = 'F' THEN {_ACTUAL}::BIGINT END), 0) + coalesce(sum(CASE WHEN l_linestatus <> 'F' THEN 25 END), 0))::BIGINT AS exposure_cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def ledger_exposure(spark, sf_dir):
    """Settled and reserved cents of each project."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber", "l_linestatus")
    calls = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    actual = F.when(F.col("l_linestatus") == "F", cents(F.col("l_quantity") * 2500.0, F.col("l_linenumber") * 900.0, F.lit(3.0), F.lit(15.0)))
    return ledger.exposure(calls.withColumn("actual", actual).withColumn("est", F.lit(25).cast("long")), "o_custkey", "est", "actual")


@query(f"""WITH j AS (SELECT event_id, {_KINDS} AS job_kind, CASE WHEN event_id % 8 = 0 THEN 'ad_library.scrapecreators' WHEN event_id % 8 = 4 THEN 'other' ELSE 'web.fetch' END AS connector FROM events)
SELECT event_id, job_kind, connector, CASE WHEN job_kind = 'scrape' THEN CASE connector WHEN 'ad_library.scrapecreators' THEN 80 WHEN 'web.fetch' THEN 0 END
WHEN job_kind = 'collect' THEN 25 WHEN job_kind = 'verify' THEN 10 ELSE 75 END::BIGINT AS est_cents FROM j""")
def price_lookup(spark, sf_dir):
    """The card of the connector, else of the kind, else none."""
    connector = "CASE WHEN event_id % 8 = 0 THEN 'ad_library.scrapecreators' WHEN event_id % 8 = 4 THEN 'other' ELSE 'web.fetch' END"
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_KINDS).alias("job_kind"), F.expr(connector).alias("connector"))
    return ledger.priced(rows, ledger.price_cards(spark)).select("event_id", "job_kind", "connector", "est_cents")


@query("""WITH e AS (SELECT user_id, event_id, ts, (event_id % 97)::VARCHAR AS ref, (10 + event_id % 31)::BIGINT AS est FROM events),
f AS (SELECT user_id, list_reduce([[{'ref': '', 'est': 0::BIGINT, 'o': ''}]] || list([{'ref': ref, 'est': est, 'o': ''}] ORDER BY ts, ref, est), lambda a, x: a || [{'ref': x[1].ref, 'est': x[1].est, 'o':
  CASE WHEN len(list_filter(a, lambda y: y.o = 'ok' AND y.ref = x[1].ref)) > 0 THEN 'skip'
  WHEN coalesce(list_sum(list_transform(list_filter(a, lambda y: y.o = 'ok'), lambda y: y.est)), 0) + x[1].est <= 400 THEN 'ok' ELSE 'refused' END}]) AS folded FROM e GROUP BY 1),
u AS (SELECT user_id, unnest(folded[2:]) AS x FROM f)
SELECT user_id, x.ref AS ref, x.o AS outcome FROM u""")
def reserve_outcomes(spark, sf_dir):
    """Reservations in order against a ceiling."""
    calls = table(spark, sf_dir, "events").select("user_id", "ts", (F.col("event_id") % 97).cast("string").alias("ref"), (10 + F.col("event_id") % 31).alias("est"))
    return ledger.reserve_fold(calls, "user_id", "ref", "ts", "est", 400)


@query(f"""SELECT event_id, job_kind, claim_rank FROM (SELECT event_id, {_KINDS} AS job_kind, row_number() OVER (PARTITION BY {_KINDS} ORDER BY ts, event_id) AS claim_rank FROM events WHERE event_type = 'signup') WHERE claim_rank <= 3""")
def claim_queue(spark, sf_dir):
    """The oldest queued jobs of each kind."""
    rows = table(spark, sf_dir, "events").withColumn("job_kind", F.expr(_KINDS)).withColumn("status", F.expr(_STATUS))
    return jobs.claimable(rows, "ts", "event_id", n=3).select("event_id", "job_kind", F.col("claim_rank").cast("long"))


@query("SELECT event_id, user_id, gap FROM (SELECT event_id, user_id, s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS gap FROM (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events)) WHERE gap > 43200")
def heartbeat_gaps(spark, sf_dir):
    """Beats that came too late."""
    return jobs.heartbeat_gaps(_events(spark, sf_dir), "user_id", "seconds", "event_id", 43_200).select("event_id", "user_id", "gap")


@query("SELECT event_id, user_id, coalesce(greatest(0.0, 7200.0 - (s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id))), 0.0)::DOUBLE AS wait FROM (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events)")
def interval_waits(spark, sf_dir):
    """What is left of the interval since the request before."""
    return limits.waits(_events(spark, sf_dir), "user_id", "seconds", "event_id", 7200).select("event_id", "user_id", "wait")


_FULL = "x[1].page AND len(list_filter(a, lambda y: y.page AND NOT y.r)) >= 20"


@query(f"""WITH e AS (SELECT user_id::VARCHAR AS host, event_id, floor(epoch(ts))::BIGINT AS s, event_type <> 'view' AS page FROM events),
f AS (SELECT host, list_reduce([[{{'id': -1::BIGINT, 's': NULL::BIGINT, 'page': false, 'r': false}}]] || list([{{'id': event_id, 's': s, 'page': page, 'r': false}}] ORDER BY s, event_id), lambda a, x: a || [{{'id': x[1].id,
  's': CASE WHEN {_FULL} THEN NULL ELSE greatest(x[1].s, coalesce(list_max(list_transform(a, lambda y: y.s)) + 3600, x[1].s)) END, 'page': x[1].page, 'r': {_FULL}}}]) AS folded FROM e GROUP BY 1),
u AS (SELECT host, unnest(folded[2:]) AS x FROM f)
SELECT host, x.id AS event_id, x.s AS starts, x.r AS refused FROM u""")
def domain_schedule(spark, sf_dir):
    """When a polite fetcher starts each request of a host, and which it refuses."""
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("host"), "seconds", "event_id", (F.col("event_type") != "view").alias("page"))
    return limits.schedule(rows, "host", "seconds", "event_id", 3600, 20, "page")


@query("""SELECT key, min(event_id) AS event_id FROM (SELECT event_id, 'scrape:ads:user-' || user_id || ':' || strftime(ts, '%Y%m%d') || CASE WHEN event_id % 3 = 2 THEN ':a2' ELSE '' END AS key FROM events) GROUP BY 1""")
def idempotent_enqueue(spark, sf_dir):
    """One job for each key of a day."""
    key = attempt_key(job_key("scrape", "ads", slug(F.concat(F.lit("  User "), F.col("user_id").cast("string"))), F.date_format("ts", "yyyyMMdd")), F.col("event_id") % 3)
    rows = table(spark, sf_dir, "events").select("event_id", key.alias("key"))
    return pick.first_by(rows, ["key"], [F.col("event_id")]).select("key", "event_id")


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM events), k AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM n WHERE r <= 500)
SELECT event_id, place, place // 50 AS chunk FROM k""")
def bounded_buffer(spark, sf_dir):
    """What a buffer of 500 still holds, in chunks of 50."""
    return pick.bounded_buffer(table(spark, sf_dir, "events"), "ts", "event_id", 500, 50).select("event_id", F.col("place").cast("long"), "chunk")


@query(f"SELECT {_KINDS} AS job_kind, count(*) FILTER (WHERE {_STATUS} = 'failed') AS failed, array_to_string(list(event_id ORDER BY event_id) FILTER (WHERE {_STATUS} = 'failed')[1:5], ',') AS sample FROM events GROUP BY 1")
def error_samples(spark, sf_dir):
    """Failures of each kind and the first five of them."""
    rows = table(spark, sf_dir, "events").withColumn("job_kind", F.expr(_KINDS)).withColumn("failed", F.expr(_STATUS) == "failed")
    first = pick.top_by(rows.where("failed"), ["job_kind"], [F.col("event_id")], 5).groupBy("job_kind").agg(F.array_join(F.sort_array(F.collect_list("event_id")), ",").alias("sample"))
    return rows.groupBy("job_kind").agg(F.count(F.when(F.col("failed"), 1)).alias("failed")).join(first, "job_kind", "left")
