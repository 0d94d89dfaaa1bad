"""Queries over rules, records and whole dataflows whose inputs are made from the tables."""

import uuid

from pyspark.sql import functions as F

from tesserae.functions import html, rules, shapes, text, urls
from tesserae.operators import cache, census, jobs, ledger, limits, pick, robots, verify
from tesserae.plans import flows
from tesserae.plans.evidence_plans import _NORMAL
from tesserae.plans.job_plans import _KINDS, _events
from tesserae.plans.registry import query
from tesserae.session import shared_dir, ship
from tesserae.sources import ads, state, table, versions

_STATUS = "element_at(array(200, 402, 403, 404, 429, 500, 302), cast(event_id % 7 + 1 as int))"
_BODY = "CASE WHEN event_id % 3 = 0 THEN 'Out of Credits' WHEN event_id % 3 = 1 THEN 'forbidden' END"
_DUCK_STATUS = "[200, 402, 403, 404, 429, 500, 302][event_id % 7 + 1]"


@query(f"""WITH e AS (SELECT event_id, {_DUCK_STATUS} AS status, {_BODY} AS body FROM events)
SELECT event_id, CASE WHEN status = 402 OR (status = 403 AND coalesce(contains(lower(body), 'credit'), false)) THEN 'exhausted' WHEN status = 429 THEN 'rate_limited' ELSE 'ok' END AS credit,
CASE WHEN status = 404 THEN 'absent' WHEN status = 200 THEN 'ok' ELSE 'error' END AS robots,
CASE WHEN event_id % 5 = 0 THEN event_id % 100 WHEN event_id % 5 = 1 THEN 7 END AS credits_remaining FROM e""")
def response_states(spark, sf_dir):
    """What status codes, refusals and headers of answers mean."""
    status, body = F.expr(_STATUS), F.expr(_BODY)
    headers = F.when(F.col("event_id") % 5 == 0, F.create_map(F.lit("x-credit-remaining"), F.lit("x"), F.lit("credits-remaining"), (F.col("event_id") % 100).cast("string"))).when(F.col("event_id") % 5 == 1, F.create_map(F.lit("x-credits-remaining"), F.lit("7")))
    return table(spark, sf_dir, "events").select("event_id", rules.credit_status(status, body).alias("credit"), rules.robots_state(status).alias("robots"), rules.credit_figures(headers)["credits_remaining"].alias("credits_remaining"))


_MESSAGES = ("Quote is not verbatim", "duplicate key", "The resource already exists", "timeout", "span is wrong", "It does exist", "")
_MESSAGE = "[" + ", ".join(f"'{m}'" for m in _MESSAGES) + "][event_id % 7 + 1]"


@query(f"""WITH e AS (SELECT event_id, {_MESSAGE} AS m, CASE event_id % 3 WHEN 0 THEN 'Duplicate' WHEN 1 THEN 'not_found' END AS code, CASE event_id % 4 WHEN 0 THEN 409 WHEN 1 THEN 404 ELSE 500 END AS status FROM events)
SELECT event_id, regexp_matches(lower(m), 'verbatim|not an enabled connector|span|not a registered finding kind|required') AS content,
coalesce(contains(lower(code), 'duplicate'), false) OR contains(lower(m), 'already exists') OR (status IN (409, 400) AND contains(lower(m), 'exist')) AS duplicate,
coalesce(code = 'not_found' AND status = 404, false) AS missing FROM e""")
def failure_kinds(spark, sf_dir):
    """Failures of content, duplicates and missing objects told apart."""
    message = F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % 7 + 1).cast("int"))
    code = F.when(F.col("event_id") % 3 == 0, "Duplicate").when(F.col("event_id") % 3 == 1, "not_found")
    status = F.when(F.col("event_id") % 4 == 0, 409).when(F.col("event_id") % 4 == 1, 404).otherwise(500)
    return table(spark, sf_dir, "events").select("event_id", rules.is_content_rejection(message).alias("content"), rules.is_duplicate_object(code, status, message).alias("duplicate"), rules.is_object_missing(code, status).alias("missing"))


_TYPES = ("text/html; charset=utf-8", "application/xhtml+xml", "image/png", "IMAGE/webp", "video/webm", "x")
_SIZE = "length(html)"


@query(f"""WITH p AS (SELECT page_id, length(html) AS size, [{", ".join(repr(t) for t in _TYPES)}][page_id % 6 + 1] AS type, [200, 200, 302, 404][page_id % 4 + 1] AS status FROM pages)
SELECT page_id, CASE WHEN status = 302 THEN 'redirect' WHEN status <> 200 THEN 'status' WHEN page_id % 6 > 1 THEN 'type' WHEN size > 3000 THEN 'size' ELSE 'ok' END AS page,
CASE WHEN status <> 200 THEN 'status' WHEN page_id % 6 NOT IN (2, 3) THEN 'type' WHEN size > 5000 THEN 'size' ELSE 'ok' END AS image,
CASE WHEN page_id % 6 = 2 THEN '.png' WHEN page_id % 6 = 3 THEN '.webp' ELSE '.jpg' END AS image_ext, CASE WHEN page_id % 6 = 4 THEN '.webm' ELSE '.mp4' END AS video_ext FROM p""")
def fetch_outcomes(spark, sf_dir):
    """Why a fetched page or image is used or not, and the extension that it is stored under."""
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("page_id") % 6 + 1).cast("int"))
    status = F.element_at(F.array(*map(F.lit, (200, 200, 302, 404))), (F.col("page_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("size"), kind.alias("type"), status.alias("status"))
    page, image = robots.fetched_text(F.col("status"), F.col("type"), F.col("size"), 3000), robots.fetched_image(F.col("status"), F.col("type"), F.col("size"), 5000)
    return rows.select("page_id", page.alias("page"), image.alias("image"), urls.extension(F.col("type"), F.lit("image")).alias("image_ext"), urls.extension(F.col("type"), F.lit("video")).alias("video_ext"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'ok' WHEN page_id % 5 = 0 THEN 'redirect' WHEN page_id % 5 = 1 THEN 'address' WHEN page_id % 5 = 2 THEN 'error' ELSE 'ok' END AS outcome,
CASE WHEN page_id % 5 = 4 THEN 'first' WHEN page_id % 5 = 3 THEN 'second' END AS body FROM pages""")
def one_redirect(spark, sf_dir):
    """Fetches that may follow one redirect: to the same host, to public addresses."""
    k = F.col("page_id") % 5
    first = table(spark, sf_dir, "pages").select("page_id", "url", F.when(k == 4, "ok").otherwise("redirect").alias("outcome"), F.when(k == 0, "https://elsewhere.test/x").otherwise("/next?p=1").alias("location"), F.when(k == 4, "first").alias("body"))
    addresses = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(F.lit("8.8.8.8"), F.when(k == 1, "10.0.0.1").otherwise("2606:4700::1111"))).alias("ip"))
    then = table(spark, sf_dir, "pages").where(k != 4).select("page_id", F.when(k == 2, "error").otherwise("ok").alias("outcome"), F.when(k != 2, "second").alias("body"))
    return robots.after_redirect(first, then.join(robots.all_public(addresses, "page_id", "ip"), "page_id"), "page_id")


@query("""SELECT event_id, ceil((event_id % 5000 * r.i + event_id % 700 * r.o) / 1000000.0 * 100)::BIGINT AS actual_cents, ceil((event_id % 900 * 2 * r.i + 100 * r.o) / 1000000.0 * 100)::BIGINT AS worst
FROM events JOIN (VALUES (0, 3.0, 15.0), (1, 15.0, 75.0), (2, 0.8, 4.0)) AS r (k, i, o) ON event_id % 3 = r.k""")
def rate_costs(spark, sf_dir):
    """Cents of calls by the rates of their models, and the most that a call may cost."""
    models = F.element_at(F.array(*map(F.lit, rules.MODEL_RATES)), (F.col("event_id") % 3 + 1).cast("int"))
    calls = table(spark, sf_dir, "events").select("event_id", models.alias("model"), (F.col("event_id") % 5000).alias("tin"), (F.col("event_id") % 700).alias("tout"))
    rates = ledger.rate_table(spark)
    worst = calls.join(F.broadcast(rates), "model").select("event_id", rules.worst_cents(F.col("event_id") % 900, F.lit(100), F.col("rate_in"), F.col("rate_out")).alias("worst"))
    return ledger.rated(calls, rates, "model", "tin", "tout").select("event_id", "actual_cents").join(worst, "event_id")


@query(f"""WITH j AS (SELECT {_KINDS} AS job_kind, event_type IN ('click', 'view') AND floor(epoch(ts)) < 1704110400 - lease AS stale FROM events JOIN (VALUES (0, 600), (1, 300), (2, 300), (3, 600)) AS l (k, lease) ON event_id % 4 = k)
SELECT job_kind, count(*) FILTER (WHERE stale) AS reaped FROM j GROUP BY 1 UNION ALL SELECT 'all', count(*) FILTER (WHERE stale) FROM j""")
def reaped_counts(spark, sf_dir):
    """How many jobs of each kind went back to the queue, and in all."""
    rows = _events(spark, sf_dir).select("event_id", F.expr(_KINDS).alias("job_kind"), F.when(F.col("event_type") == "click", "claimed").when(F.col("event_type") == "view", "running").otherwise("done").alias("status"), F.col("seconds").alias("claimed_at"))
    return jobs.reaped_counts(jobs.reaped(rows, jobs.lease_table(spark), "claimed_at", F.lit(1_704_110_400)))


@query("""WITH r AS (SELECT user_id, event_id, ts, sum(event_id % 50) OVER w AS running, event_type = 'purchase' AS mark FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, running::BIGINT AS running, CASE WHEN mark THEN running - coalesce(max(CASE WHEN mark THEN running END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END::BIGINT AS drained FROM r""")
def running_costs(spark, sf_dir):
    """Costs as they add up for each key, and what each checkpoint drains."""
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 50).alias("cost"), "event_type")
    return ledger.running_costs(calls, "user_id", ["ts", "event_id"], "cost", F.col("event_type") == "purchase").select("user_id", "event_id", "running", "drained")


@query("""SELECT flush_no, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 25 AS flush_no FROM events) GROUP BY 1""")
def usage_flushes(spark, sf_dir):
    """A usage buffer that is sent whenever it holds 25 events."""
    return pick.buffer_flushes(table(spark, sf_dir, "events"), "ts", "event_id", 25)


@query("""WITH a AS (SELECT event_id // 4 AS ref, event_id % 4 AS attempt, event_type = 'purchase' AS ok FROM events), u AS (SELECT * FROM a WHERE attempt < 3)
SELECT ref, coalesce(min(CASE WHEN ok THEN attempt END) + 1, count(*))::BIGINT AS attempts, bool_or(ok) AS settled FROM u GROUP BY 1""")
def settle_retries(spark, sf_dir):
    """Settlements tried three times at most."""
    attempts = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).cast("long").alias("ref"), (F.col("event_id") % 4).alias("attempt"), (F.col("event_type") == "purchase").alias("ok"))
    return ledger.settled_with_retries(attempts, "ref", "attempt", "ok").select("ref", F.col("attempts").cast("long"), "settled")


@query("""WITH r AS (SELECT o_orderkey AS ref, (o_orderkey % 90)::BIGINT AS est_cents FROM orders), m AS (SELECT l_orderkey AS ref, (l_quantity::BIGINT * 2) AS actual_cents, est_cents, l_linenumber * 100000000 + l_partkey * 10000 + l_suppkey AS p, l_quantity FROM lineitem JOIN r ON l_orderkey = ref),
s AS (SELECT ref, actual_cents FROM m WHERE actual_cents <= est_cents QUALIFY row_number() OVER (PARTITION BY ref ORDER BY p, l_quantity) = 1)
SELECT ref, est_cents, actual_cents, ref IN (SELECT ref FROM m WHERE actual_cents > est_cents) AS overspent FROM r LEFT JOIN s USING (ref)""")
def settlements(spark, sf_dir):
    """Reservations with the first settlement of each that is within it, and those of which one was refused for costing more."""
    reserves = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"), (F.col("o_orderkey") % 90).alias("est_cents"))
    pos = F.struct((F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("p"), "l_quantity")
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ref"), pos.alias("pos"), (F.col("l_quantity").cast("long") * 2).alias("actual_cents"))
    return ledger.settled(reserves, done, "ref").select("ref", "est_cents", "actual_cents", "overspent")


@query("""SELECT o_custkey, CASE WHEN o_orderpriority <= '2' THEN 'urgent' ELSE o_orderpriority END AS angle_key, o_orderkey AS analysis FROM
(SELECT * FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)""")
def angle_members(spark, sf_dir):
    """Who stands behind each angle of the census: the latest ok analysis of each entity, as rows."""
    orders = table(spark, sf_dir, "orders").withColumn("angle_key", F.when(F.col("o_orderpriority") <= "2", "urgent").otherwise(F.col("o_orderpriority")))
    return census.angle_members(orders, "o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderstatus") == "F", ["angle_key"])


@query("""WITH l AS (SELECT * FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT o_orderpriority, count(DISTINCT o_custkey) AS competitor_count, count(*) AS total_count, count(*) FILTER (WHERE o_totalprice > 100000) AS verbatim_count, count(*) FILTER (WHERE NOT o_totalprice > 100000) AS not_verbatim_count FROM l GROUP BY 1""")
def angle_counts(spark, sf_dir):
    """The census of angles over the latest ok analysis of each entity."""
    return census.angle_census(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderstatus") == "F", ["o_orderpriority"], F.col("o_totalprice") > 100000)


@query("""WITH f AS (SELECT doc_id, sha256(text) AS h FROM documents), s AS (SELECT h, min(doc_id) AS there FROM f WHERE doc_id % 2 = 0 GROUP BY 1), n AS (SELECT h, min(doc_id) AS doc_id FROM f WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT h, coalesce(there, doc_id) AS doc_id, there IS NULL AS inserted FROM n LEFT JOIN s USING (h)""")
def minted_ids(spark, sf_dir):
    """Minted evidence: the id that is there already, or a new one."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return pick.minted(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), ["h"], [F.col("doc_id")], "doc_id").select("h", "doc_id", "inserted")


@query("""WITH f AS (SELECT user_id AS run, event_type AS status, ts AS finished_at FROM events WHERE event_type IN ('purchase', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1)
SELECT c_custkey AS run, coalesce(status, 'running') AS status, finished_at FROM customer LEFT JOIN f ON c_custkey = run""")
def run_states(spark, sf_dir):
    """Runs with their last finish; those without one are running."""
    done = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'error')").select(F.col("user_id").alias("run"), F.col("event_type").alias("status"), "ts")
    return pick.run_states(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run")), done, "run", "ts")


@query("""SELECT l_orderkey AS analysis, l_linenumber AS angle, contains('hook ' || l_partkey || ' of ' || l_suppkey, 'hook ' || (l_partkey - l_linenumber % 2)) AS graded FROM lineitem
UNION ALL SELECT o_orderkey, 0, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def graded_observations(spark, sf_dir):
    """Observations graded by whether their hook stands in the ad's body, each analysis replacing its own."""
    lines = table(spark, sf_dir, "lineitem")
    body = F.concat(F.lit("hook "), "l_partkey", F.lit(" of "), "l_suppkey")
    hook = F.concat(F.lit("hook "), (F.col("l_partkey") - F.col("l_linenumber") % 2).cast("string"))
    new = lines.select(F.col("l_orderkey").alias("analysis"), F.col("l_linenumber").cast("long").alias("angle"), text.is_verbatim(body, hook).alias("graded"))
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("analysis"), F.lit(0).cast("long").alias("angle"), F.lit(None).cast("boolean").alias("graded"))
    return pick.replaced(old, new, ["analysis"])


@query("""WITH b AS (SELECT n_nationkey, s_name AS name, s_suppkey::VARCHAR AS page_id FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_suppkey % 3 <> 0) SELECT * FROM b""")
def brand_pages(spark, sf_dir):
    """Search answers as (brand, name, page): results that lack either are dropped."""
    page = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey").cast("string"))
    found = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.to_json(F.struct(F.array(F.struct(F.col("s_name").alias("name"), page.alias("page_id"))).alias("searchResults"))).alias("body"))
    return ads.brand_pages(found, "n_nationkey", "body")


@query("""SELECT user_id AS key, count(*) FILTER (WHERE 1706572800 - floor(epoch(ts)) <= 3600) AS in_hour, count(*) FILTER (WHERE 1706572800 - floor(epoch(ts)) <= 86400) AS in_day FROM events GROUP BY 1""")
def recent_calls(spark, sf_dir):
    """The window counts of each key at one moment."""
    calls = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("seconds").cast("double").alias("seconds"))
    return state.recent(calls, 1_706_572_800.0)


@query("""WITH c AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s FROM events), w AS (SELECT user_id, s, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM c)
SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE n >= 800) AS warned FROM w GROUP BY 1""")
def soft_warnings(spark, sf_dir):
    """How many calls of each key came to the soft limit of an hour."""
    out = limits.admissions(_events(spark, sf_dir), "user_id", "seconds", "event_id", 1000, 1_000_000)
    return out.groupBy("user_id").agg(F.count("*").alias("calls"), F.count(F.when(F.col("warned"), 1)).alias("warned"))


@query("""WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s FROM events),
f AS (SELECT user_id, list_reduce(list([{'id': event_id, 's': s, 'r': ''}] ORDER BY s, event_id), lambda a, x: a || [{'id': x[1].id, 's': x[1].s, 'r':
  CASE WHEN len(list_filter(a, lambda y: y.r = '' AND x[1].s - y.s <= 3600)) >= 3 THEN 'hour' WHEN len(list_filter(a, lambda y: y.r = '' AND x[1].s - y.s <= 86400)) >= 4 THEN 'day' ELSE '' END}]) AS folded FROM e GROUP BY 1),
u AS (SELECT user_id, unnest(folded) AS x FROM f)
SELECT user_id, x.id AS event_id, x.r = '' AS admitted, CASE WHEN x.r <> '' THEN x.r END AS reason FROM u""")
def versioned_admission(spark, sf_dir):
    """Calls decided in three batches by time, each on the versioned state that the one before left."""
    calls = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("call"), "seconds")
    span = calls.agg(F.min("seconds").alias("a"), F.max("seconds").alias("b")).first()
    path = f"{shared_dir(spark)}/tesserae-guard-{uuid.uuid4().hex}"
    third = (F.col("seconds") - span["a"]) * 3 / F.lit(max(1, span["b"] + 1 - span["a"]))
    parts = [versions.decide(spark, path, calls.where(F.floor(third) == i), 3, 4) for i in range(3)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select(F.col("key").alias("user_id"), F.col("call").alias("event_id"), "admitted", "reason")


_REVIEWED = "translate(text, '<>&', '   ')"
_ASKED = f"CASE doc_id % 4 WHEN 0 THEN substring({_REVIEWED}, 11, 40) WHEN 1 THEN 'Free returns for' WHEN 2 THEN substring({_REVIEWED}, 1, 30) ELSE '' END"


@query(f"""WITH c AS (SELECT doc_id, doc_id % 5 = 0 AS extra, {_NORMAL("'Free returns for ' || source || ' ' || " + _REVIEWED)} AS page, {_NORMAL(_REVIEWED)} AS reviews, {_NORMAL(_ASKED)} AS asked, {_ASKED} AS raw FROM documents),
q AS (SELECT doc_id, NOT extra AND trim(raw) <> '' AND asked <> '' AND contains(reviews, asked) AS ok FROM c UNION ALL SELECT doc_id, false FROM c, range(3)), f AS (SELECT doc_id, contains(page, 'Free returns for') AS ok FROM c)
SELECT doc_id AS capture_id, 'quotes' AS kind, count(*) FILTER (WHERE ok) AS minted, count(*) FILTER (WHERE NOT ok) AS rejected FROM q GROUP BY 1
UNION ALL SELECT doc_id, 'findings', count(*) FILTER (WHERE ok), count(*) FILTER (WHERE NOT ok) FROM f GROUP BY 1""")
def collect_counts(spark, sf_dir):
    """Captures and extraction answers: what was minted and what was rejected of each. One quote is a number, one has a number for a theme."""
    docs = table(spark, sf_dir, "documents")
    captures = docs.select(F.col("doc_id").alias("capture_id"), F.concat(F.lit("<p>Free returns for "), "source", F.lit("</p><div class='jdgm-rev'>"), F.expr(_REVIEWED), F.lit("</div>")).alias("html"))
    answer = f"""concat('{{"quotes":[', to_json(named_struct('quote', {_ASKED}, 'type', 'desire', 'theme', 'fit', 'product_area', '', 'confidence', 'high', 'x', CASE WHEN doc_id % 5 = 0 THEN 1 END)),
        ',', to_json(named_struct('quote', 'Free', 'type', 'no such', 'theme', '', 'product_area', '', 'confidence', 'high')), ',7,', to_json(named_struct('quote', {_ASKED}, 'type', 'desire', 'theme', doc_id, 'product_area', '', 'confidence', 'high')), '],"findings":[',
        to_json(named_struct('fact_type', 'policy', 'statement', 's', 'detail', '', 'evidence', 'Free returns for', 'confidence', 'low')), ']}}')"""
    return flows.collect_flow(captures, docs.select(F.col("doc_id").alias("capture_id"), F.expr(answer).alias("response")))[2]


@query(f"""WITH e AS (SELECT doc_id AS evidence_id, CASE WHEN doc_id % 3 = 0 THEN 'finding' WHEN doc_id % 17 = 1 THEN 'other' ELSE 'voc' END AS evidence_kind, lang, {_NORMAL("text")} AS body, {_NORMAL("'page of ' || source")} AS page, source, quality,
  CASE doc_id % 5 WHEN 0 THEN 'not there at all' WHEN 1 THEN '' ELSE substring(text, 1, 20) END AS quote FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(evidence_id::VARCHAR), evidence_id) AS sample_rank FROM e QUALIFY sample_rank <= 60),
r AS (SELECT *, CASE WHEN evidence_id % 11 = 0 THEN 'integrity_failed' WHEN evidence_kind = 'other' OR evidence_id % 13 = 0 THEN 'abstained'
  WHEN evidence_kind = 'voc' THEN CASE WHEN NOT ({_NORMAL("quote")} <> '' AND contains(body, {_NORMAL("quote")})) THEN 'unsupported' END
  WHEN evidence_id % 2 = 0 THEN CASE WHEN evidence_id % 4 <> 0 THEN 'unsupported' END WHEN evidence_id % 5 = 0 THEN 'abstained' END AS early FROM s)
SELECT lang, evidence_kind, evidence_id, sample_rank, coalesce(early, CASE WHEN quality = 1 THEN 'supported' WHEN quality = 0 THEN 'unsupported' ELSE 'abstained' END) AS result FROM r""")
def verify_members(spark, sf_dir):
    """Frozen samples of evidence, each kind checked against its own text, with labels for the rest."""
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "finding").when(F.col("doc_id") % 17 == 1, "other").otherwise("voc")
    evidence = docs.select(F.col("doc_id").alias("evidence_id"), F.col("doc_id").alias("capture_id"), kind.alias("evidence_kind"), "lang")
    members = pick.hashed_sample(evidence, "lang", "evidence_id", 60)
    sha = F.sha2("text", 256)
    captures = docs.select(F.col("doc_id").alias("capture_id"), F.col("doc_id").cast("string").alias("path"), sha.alias("content_sha256"))
    objects = docs.where("doc_id % 11 <> 0").select(F.col("doc_id").cast("string").alias("path"), sha.alias("sha256"))
    checked = verify.integrity(members, captures, objects)
    pages = docs.select(F.col("doc_id").alias("capture_id"), F.concat(F.lit("page of "), "source").alias("page"), F.col("text").alias("reviews"))
    there = docs.where("doc_id % 13 <> 0").withColumnRenamed("doc_id", "evidence_id")
    quote = F.when(F.col("evidence_id") % 5 == 0, "not there at all").when(F.col("evidence_id") % 5 == 1, "").otherwise(F.substring("text", 1, 20))
    quotes = there.select("evidence_id", quote.alias("quote"))
    proof = F.when(F.col("evidence_id") % 4 == 0, "page of").when(F.col("evidence_id") % 2 == 0, "page on").otherwise(" ")
    findings = there.select("evidence_id", proof.alias("evidence"), F.when(F.col("evidence_id") % 5 != 0, "of").otherwise("nowhere").alias("detail"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("evidence_id"), F.when(F.col("quality") == 1, "supported").otherwise("unsupported").alias("verdict"))
    labels = labels.withColumn("evidence_kind", F.explode(F.array(F.lit("voc"), F.lit("finding"))))
    return verify.outcomes_by_kind(checked, pages, quotes, findings, labels).select("lang", "evidence_kind", "evidence_id", F.col("sample_rank").cast("long"), "result")


def _odd(n: int) -> str:
    """A JSON value that depends on the document: seldom what it should be, mostly its source as text."""
    return f"""CASE doc_id % {n} WHEN 0 THEN '5' WHEN 1 THEN '["x"]' WHEN 2 THEN '{{"x":1}}' WHEN 3 THEN 'true' WHEN 4 THEN 'null' WHEN 5 THEN '"  "' ELSE '"' || source || '"' END"""


_ANSWERS = {
    "label": f"""'{{"verdict":' || CASE doc_id % 8 WHEN 0 THEN '"maybe"' WHEN 1 THEN '7' ELSE '"supported"' END || ',"rationale":' || {_odd(13)} || CASE doc_id % 10 WHEN 0 THEN ',"x":1' ELSE '' END || '}}'""",
    "synthesis": f"""'{{"title":' || {_odd(29)} || ',"pains":' || CASE doc_id % 9 WHEN 0 THEN '[]' WHEN 1 THEN '"none"' WHEN 2 THEN '{{}}' ELSE '[{{"theme":' || {_odd(31)} || ',"summary":' || {_odd(37)} || ',"evidence_refs":[{{"kind":"voc","id":"1"}},{{"kind":"voc","id":' || {_odd(41)} || '}}]}}]' END || '}}'""",
    "whitespace": f"""'{{"candidates":[{{"angle_key":"k","summary":"s"}},{{"angle_key":' || {_odd(17)} || ',"summary":' || {_odd(19)} || '}}]}}'""",
    "usage": """'{"input_tokens":' || CASE doc_id % 7 WHEN 0 THEN '-1' WHEN 1 THEN 'true' WHEN 2 THEN '12.5' WHEN 3 THEN '"12"' ELSE n_chars::VARCHAR END || ',"output_tokens":' || CASE doc_id % 5 WHEN 0 THEN '2000' WHEN 1 THEN '3.0' ELSE '12' END || '}'""",
}
_FILLED = lambda j, path: f"(json_type({j}, '{path}') = 'VARCHAR' AND trim({j} ->> '{path}') <> '')"


@query(f"""WITH a AS (SELECT doc_id, {", ".join(f"({sql})::JSON AS {name}" for name, sql in _ANSWERS.items())} FROM documents)
SELECT doc_id, coalesce(len(json_keys(label)) = 2 AND json_type(label, '$.verdict') = 'VARCHAR' AND label ->> '$.verdict' IN ('supported', 'unsupported', 'ambiguous') AND {_FILLED("label", "$.rationale")}, false) AS label,
coalesce({_FILLED("synthesis", "$.title")} AND json_type(synthesis, '$.pains') = 'ARRAY' AND (json_array_length(synthesis, '$.pains') = 0 OR ({_FILLED("synthesis", "$.pains[0].theme")} AND {_FILLED("synthesis", "$.pains[0].summary")} AND {_FILLED("synthesis", "$.pains[0].evidence_refs[1].id")})), false) AS synthesis,
coalesce({_FILLED("whitespace", "$.candidates[1].angle_key")} AND {_FILLED("whitespace", "$.candidates[1].summary")}, false) AS whitespace,
coalesce(json_type(usage, '$.input_tokens') IN ('UBIGINT', 'BIGINT') AND json_type(usage, '$.output_tokens') IN ('UBIGINT', 'BIGINT') AND try_cast(usage ->> '$.input_tokens' AS DOUBLE) BETWEEN 0 AND 20000 AND try_cast(usage ->> '$.output_tokens' AS DOUBLE) BETWEEN 0 AND 1024, false) AS usage FROM a""")
def answer_shapes(spark, sf_dir):
    """Which answers of each document are well-formed: numbers, lists, objects, booleans, nulls and blanks take the place of text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *[F.expr(sql.replace("n_chars::VARCHAR", "string(n_chars)")).alias(name) for name, sql in _ANSWERS.items()])
    return docs.select("doc_id", shapes.is_label(F.col("label")).alias("label"), shapes.is_synthesis(F.col("synthesis")).alias("synthesis"), shapes.is_whitespace(F.col("whitespace")).alias("whitespace"), shapes.is_usage(F.col("usage"), 20_000, 1024).alias("usage"))


_BRANDS = "(SELECT DISTINCT p_brand AS angle_key FROM part)"


@query(f"""WITH h AS (SELECT n_nationkey AS batch_id, n_nationkey % 3 AS coverage_gap, n_nationkey % 9 AS with_observations FROM nation),
g AS (SELECT s_nationkey AS batch_id, p_brand AS angle_key, count(*) AS total_count, count(DISTINCT p_type) AS competitor_count FROM part JOIN supplier ON p_partkey % 100 = s_suppkey % 100 WHERE p_size > 10 GROUP BY 1, 2),
c AS (SELECT batch_id, angle_key FROM h, {_BRANDS} WHERE batch_id % 4 <> 3 AND batch_id % 8 <> 6 AND NOT (batch_id % 4 = 1 AND angle_key LIKE '%1'))
SELECT batch_id, angle_key, coalesce(competitor_count, 0) AS competitor_count, coalesce(total_count, 0) AS total_count, total_count IS NOT NULL AS has_rollup_row,
CASE WHEN coverage_gap = 0 AND with_observations >= 6 THEN 'high' WHEN with_observations >= 3 THEN 'medium' ELSE 'low' END AS confidence, coverage_gap > 0 OR with_observations < 3 AS thin_data
FROM c JOIN h USING (batch_id) LEFT JOIN g USING (batch_id, angle_key)""")
def whitespace_drafts(spark, sf_dir):
    """Whitespace answers to drafts: well-formed, of the registry, without numbers of their own, with the batch's counts."""
    return _whitespace(spark, sf_dir)[0].select("batch_id", "angle_key", "competitor_count", "total_count", "has_rollup_row", "confidence", "thin_data")


@query(f"""WITH g AS (SELECT DISTINCT s_nationkey AS batch_id, p_brand AS angle_key FROM part JOIN supplier ON p_partkey % 100 = s_suppkey % 100 WHERE p_size > 10),
d AS (SELECT n_nationkey AS batch_id FROM nation WHERE n_nationkey % 4 <> 3 AND n_nationkey % 8 <> 6 AND EXISTS (SELECT 1 FROM {_BRANDS} WHERE NOT (n_nationkey % 4 = 1 AND angle_key LIKE '%1')))
SELECT batch_id, 'batch' AS kind, batch_id::VARCHAR AS id FROM d UNION ALL SELECT batch_id, 'row', batch_id || '/' || angle_key FROM g SEMI JOIN d USING (batch_id)""")
def whitespace_refs(spark, sf_dir):
    """The references of each whitespace draft's batch: its header and all of its rows."""
    return _whitespace(spark, sf_dir)[1]


def _whitespace(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    header = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("batch_id"), (F.col("n_nationkey") % 3).alias("coverage_gap"), (F.col("n_nationkey") % 9).alias("with_observations"))
    # both sides are counted by remainder before they meet, so no pair of a part and a supplier is a row
    parts = part.where("p_size > 10").groupBy((F.col("p_partkey") % 100).alias("_at"), F.col("p_brand").alias("angle_key"), "p_type").agg(F.count("*").alias("_parts"))
    suppliers = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 100).alias("_at"), F.col("s_nationkey").alias("batch_id")).agg(F.count("*").alias("_suppliers"))
    types = parts.join(suppliers, "_at").groupBy("batch_id", "angle_key", "p_type").agg(F.sum(F.col("_parts") * F.col("_suppliers")).alias("_n"))
    rollup = types.groupBy("batch_id", "angle_key").agg(F.sum("_n").alias("total_count"), F.count("p_type").alias("competitor_count"))
    rollup = rollup.withColumn("id", F.concat_ws("/", F.col("batch_id").cast("string"), "angle_key"))
    brands = part.select(F.col("p_brand").alias("angle_key")).distinct()
    registry = brands.select("angle_key", F.lit("L").alias("label"), F.lit("").alias("definition"), F.lit("active").alias("status"))
    fallback = spark.createDataFrame([("unmapped", "Unmapped", "")], "angle_key string, label string, definition string")
    # every brand is a candidate of every batch; some say a number, some are said twice, some answers have a key too many or numbers where text is due
    listed = brands.agg(F.sort_array(F.collect_list("angle_key")).alias("keys"))  # the registry's keys
    summary = lambda k: F.when((F.col("n_nationkey") % 4 == 1) & F.endswith(k, F.lit("1")), F.lit("three do this")).otherwise(F.lit("few do this"))
    candidates = F.transform("keys", lambda k: F.struct(k.alias("angle_key"), summary(k).alias("summary")))
    again = F.concat(candidates, F.transform(F.slice("keys", 1, 2), lambda k: F.struct(k.alias("angle_key"), summary(k).alias("summary"))), F.array(F.struct(F.lit("unmapped").alias("angle_key"), F.lit("x").alias("summary"))))
    answer = F.when(F.col("n_nationkey") % 4 == 3, F.to_json(F.struct(again.alias("candidates"), F.lit("t").alias("title")))).when(F.col("n_nationkey") % 8 == 6, F.to_json(F.struct(F.transform(again, lambda c: F.struct(c["angle_key"].alias("angle_key"), F.lit(5).alias("summary"))).alias("candidates")))).otherwise(F.to_json(F.struct(again.alias("candidates"))))
    answers = table(spark, sf_dir, "nation").join(F.broadcast(listed), F.lit(True)).select(F.col("n_nationkey").alias("batch_id"), answer.alias("response"))
    return flows.whitespace_flow(registry, fallback, header, rollup, answers)


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS variants, max(p_size) AS days, count(*) FILTER (WHERE p_retailprice > 1500) AS recent FROM part GROUP BY 1, 2), m AS (SELECT *, days / (SELECT max(days) FROM c)::DOUBLE AS longevity FROM c)
SELECT p_brand, p_type, variants, recent, round(longevity, 6) AS longevity, CASE WHEN variants >= 3 AND (longevity >= 0.5 OR recent >= 2) THEN 'high' WHEN variants >= 2 THEN 'medium' ELSE 'low' END AS confidence
FROM m ORDER BY variants DESC, recent DESC, longevity DESC, p_brand, p_type LIMIT 20""")
def likely_winning(spark, sf_dir):
    """Concepts by how often they are varied, how fresh the variants are, and how long they run."""
    rows = table(spark, sf_dir, "part").withColumn("recent", F.col("p_retailprice") > 1500)
    return census.winning_concepts(rows, ["p_brand", "p_type"], "p_size", "recent", 20).withColumn("longevity", F.round("longevity", 6))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 30 WHEN event_id % 3 = 1 THEN event_id ELSE 7 END AS cap, CASE event_id % 2 WHEN 0 THEN 'd' ELSE 'given' END AS name FROM events""")
def defaults(spark, sf_dir):
    """Defaults for what is null, zero or empty."""
    k = F.col("event_id")
    given = F.when(k % 3 == 0, F.when(k % 2 == 0, 0)).when(k % 3 == 1, F.when(k != 0, k)).otherwise(7)
    return table(spark, sf_dir, "events").select("event_id", rules.or_default(given, F.lit(30)).cast("long").alias("cap"), rules.or_default(F.when(k % 2 == 0, "").otherwise("given"), F.lit("d")).alias("name"))


@query("""SELECT doc_id, text AS utf8, coalesce(text, '') <> '' AS some FROM documents""")
def decoded_pages(spark, sf_dir):
    """Bytes back to text: the declared charset where it is known, else UTF-8."""
    ship(spark)  # which bounds the batches
    charset = F.when(F.col("doc_id") % 2 == 0, "utf-8").when(F.col("doc_id") % 3 == 0, "no-such-charset")
    read = html.decoded(F.col("text").cast("binary"), charset)
    return table(spark, sf_dir, "documents").select("doc_id", read.alias("utf8")).withColumn("some", F.coalesce("utf8", F.lit("")) != "")


@query("""SELECT doc_id, greatest(TIMESTAMP '2024-01-10', max(ts)) AS last_accessed FROM documents JOIN events ON doc_id = user_id WHERE n_chars > 500 GROUP BY 1""")
def cache_reads(spark, sf_dir):
    """Reads of the cache: rows whose file is gone are dropped, the others move up."""
    media = table(spark, sf_dir, "documents").where("n_chars > 500").select("doc_id", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz").alias("last_accessed"))
    reads = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "ts")
    return cache.touched(pick.present(media, reads, ["doc_id"]), reads, "doc_id", "ts")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'own' END AS kind, user_id::VARCHAR AS who, CASE WHEN event_id % 2 = 1 THEN 3 ELSE 2 END AS n FROM events""")
def merged_settings(spark, sf_dir):
    """Defaults under settings of one's own."""
    base = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("who"), F.col("user_id").cast("string"))
    own = F.when(F.col("event_id") % 2 == 1, F.create_map(F.lit("kind"), F.lit("own"), F.lit("more"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    m = rules.merged(base, own)
    return table(spark, sf_dir, "events").select("event_id", m["kind"].alias("kind"), m["who"].alias("who"), F.size(m).alias("n"))
