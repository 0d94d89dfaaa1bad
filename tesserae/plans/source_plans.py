"""Queries over nested and paged inputs, JSON, arrays and positions."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions.rules import first_given, local_iso, moment
from tesserae.operators import pick, snapshots
from tesserae.plans.registry import query
from tesserae.session import shared_dir
from tesserae.sources import ads, cursor, table


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events WHERE (props ->> '$.k')::BIGINT BETWEEN 10 AND 20 AND len(json_keys(props)) = 1")
def json_params_filter(spark, sf_dir):
    """A path of a JSON column, and its exact set of keys."""
    keys = F.array_sort(F.json_object_keys("props")) == F.array(F.lit("k"))
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").where(keys & k.between(10, 20)).select("event_id", k.alias("k"))


@query("""SELECT vec_id, i - 1 AS pos, a::DOUBLE AS a, b::DOUBLE AS b FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS a, unnest(list_resize(embedding[2:], len(embedding))) AS b FROM embeddings) WHERE b IS NOT NULL""")
def array_explode_zip(spark, sf_dir):
    """Two lists matched by position, up to the shorter one: each component and the one after it."""
    zipped = F.posexplode(F.arrays_zip(F.col("embedding").alias("a"), F.slice("embedding", F.lit(2), F.size("embedding")).alias("b"))).alias("pos", "z")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", zipped).where("z.b IS NOT NULL")
    return rows.select("vec_id", F.col("pos").cast("long"), F.col("z.a").cast("double").alias("a"), F.col("z.b").cast("double").alias("b"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, l_linestatus FROM lineitem),
f AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'IMAGE' WHEN 'N' THEN 'DCO' WHEN 'R' THEN 'VIDEO' END AS media_type FROM l),
c AS (SELECT *, 0 AS card, 'm' || l_partkey AS media_url, 'body ' || l_suppkey AS body FROM f WHERE l_linestatus = 'F' OR media_type = 'DCO'
  UNION ALL SELECT *, 1, 'm' || (l_partkey + 1), 'card ' || l_suppkey FROM f WHERE media_type = 'DCO' AND l_linestatus = 'F')
SELECT l_orderkey || '-' || l_linenumber AS ad_id, l_partkey, media_type, card::BIGINT AS card, media_url, body, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS started FROM c""")
def nested_ads(spark, sf_dir):
    """Nested ads flattened to pairs of medium and body."""
    lines = table(spark, sf_dir, "lineitem")
    form = "CASE l_returnflag WHEN 'A' THEN 'IMAGE' WHEN 'N' THEN 'DCO' WHEN 'R' THEN 'VIDEO' END"
    body = "CASE WHEN l_linestatus = 'F' THEN concat('body ', l_suppkey) ELSE '' END"
    m, m2 = "concat('m', l_partkey)", "concat('m', l_partkey + 1)"
    raw = f"""to_json(named_struct('ad_archive_id', concat(l_orderkey, '-', l_linenumber), 'start_date', double(unix_seconds(timestamp(l_shipdate))), 'snapshot', named_struct('display_format', {form}, 'body', named_struct('text', {body}),
        'images', array(named_struct('resized_image_url', {m})), 'videos', array(named_struct('video_sd_url', {m})),
        'cards', array(named_struct('resized_image_url', {m}, 'body', concat('body ', l_suppkey)), named_struct('resized_image_url', {m2}, 'body', CASE WHEN l_linestatus = 'F' THEN concat('card ', l_suppkey) END)))))"""
    parsed = lines.select("l_partkey", F.from_json(F.expr(raw), ads.AD).alias("ad"))
    flat = ads.flat_ads(parsed, "ad", ["l_partkey"])
    return flat.select("ad_id", "l_partkey", "media_type", F.col("card").cast("long"), "media_url", "body", local_iso(F.col("start_date")).alias("started"))


_PAGED = """WITH p AS (SELECT o_custkey, o_orderkey, count(*) OVER w - 1 AS page_no, count(*) FILTER (WHERE o_orderstatus = 'P') OVER w AS failures,
  min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS first_failed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, coalesce(bool_or(o_orderkey = first_failed AND page_no < 10) OVER (PARTITION BY o_custkey), false) AS is_partial FROM p)
SELECT o_custkey, page_no, i AS pos, o_orderkey * 10 + i AS ad, is_partial FROM f, (VALUES (0::BIGINT), (1::BIGINT), (2::BIGINT)) AS t (i) WHERE failures = 0 AND page_no < 10 AND page_no * 3 + i < {limit}"""


def _pages(spark, sf_dir):
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf_dir, "orders").select("o_custkey", number.cast("long").alias("page_no"), F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.col("o_orderkey") * 10 + i).alias("ads"), (F.col("o_orderstatus") == "P").alias("failed"))


@query(_PAGED.format(limit=7))
def paged_ad_scan(spark, sf_dir):
    """Leading pages up to a failure, a limit for each key."""
    out = ads.paged_scan(_pages(spark, sf_dir), "o_custkey", "page_no", "ads", "failed", 7)
    return out.select("o_custkey", "page_no", F.col("pos").cast("long"), "ad", "is_partial")


@query(_PAGED.format(limit=30))
def cursor_scan(spark, sf_dir):
    """The same over stored responses, written by key and followed by their cursors in the source; thirty ads are all that ten responses have."""
    pages = _pages(spark, sf_dir)
    last = F.col("page_no") == F.max("page_no").over(Window.partitionBy("o_custkey"))
    at = lambda n: F.when(n > 0, F.concat(F.lit("p"), n.cast("string")))
    responses = pages.select(F.col("o_custkey").cast("string").alias("key"), F.lit("US").alias("country"), at(F.col("page_no")).alias("cursor"), F.when(~last, at(F.col("page_no") + 1)).alias("next"), F.when(F.col("failed"), 500).otherwise(200).cast("long").alias("status"), F.col("ads").cast("array<string>").alias("ads"), F.col("page_no").alias("at"))
    path = f"{shared_dir(spark)}/tesserae-responses-{uuid.uuid4().hex}"
    cursor.store_responses(responses, path, "at")
    out = spark.read.format("stored_ads").option("limit", 30).load(path)
    return out.select(F.col("key").cast("long").alias("o_custkey"), "page_no", "pos", F.col("ad").cast("long").alias("ad"), "is_partial")


@query("""SELECT n_nationkey, count(s_suppkey) AS pages, count(s_suppkey) > 0 AS success, max(s_name) AS last_page FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON n_nationkey = s_nationkey GROUP BY 1""")
def brand_batch(spark, sf_dir):
    """Every asked brand with a map of its pages, empty where there is none."""
    found = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("page_id"))
    out = ads.brand_batch(table(spark, sf_dir, "nation"), found, "n_nationkey")
    n = F.size("pages").cast("long")
    return out.select("n_nationkey", n.alias("pages"), (n > 0).alias("success"), F.array_max(F.map_keys("pages")).alias("last_page"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 1, 2, 5) THEN epoch(o_orderdate)::BIGINT WHEN o_orderkey % 8 = 4 THEN 86400 WHEN o_orderkey % 8 = 6 THEN epoch(o_orderdate)::BIGINT - 19800 END AS seconds,
epoch(o_orderdate)::BIGINT AS from_number FROM orders""")
def polymorphic_dates(spark, sf_dir):
    """Dates as epoch seconds, ISO text with and without a zone, or nonsense, the first field that is given; and as a number."""
    day = "date_format(o_orderdate, 'yyyy-MM-dd')"
    v = f"""CASE o_orderkey % 8 WHEN 0 THEN string(unix_seconds(timestamp(o_orderdate))) WHEN 1 THEN date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'Z'") WHEN 2 THEN {day} WHEN 3 THEN 'soon'
        WHEN 5 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm') WHEN 6 THEN date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'+0530'") WHEN 7 THEN IF(o_orderkey % 16 = 7, substring({day}, 1, 7), '12.5') ELSE '' END"""
    number = moment(F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(moment(first_given(F.expr(v), F.lit("86400")))).alias("seconds"), F.unix_seconds(number).alias("from_number"))


_AD = ("ad_id", "body", "cents", "ends", "starts")
_AD_TEXT = " || ".join(f"'{c}=' || coalesce(length({c}::VARCHAR) || ':' || {c}, '-') || ';'" for c in _AD)
_SNAPSHOTS = f"""ads AS (SELECT o_custkey, 'ad-' || o_orderkey AS ad_id, o_orderpriority AS body, round(o_totalprice * 100)::BIGINT AS cents, strftime(o_orderdate, '%Y-%m-%d') AS starts, CASE o_orderstatus WHEN 'F' THEN 'over' END AS ends FROM orders),
h AS (SELECT *, sha256({_AD_TEXT}) AS h FROM ads)"""
_HEADERS = lambda name, where: f"""{name} AS (SELECT o_custkey, count(*) AS ad_count, sha256(o_custkey || ':' || count(*) || ':' || sum(('0x' || h[1:15])::BIGINT) || ':' || sum(('0x' || h[16:30])::BIGINT)) AS snapshot_id FROM h WHERE {where} GROUP BY 1)"""


def _ads(spark, sf_dir):
    ended = F.when(F.col("o_orderstatus") == "F", "over")
    return table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("ad-"), "o_orderkey").alias("ad_id"), F.col("o_orderpriority").alias("body"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("starts"), ended.alias("ends"))


def _taken(ads, at):
    return snapshots.taken(ads, "o_custkey", F.lit(at), list(_AD))


@query(f"""WITH {_SNAPSHOTS}, {_HEADERS("old", "ends = 'over'")}, {_HEADERS("new", "true")}
SELECT n.o_custkey, n.snapshot_id, n.ad_count, 2 AS taken_at, CASE WHEN n.snapshot_id IN (SELECT snapshot_id FROM old) THEN 0 ELSE n.ad_count END AS rows_added FROM new n""")
def snapshot_append(spark, sf_dir):
    """What a second pull of each entity's ads appends: always a header, and rows where the ads are not those of the first pull."""
    ads = _ads(spark, sf_dir)
    headers, rows = snapshots.appended(*_taken(ads.where("ends = 'over'"), 1), *_taken(ads, 2))
    added = rows.groupBy("snapshot_id").agg(F.count("*").alias("rows_added"))
    return headers.join(added, "snapshot_id", "left").select("o_custkey", "snapshot_id", "ad_count", "taken_at", F.coalesce("rows_added", F.lit(0)).alias("rows_added"))


@query(f"""WITH {_SNAPSHOTS}, {_HEADERS("old", "ends = 'over'")},
c AS (SELECT o_custkey, 'ad-' || (o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS ad_id FROM orders)
SELECT o_custkey, snapshot_id, count(*) AS cited, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM ads a WHERE a.o_custkey = c.o_custkey AND a.ad_id = c.ad_id AND a.ends = 'over')) AS known FROM c JOIN old USING (o_custkey) GROUP BY 1, 2""")
def snapshot_provenance(spark, sf_dir):
    """How many of the ads that each entity's analysis cites are in the snapshot that it is of."""
    headers, rows = _taken(_ads(spark, sf_dir).where("ends = 'over'"), 1)
    shifted = F.col("o_orderkey") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)
    citations = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("ad-"), shifted).alias("ad_id")).join(headers.select("o_custkey", "snapshot_id"), "o_custkey")
    checked = snapshots.cited_in(citations, rows, "ad_id")
    return checked.groupBy("o_custkey", "snapshot_id").agg(F.count("*").alias("cited"), F.count(F.when(F.col("known"), 1)).alias("known"))


@query("""WITH a AS (SELECT o_custkey, o_orderpriority AS angle_key, min(o_orderkey) AS example, list(o_orderkey ORDER BY o_orderkey) AS refs, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, angle_key, example, n, len(list_filter(refs, lambda r: r % 2 = 0)) AS known_refs FROM a""")
def angle_observations(spark, sf_dir):
    """Per-ad rows grouped by angle, their references checked against the snapshot."""
    orders = table(spark, sf_dir, "orders")
    per_ad = orders.select("o_custkey", F.col("o_orderpriority").alias("angle_key"), "o_orderkey")
    snapshot = orders.where("o_orderkey % 2 = 0").select("o_custkey", "o_orderkey", F.lit(1).alias("known"))
    checked = per_ad.join(snapshot, ["o_custkey", "o_orderkey"], "left")
    return checked.groupBy("o_custkey", "angle_key").agg(F.min("o_orderkey").alias("example"), F.count("*").alias("n"), F.count("known").alias("known_refs"))
