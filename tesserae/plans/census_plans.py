"""Queries over picks, samples, rollups and censuses."""

from pyspark.sql import functions as F

from tesserae.functions.rules import confidence, coverage_confidence, coverage_is_thin, whole_days
from tesserae.operators import census, pick, resolve, rollups
from tesserae.plans.registry import query
from tesserae.session import materialise
from tesserae.sources import table

NOW = "2000-06-01 00:00:00"


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def dedup_keep_first(spark, sf_dir):
    """Keep-first by key in order of arrival."""
    return pick.first_by(table(spark, sf_dir, "events"), ["user_id"], [F.col("event_id")]).select("event_id", "user_id", "event_type", "value")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_ok_per_entity(spark, sf_dir):
    """The latest ok row of each entity."""
    orders = table(spark, sf_dir, "orders")
    return pick.latest_by(orders, ["o_custkey"], "o_orderdate", "o_orderkey", F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, ts DESC, event_id DESC) = 1")
def pinned_identity(spark, sf_dir):
    """The pinned row of each key, else the newest."""
    return pick.pinned(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") == "purchase", "ts", "event_id").select("user_id", "event_id", "event_type")


_ADS = f"""
ads AS (SELECT l_orderkey * 10 + l_linenumber AS ad_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate AS started, l_shipdate AS ended,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE greatest(0, floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0))::BIGINT END AS days,
  l_shipdate >= TIMESTAMP '{NOW}' AS active FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
keyed AS (SELECT ad_id * 1000000 + l_partkey AS pos, * FROM ads)
"""


def _ads(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    days = whole_days(F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp"))
    ads = joined.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ad_id"), "l_partkey", F.when(F.col("l_linenumber") != 7, days).alias("days"), (F.col("l_shipdate") >= F.lit(NOW).cast("timestamp_ntz")).alias("active"))
    return ads.withColumn("pos", F.col("ad_id") * 1_000_000 + F.col("l_partkey"))


@query(f"""WITH {_ADS}, rows_ AS (SELECT * FROM keyed WHERE active OR NOT EXISTS (SELECT 1 FROM keyed WHERE active)),
parts AS (SELECT 0 AS part, * FROM (SELECT * FROM rows_ ORDER BY days ASC NULLS LAST, pos LIMIT 15)
  UNION ALL SELECT 1, * FROM (SELECT * FROM rows_ ORDER BY days DESC NULLS LAST, pos DESC LIMIT 15))
SELECT ad_id, days, pos FROM parts QUALIFY row_number() OVER (PARTITION BY ad_id ORDER BY part, pos) = 1""")
def stratified_sample(spark, sf_dir):
    """The freshest and the longest-running active rows."""
    return pick.stratified_sample(_ads(spark, sf_dir), "ad_id", "pos", "days", "active", 30).select("ad_id", "days", "pos")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0))::BIGINT AS days,
l_shipdate >= TIMESTAMP '2000-06-01' AS active FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def days_active(spark, sf_dir):
    """Whole days from start to end, and whether the end is ahead of now."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    days = whole_days(F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", days.alias("days"), (F.col("l_shipdate") >= F.lit(NOW).cast("timestamp_ntz")).alias("active"))


_PROBES = """CASE s_suppkey % 6 WHEN 0 THEN s_name WHEN 1 THEN upper(s_name) WHEN 2 THEN replace(s_name, '#', ' & ')
WHEN 3 THEN replace(left(s_name, length(s_name) - 1), '#', ' ') WHEN 4 THEN left(s_name, 15) || '.' ELSE '?' || s_suppkey END"""


@query(f"""WITH p AS (SELECT DISTINCT {_PROBES} AS brand FROM supplier),
m AS (SELECT brand, s_name, s_suppkey, CASE WHEN s_name = brand THEN 1 WHEN lower(s_name) = lower(brand) THEN 2
  WHEN regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(brand), '[^a-z0-9]', '', 'g') THEN 3 ELSE 4 END AS step
  FROM p JOIN supplier ON regexp_replace(lower(brand), '[^a-z0-9]', '', 'g') <> ''
  AND starts_with(regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(brand), '[^a-z0-9]', '', 'g'))),
b AS (SELECT *, count(*) OVER (PARTITION BY brand) AS n FROM m QUALIFY row_number() OVER (PARTITION BY brand ORDER BY step, length(s_name), s_name, s_suppkey) = 1),
h AS (SELECT p.brand, s_suppkey, CASE WHEN step IS NULL THEN 'none' WHEN step = 1 THEN 'exact' WHEN step = 2 THEN 'case' WHEN step = 3 THEN 'normalized'
  WHEN n = 1 THEN 'prefix' ELSE 'ambiguous' END AS how FROM p LEFT JOIN b ON p.brand = b.brand)
SELECT brand, CASE WHEN how NOT IN ('none', 'ambiguous') THEN s_suppkey END AS s_suppkey, how FROM h""")
def entity_resolution(spark, sf_dir):
    """The cascade over spellings of supplier names."""
    suppliers = table(spark, sf_dir, "supplier")
    probes = suppliers.select(F.expr(_PROBES.replace("length(s_name)", "char_length(s_name)")).alias("brand"))
    return resolve.resolve(probes, suppliers, "brand", "s_name", "s_suppkey")


@query("""WITH latest AS (SELECT c_custkey, c_nationkey, c_mktsegment, o_orderpriority FROM (SELECT * FROM orders WHERE o_orderstatus = 'F'
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) JOIN customer ON o_custkey = c_custkey),
  census AS (SELECT c_nationkey, c_mktsegment, count(DISTINCT c_custkey) AS competitor_count, count(*) AS total_count,
    count(CASE WHEN o_orderpriority <= '2' THEN 1 END) AS verbatim_count, count(CASE WHEN NOT o_orderpriority <= '2' THEN 1 END) AS not_verbatim_count
    FROM latest WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
  registry AS (SELECT n_nationkey AS c_nationkey, c_mktsegment FROM nation, (SELECT DISTINCT c_mktsegment FROM customer)),
  basis AS (SELECT count(DISTINCT c_custkey) AS selected, count(DISTINCT o_custkey) AS with_observations FROM customer LEFT JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey)
SELECT c_nationkey, c_mktsegment, coalesce(competitor_count, 0) AS competitor_count, coalesce(total_count, 0) AS total_count, coalesce(verbatim_count, 0) AS verbatim_count,
  coalesce(not_verbatim_count, 0) AS not_verbatim_count, competitor_count IS NOT NULL AS has_rollup_row, selected, with_observations, selected - with_observations AS coverage_gap,
  selected - with_observations > 0 OR with_observations < 3 AS thin_data,
  CASE WHEN selected = with_observations AND with_observations >= 6 THEN 'high' WHEN with_observations >= 3 THEN 'medium' ELSE 'low' END AS confidence
FROM registry LEFT JOIN census USING (c_nationkey, c_mktsegment), basis""")
def census_with_absence(spark, sf_dir):
    """Every registry cell with its counts over the latest ok rows, zeros where there are none, and the coverage of the whole."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    latest = pick.latest_by(orders, ["o_custkey"], "o_orderdate", "o_orderkey").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    urgent = latest.where("o_orderpriority = '1-URGENT'")
    verbatim = F.col("o_orderpriority") <= "2"
    counted = urgent.groupBy("c_nationkey", "c_mktsegment").agg(F.countDistinct("c_custkey").alias("competitor_count"), F.count("*").alias("total_count"), F.count(F.when(verbatim, 1)).alias("verbatim_count"), F.count(F.when(~verbatim, 1)).alias("not_verbatim_count"))
    segments = customers.select("c_mktsegment").distinct()
    registry = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey")).join(segments, F.lit(True))  # the registry is its own small grid
    basis = census.coverage_basis(customers, orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    rows = census.with_absence(registry, counted, ["c_nationkey", "c_mktsegment"]).join(F.broadcast(basis), F.lit(True))
    gap, seen = F.col("coverage_gap"), F.col("with_observations")
    return rows.withColumn("thin_data", coverage_is_thin(gap, seen)).withColumn("confidence", coverage_confidence(gap, seen))


@query("""WITH r AS (SELECT coalesce(source, '') AS theme, coalesce(lang, '') AS quote_type, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id,
  CASE WHEN count(*) < 3 THEN 'thin' ELSE 'normal' END AS data_density, array_to_string(list(doc_id ORDER BY doc_id)[1:3], ',') AS example_ids
  FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1, 2)
SELECT *, (SELECT sum(n) FROM r)::BIGINT AS total_publishable, (SELECT sum(n) < 8 OR (count(*) > 0 AND bool_and(data_density = 'thin')) FROM r) AS thin_data FROM r""")
def theme_rollup(spark, sf_dir):
    """Counts and members by theme and type, density, and the basis of the whole."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    rollup = census.theme_rollup(rows, "source", "lang", "doc_id")
    basis = F.broadcast(census.theme_basis(rollup).select("total_publishable", "thin_data"))
    return rollup.withColumn("example_ids", F.array_join("example_ids", ",")).join(basis, F.lit(True))


@query("""WITH e AS (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0), c AS (SELECT DISTINCT source, doc_id FROM documents SEMI JOIN e USING (doc_id)),
t AS (SELECT source, count(*) AS cited FROM c GROUP BY 1), n AS (SELECT count(*) AS evidence FROM e)
SELECT source, cited, evidence, CASE WHEN evidence >= 8 AND cited >= 5 THEN 'high' WHEN evidence >= 3 AND cited >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM t, n""")
def citation_semi_join(spark, sf_dir):
    """Citations that are publishable, and the confidence that follows from their number."""
    evidence = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    kept = census.cited(table(spark, sf_dir, "documents").select("source", "doc_id").distinct(), evidence, ["doc_id"])
    counts = kept.groupBy("source").agg(F.count("*").alias("cited")).join(F.broadcast(evidence.agg(F.count("*").alias("evidence"))), F.lit(True))
    return counts.withColumn("confidence", confidence(F.col("evidence"), F.col("cited")))


@query("""WITH s AS (SELECT doc_id % 3 AS half, sha256(text) AS h, source, min(doc_id) AS doc_id FROM documents GROUP BY ALL)
SELECT doc_id, h AS content_sha256, source FROM s WHERE half <> 0 AND NOT EXISTS (SELECT 1 FROM s o WHERE o.half = 0 AND o.h = s.h AND o.source = s.source)
QUALIFY row_number() OVER (PARTITION BY h, source ORDER BY doc_id) = 1""")
def unseen_anti_join(spark, sf_dir):
    """New captures whose content is not stored for their source, the first of each: insert, on conflict do nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"), "source")
    stored, new = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")
    return pick.insert_absent(stored, new, ["content_sha256", "source"], [F.col("doc_id")]).select("doc_id", "content_sha256", "source")


@query("SELECT user_id, event_id, sample_rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY sha256(event_id::VARCHAR), event_id) AS sample_rank FROM events) WHERE sample_rank <= 5")
def sample_freeze(spark, sf_dir):
    """A fixed sample of each group in the order of a hash."""
    return pick.hashed_sample(table(spark, sf_dir, "events"), "user_id", "event_id", 5).select("user_id", "event_id", F.col("sample_rank").cast("long"))


@query("""WITH a AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1), b AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'de' AND n_chars > 2000 GROUP BY 1), s AS (SELECT DISTINCT source FROM documents)
SELECT source, CASE WHEN a.n IS NOT NULL AND b.n IS NULL THEN 'only_ours' WHEN a.n IS NULL AND b.n IS NOT NULL THEN 'only_theirs' WHEN a.n IS NULL THEN 'neither' ELSE 'both' END AS gap, coalesce(a.n, 0) AS ours, coalesce(b.n, 0) AS theirs
FROM s LEFT JOIN a USING (source) LEFT JOIN b USING (source)""")
def gap_diff(spark, sf_dir):
    """Concepts that one side has and the other has not, both ways, and what neither has."""
    docs = table(spark, sf_dir, "documents")
    side = lambda where, name: docs.where(where).groupBy("source").agg(F.count("*").alias(name))
    both = docs.select("source").distinct().join(side("lang = 'en'", "ours"), "source", "left").join(side("lang = 'de' AND n_chars > 2000", "theirs"), "source", "left")
    a, b = F.col("ours").isNotNull(), F.col("theirs").isNotNull()
    gap = F.when(a & ~b, "only_ours").when(~a & b, "only_theirs").when(~a, "neither").otherwise("both")
    return both.select("source", gap.alias("gap"), F.coalesce("ours", F.lit(0)).alias("ours"), F.coalesce("theirs", F.lit(0)).alias("theirs"))


@query("""WITH r AS (SELECT p_brand AS angle_key, CASE WHEN min(p_size) = 1 THEN 'active' ELSE 'retired' END AS status, min(p_name) AS label FROM part GROUP BY 1),
live AS (SELECT angle_key, label FROM r WHERE status = 'active' UNION ALL SELECT 'unmapped', 'Unmapped'),
c AS (SELECT p_brand AS angle_key, p_size, min(p_partkey) AS pos, count(*) AS n FROM part WHERE p_size <= 2 GROUP BY ALL),
f AS (SELECT * FROM c SEMI JOIN live USING (angle_key) WHERE angle_key <> 'unmapped' QUALIFY row_number() OVER (PARTITION BY angle_key ORDER BY pos) = 1),
u AS (SELECT p_brand AS angle_key, count(*) AS total_count FROM part WHERE p_type = 'ECONOMY' GROUP BY 1)
SELECT angle_key, label, pos, coalesce(total_count, 0) AS total_count FROM f JOIN live USING (angle_key) LEFT JOIN u USING (angle_key)""")
def whitespace_candidates(spark, sf_dir):
    """Candidate keys that the active registry has, the first of each, with the census's counts and the registry's labels."""
    part = table(spark, sf_dir, "part")
    registry = part.groupBy(F.col("p_brand").alias("angle_key")).agg(F.when(F.min("p_size") == 1, "active").otherwise("retired").alias("status"), F.min("p_name").alias("label")).withColumn("definition", F.lit(None).cast("string"))
    fallback = spark.createDataFrame([("unmapped", "Unmapped", "")], "angle_key string, label string, definition string")
    live = census.active_registry(registry, fallback).select("angle_key", "label")
    candidates = part.where("p_size <= 2").groupBy(F.col("p_brand").alias("angle_key"), "p_size").agg(F.min("p_partkey").alias("pos"))
    first = pick.first_by(pick.present(candidates.where("angle_key <> 'unmapped'"), live, ["angle_key"]), ["angle_key"], [F.col("pos")])
    rollup = part.where("p_type = 'ECONOMY'").groupBy(F.col("p_brand").alias("angle_key")).agg(F.count("*").alias("total_count"))
    return first.join(live, "angle_key").join(rollup, "angle_key", "left").select("angle_key", "label", "pos", F.coalesce("total_count", F.lit(0)).alias("total_count"))


_CHANGED = "CASE WHEN doc_id % 7 = 0 THEN 'moved' ELSE coalesce(lang, '') END"


@query(f"""SELECT coalesce(source, '') AS theme, {_CHANGED} AS quote_type, count(*) AS n, CASE WHEN count(*) < 3 THEN 'thin' ELSE 'normal' END AS data_density FROM documents WHERE doc_id % 11 <> 0 GROUP BY 1, 2""")
def theme_changes(spark, sf_dir):
    """A theme rollup of two thirds of the documents, then the rest as inserts, other types as updates and some retractions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    rows = census.tagged(docs, "source", "lang").select("doc_id", "theme", "quote_type")
    n = {"n": F.lit(1)}
    keys = ["theme", "quote_type"]
    first = rollups.applied(None, rollups.signed(rows.where("doc_id % 3 <> 0")), keys, n)
    second = rollups.applied(first, rollups.signed(rows.where("doc_id % 3 = 0")), keys, n)
    after = rows.where("doc_id % 7 = 0").withColumn("quote_type", F.lit("moved"))
    third = rollups.applied(second, rollups.signed(after, rows.where("doc_id % 7 = 0")), keys, n)
    gone = rows.where("doc_id % 11 = 0").withColumn("quote_type", F.when(F.col("doc_id") % 7 == 0, "moved").otherwise(F.col("quote_type")))
    last = rollups.applied(third, rollups.signed(went=gone), keys, n)
    return last.withColumn("data_density", F.when(F.col("n") < census.THIN_BELOW, "thin").otherwise("normal"))


@query("""WITH l AS (SELECT * FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
r AS (SELECT o_orderpriority AS angle_key, o_custkey, o_orderkey FROM l UNION ALL SELECT '2nd ' || o_orderpriority, o_custkey, o_orderkey FROM l WHERE o_orderkey % 2 = 0 UNION ALL SELECT '2nd ' || o_orderpriority, o_custkey, o_orderkey FROM l WHERE o_orderkey % 4 = 0)
SELECT angle_key, count(DISTINCT o_custkey) AS competitor_count, count(*) AS total_count, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS verbatim_count FROM r GROUP BY 1""")
def angle_changes(spark, sf_dir):
    """The census of each entity's latest analysis, after two later batches of analyses replaced what they supersede."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    year = F.year("o_orderdate")
    counters = {"total_count": F.lit(1), "verbatim_count": F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)}

    def rows(analyses):
        twice = F.when(F.col("o_orderkey") % 4 == 0, 2).when(F.col("o_orderkey") % 2 == 0, 1).otherwise(0)
        second = F.transform(F.array_repeat(F.lit("2nd "), twice), lambda p: F.concat(p, F.col("o_orderpriority")))
        return analyses.withColumn("angle_key", F.explode(F.concat(F.array("o_orderpriority"), second)))

    ok = F.col("o_orderstatus") == "F"
    latest = pick.latest_by(orders.where(year < 1994), ["o_custkey"], "o_orderdate", "o_orderkey", ok)
    references, rollup = rollups.entities_applied(None, None, rollups.signed(rows(latest)), ["angle_key"], "o_custkey", "competitor_count", counters)
    for batch in (orders.where((year >= 1994) & (year < 1997)), orders.where(year >= 1997)):
        latest, changes = rollups.replaced_latest(materialise(latest, "latest"), batch, "o_custkey", "o_orderdate", "o_orderkey", ok)
        references, rollup = rollups.entities_applied(materialise(references, "references"), materialise(rollup, "rollup"), rows(changes), ["angle_key"], "o_custkey", "competitor_count", counters)
    return rollup.select("angle_key", "competitor_count", "total_count", "verbatim_count")
