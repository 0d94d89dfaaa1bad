"""Queries over documents and events as a media cache."""

from pyspark.sql import functions as F

from tesserae.operators import cache, pick
from tesserae.plans.registry import query
from tesserae.sources import table

_MEDIA = "CASE WHEN doc_id % 3 = 0 THEN 'video' ELSE 'image' END"


def _media(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("media_type", F.expr(_MEDIA)).withColumn("duration", F.when(F.col("media_type") == "video", F.col("n_chars") / 100))


_FIGURES = """count(*) AS total, coalesce(sum(n_chars), 0)::BIGINT AS total_bytes, count(CASE WHEN lang = 'en' THEN 1 END) AS analysed, count(DISTINCT source) AS brands, round(avg(CASE WHEN media_type = 'video' THEN n_chars / 100.0 END), 6) AS avg_duration"""


@query(f"""WITH m AS (SELECT *, {_MEDIA} AS media_type FROM documents), s AS (SELECT media_type AS scope, {_FIGURES} FROM m GROUP BY 1 UNION ALL SELECT 'all', {_FIGURES} FROM m)
SELECT scope, total, total_bytes, analysed, brands, avg_duration, round(total_bytes / 1024 / 1024, 2) AS total_mb, round(round(total_bytes / 1024 / 1024, 2) / 1024, 2) AS total_gb FROM s""")
def cache_stats(spark, sf_dir):
    """Figures of the whole cache and of each kind."""
    return cache.stats(_media(spark, sf_dir), "media_type", "n_chars", F.col("lang") == "en", "source", "duration").withColumn("avg_duration", F.round("avg_duration", 6))


@query(f"SELECT doc_id, source, n_chars FROM (SELECT *, {_MEDIA} AS media_type FROM documents) WHERE source = 'src8' AND text ILIKE '%the%' AND media_type = 'image' ORDER BY n_chars DESC, doc_id LIMIT 20")
def faceted_search(spark, sf_dir):
    """Rows that meet every facet, the largest first."""
    found = cache.search(_media(spark, sf_dir), F.col("source") == "src8", None, ("text", "the"), F.col("media_type") == "image", [F.col("n_chars").desc(), F.col("doc_id")], 20)
    return found.select("doc_id", "source", "n_chars")


@query("""SELECT event_type, count(*) AS before, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS after, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS deleted,
coalesce(sum(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN user_id END), 0)::BIGINT AS freed FROM events GROUP BY 1""")
def retention_cleanup(spark, sf_dir):
    """What an age limit removes."""
    return cache.cleanup_report(table(spark, sf_dir, "events"), "event_type", "ts", "user_id", F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))


@query("""WITH old AS (SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1), new AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, event_id, 'new' AS origin FROM new UNION ALL SELECT user_id, event_id, 'old' FROM old ANTI JOIN new USING (user_id)""")
def upsert_last_wins(spark, sf_dir):
    """Whole rows replaced, the last of each key."""
    events = table(spark, sf_dir, "events")
    old = events.where("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("event_id")).withColumn("origin", F.lit("old"))
    new = events.where("event_type = 'purchase'").select("user_id", "event_id", F.lit("new").alias("origin"))
    return pick.upsert(old, new, ["user_id"], [F.col("event_id").desc()])


@query("""WITH u AS (SELECT user_id * 3 AS doc_id, min(event_id) AS pos FROM events GROUP BY 1)
SELECT u.doc_id, pos, d.doc_id IS NOT NULL AS cached, CASE WHEN d.doc_id IS NULL THEN 1000 ELSE 0 END AS tokens FROM u LEFT JOIN (SELECT doc_id FROM documents WHERE n_chars > 500) d ON u.doc_id = d.doc_id""")
def batch_lookup(spark, sf_dir):
    """Asked keys split into those in the cache and those to analyse, with what the latter cost."""
    asked = table(spark, sf_dir, "events").groupBy((F.col("user_id") * 3).alias("doc_id")).agg(F.min("event_id").alias("pos"))
    found = cache.lookup(asked, table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars") > 500)
    return found.select("doc_id", "pos", "cached", F.when(F.col("cached"), 0).otherwise(1000).alias("tokens"))


@query("""WITH r AS (SELECT user_id AS doc_id, max(ts) AS read_at FROM events GROUP BY 1)
SELECT doc_id, greatest(TIMESTAMP '2024-01-10', read_at) AS last_accessed FROM documents LEFT JOIN r USING (doc_id)""")
def access_touch(spark, sf_dir):
    """Last access moved by reads."""
    media = table(spark, sf_dir, "documents").select("doc_id", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz").alias("last_accessed"))
    reads = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "ts")
    return cache.touched(media, reads, "doc_id", "ts")


@query("SELECT doc_id, coalesce(quality, -1) AS quality, CASE WHEN toxic = 1 THEN 'red,black' END AS colours FROM documents LEFT JOIN labels USING (doc_id)")
def analysis_update(spark, sf_dir):
    """Analysis columns updated by key, facets derived."""
    from tesserae.functions.text import joined_colours

    media = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(None).cast("string").alias("colours"))
    colours = joined_colours(F.when(F.col("toxic") == 1, F.array(F.lit("red"), F.lit("black"))).otherwise(F.array().cast("array<string>")))
    results = table(spark, sf_dir, "labels").select("doc_id", "quality", colours.alias("colours"))
    return cache.with_analysis(media, results, "doc_id", ["quality", "colours"])
