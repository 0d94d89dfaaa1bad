"""Whole dataflows as queries, with answers that are made from the tables."""

from pyspark.sql import functions as F

from tesserae.operators import pick
from tesserae.plans import flows
from tesserae.plans.registry import query
from tesserae.sources import table


@query("""WITH e AS (SELECT source, doc_id, lang FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)),
a AS (SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) <= 40), v AS (SELECT a.* FROM a SEMI JOIN e USING (doc_id)),
d AS (SELECT source AS store_id, lang AS theme, string_agg('voc:' || doc_id, ',' ORDER BY doc_id) AS refs FROM v GROUP BY 1, 2),
c AS (SELECT source AS store_id, count(*) AS cited FROM v GROUP BY 1), p AS (SELECT source AS store_id, count(*) AS pool FROM e GROUP BY 1),
t AS (SELECT source AS store_id, sum(n) AS publishable, bool_and(n < 3) AS all_thin FROM (SELECT source, lang, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1)
SELECT store_id, theme, refs, CASE WHEN pool >= 8 AND cited >= 5 THEN 'high' WHEN pool >= 3 AND cited >= 2 THEN 'medium' ELSE 'low' END AS confidence, publishable < 8 OR all_thin AS thin_data, 'draft' AS status
FROM d JOIN c USING (store_id) JOIN p USING (store_id) JOIN t USING (store_id) WHERE cited <= 200 AND store_id NOT LIKE '%3'""")
def voc_drafts(spark, sf_dir):
    """Synthesis drafts of each store: citations of what is not publishable are gone. An answer cites 40 documents of a theme at most; where the title is a number, it has no drafts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    good = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    evidence = good.select(F.col("source").alias("store_id"), F.lit("voc").alias("evidence_kind"), F.col("doc_id").cast("string").alias("evidence_id"))
    quotes = good.select(F.col("source").alias("store_id"), F.col("doc_id").cast("string").alias("evidence_id"), F.col("lang").alias("theme"), F.lit("desire").alias("type"))
    cited = pick.top_by(docs, ["source", "lang"], [F.col("doc_id")], 40)
    refs = F.sort_array(F.collect_list("doc_id"))
    pains = cited.groupBy("source", "lang").agg(F.struct(F.col("lang").alias("theme"), F.lit("s").alias("summary"), F.transform(refs, lambda i: F.struct(F.lit("voc").alias("kind"), i.cast("string").alias("id"))).alias("evidence_refs")).alias("pain"))
    answers = pains.groupBy(F.col("source").alias("store_id")).agg(F.sort_array(F.collect_list("pain")).alias("pains"))
    title = lambda t: F.to_json(F.struct(F.lit(t).alias("title"), "pains"))
    answers = answers.select("store_id", F.when(F.endswith("store_id", F.lit("3")), title(5)).otherwise(title("Title")).alias("response"))
    return flows.voc_flow(quotes, evidence, answers).select("store_id", "theme", "refs", "confidence", "thin_data", "status")


@query("""WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS ad_id, l_partkey AS pos, o_orderdate, l_shipdate, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY ad_id ORDER BY pos, l_shipdate, l_returnflag) = 1),
d AS (SELECT *, greatest(0, floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0))::BIGINT AS days, l_shipdate >= TIMESTAMP '1998-06-01' AS active FROM u),
r AS (SELECT * FROM d WHERE active),
p AS (SELECT 0 AS part, * FROM (SELECT * FROM r ORDER BY days, ad_id LIMIT 15) UNION ALL SELECT 1, * FROM (SELECT * FROM r ORDER BY days DESC, ad_id DESC LIMIT 15)),
s AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY ad_id ORDER BY part, ad_id) = 1),
i AS (SELECT ad_id FROM s WHERE l_returnflag <> 'R' ORDER BY ad_id LIMIT 8)
SELECT ad_id, days, ad_id IN (SELECT ad_id FROM i) AS has_image FROM s""")
def ads_sample(spark, sf_dir):
    """Pulled ads to a sample and the images to look at."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ad_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    kind = F.when(F.col("l_returnflag") == "R", "VIDEO").otherwise("IMAGE")
    pulled = joined.groupBy(ad_id.alias("ad_id")).agg(F.min(F.struct("l_partkey", "l_shipdate", "l_returnflag", "o_orderdate", kind.alias("media_type"))).alias("f"))
    rows = pulled.select("ad_id", F.col("ad_id").alias("pos"), F.col("f.o_orderdate").cast("timestamp").alias("start_date"), F.col("f.l_shipdate").cast("timestamp").alias("end_date"), F.lit("u").alias("media_url"), "f.media_type")
    _, sample, images = flows.ads_flow(rows, F.lit("1998-06-01 00:00:00").cast("timestamp"))
    shown = images.select("ad_id", F.lit(True).alias("has_image"))
    return sample.join(shown, "ad_id", "left").select("ad_id", "days", F.coalesce("has_image", F.lit(False)).alias("has_image"))


@query("""WITH a AS (SELECT doc_id AS k, min(doc_id) AS pos FROM documents GROUP BY 1)
SELECT 'u' || k AS url, pos, CASE WHEN l.doc_id IS NOT NULL AND quality = 1 THEN 'cached' WHEN item_id IS NOT NULL THEN left(text, 20) END AS analysis,
CASE WHEN l.doc_id IS NOT NULL AND quality = 1 THEN 'cache' WHEN item_id IS NOT NULL THEN 'batch' ELSE 'missing' END AS origin FROM a LEFT JOIN labels l ON l.doc_id = k LEFT JOIN benchmark ON item_id = k""")
def video_batch(spark, sf_dir):
    """Asked videos: cached analyses, answers of a batch by key, and what is missing."""
    asked = table(spark, sf_dir, "documents").groupBy(F.concat(F.lit("u"), F.col("doc_id")).alias("url")).agg(F.min("doc_id").alias("pos"))
    media = table(spark, sf_dir, "labels").select(F.concat(F.lit("u"), "doc_id").alias("url"), F.lit("cached").alias("analysis"), (F.col("quality") == 1).alias("file_there"))
    answers = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("u"), "item_id").alias("url"), F.substring("text", 1, 20).alias("analysis"))
    return flows.video_flow(asked, media, answers)
