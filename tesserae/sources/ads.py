"""Ad-library responses: brand search, paged scans, and the flattening of nested ads."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.pick import first_by, top_by

CARD = "struct<resized_image_url:string,body:string>"
AD = (
    "struct<ad_archive_id:string,start_date:double,end_date:double,page_id:string,page_name:string,currency:string,funding_entity:string,impressions:string,spend:string,"
    "disclaimer:string,languages:string,publisher_platforms:string,platform_positions:string,effective_status:string,"
    f"snapshot:struct<display_format:string,body:struct<text:string>,images:array<struct<resized_image_url:string>>,videos:array<struct<video_sd_url:string>>,cards:array<{CARD}>>>"
)
EXTRA = ("page_id", "page_name", "currency", "funding_entity", "impressions", "spend", "disclaimer", "languages", "publisher_platforms", "platform_positions", "effective_status")


def brand_pages(responses: DataFrame, brand: str, body: str) -> DataFrame:
    """(brand, name, page_id) of search responses: results that lack either are dropped, of equal names the last stays."""
    rows = responses.select(brand, F.posexplode(F.from_json(body, "struct<searchResults:array<struct<name:string,page_id:string>>>")["searchResults"]).alias("pos", "r"))
    return first_by(rows.select(brand, "pos", "r.name", "r.page_id").where("name <> '' AND page_id <> ''"), [brand, "name"], [F.col("pos").desc()]).drop("pos")


def brand_batch(brands: DataFrame, found: DataFrame, brand: str) -> DataFrame:
    """(brand, pages): every asked brand once, in a map of its pages, empty where the search failed or found none."""
    maps = found.groupBy(brand).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "page_id")))).alias("pages"))
    return brands.select(brand).distinct().join(maps, brand, "left").withColumn("pages", F.coalesce("pages", F.create_map().cast("map<string,string>")))


def flat_ads(results: DataFrame, ad: str | Column, order: list[str], trim: bool = True) -> DataFrame:
    """A row for each pair of medium and body of supported ads, pairs matched by position up to the shorter list.

    Dates become timestamps (UTC). Pairs without a medium or with an empty body are dropped.
    """
    # a row for each ad comes first: where `ad` is parsed from text, every use of a field would otherwise parse it again
    results = results.select(*order, F.explode(F.array(F.col(ad) if isinstance(ad, str) else ad)).alias("_ad"))
    a = F.col("_ad")
    s = a["snapshot"]
    form = s["display_format"]
    body = F.when(s["body"].isNotNull(), F.array(s["body"]["text"]))
    media = F.when(form == "IMAGE", F.transform(F.slice(s["images"], 1, 1), lambda i: i["resized_image_url"])).when(form == "VIDEO", F.transform(F.slice(s["videos"], 1, 1), lambda v: v["video_sd_url"])).when(form == "DCO", F.transform(s["cards"], lambda c: c["resized_image_url"]))
    bodies = F.when(form == "DCO", F.transform(s["cards"], lambda c: c["body"])).otherwise(body)
    rows = results.where((a["ad_archive_id"] != "") & form.isin("IMAGE", "VIDEO", "DCO")).select(
        *order, a["ad_archive_id"].alias("ad_id"), F.timestamp_seconds(a["start_date"]).alias("start_date"), F.timestamp_seconds(a["end_date"]).alias("end_date"),
        form.alias("media_type"), *([] if trim else [a[c].alias(c) for c in EXTRA]), F.posexplode(F.arrays_zip(media.alias("m"), bodies.alias("b"))).alias("card", "z"),
    )
    return rows.withColumn("media_url", F.col("z")["m"]).withColumn("body", F.col("z")["b"]).drop("z").where("media_url IS NOT NULL AND body <> ''")


def paged_scan(pages: DataFrame, key: str, page_no: str, ads: str, failed: str, limit: int, most_requests: int = 10) -> DataFrame:
    """(key, page_no, pos, ad, is_partial): the ads of each key's leading pages, at most `limit` of them.

    Pages count from 0, ten at most; a failed or empty page ends the scan, and `is_partial` says that it failed.
    """
    used = pages.where(F.col(page_no) < most_requests)
    stop = used.where(F.col(failed) | (F.coalesce(F.size(ads), F.lit(0)) <= 0)).groupBy(key).agg(F.min(page_no).alias("_stop"), F.min_by(failed, page_no).alias("_failed"))
    rows = used.join(stop, key, "left").where(F.col("_stop").isNull() | (F.col(page_no) < F.col("_stop")))
    flat = rows.select(key, page_no, F.coalesce("_failed", F.lit(False)).alias("is_partial"), F.posexplode(ads).alias("pos", "ad"))
    return top_by(flat, [key], [F.col(page_no), F.col("pos")], limit)
