"""The tool surface: validated arguments in, an envelope with a frame out; failures become success False."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.rules import credit_status
from tesserae.operators import cache
from tesserae.plans.flows import video_flow
from tesserae.sources import ads

AD_LIMIT, MOST_ADS, SEARCH_LIMIT, MAX_AGE_DAYS = 50, 500, 20, 30
TOKENS_EACH, TOKENS_IN_BATCH = 1000, 120


def _tool(f: Callable) -> Callable:
    def run(*args, **kwargs) -> dict:
        try:
            return {"success": True, "message": "", "error": None} | f(*args, **kwargs)
        except Exception as e:  # noqa: BLE001 - the surface never raises
            return {"success": False, "message": f"{f.__name__} failed: {e}", "error": str(e), "results": None}

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def _names(value: str | list[str], what: str) -> list[str]:
    given = [value] if isinstance(value, str) else list(value)
    if not given or any(not isinstance(v, str) or not v.strip() for v in given):
        raise ValueError(f"{what} must be a name or a list of names that are not blank")
    return list(dict.fromkeys(v.strip() for v in given))


@_tool
def get_meta_platform_id(responses: DataFrame, brand_names: str | list[str]) -> dict:
    """Pages of brands. responses: brand, body (JSON of a search), and status where it is known: a refusal for credits or
    rate aborts the whole batch, any other failure gives its brand an empty map."""
    names = _names(brand_names, "brand_names")
    if "status" in responses.columns:
        refused = responses.where(F.col("brand").isin(*names)).select(credit_status(F.col("status"), F.col("body")).alias("s")).where("s <> 'ok'").first()
        if refused:
            raise ValueError(f"the search was refused: {refused['s']}")
    asked = responses.sparkSession.createDataFrame([(n,) for n in names], "brand string")
    found = ads.brand_batch(asked, ads.brand_pages(responses, "brand", "body"), "brand")
    n = found.agg(F.count("*").alias("total"), F.count(F.when(F.size("pages") > 0, 1)).alias("found"), F.coalesce(F.sum(F.size("pages")), F.lit(0)).alias("pages")).first()
    return {"results": found, "message": f"{n['found']} of {n['total']} brands found", "batch_info": {"total": n["total"], "successful": n["found"], "failed": n["total"] - n["found"], "pages": n["pages"]}}


@_tool
def get_meta_ads(pages: DataFrame, platform_ids: str | list[str], limit: int = AD_LIMIT, country: str | None = None, trim: bool = True) -> dict:
    """Ads of pages. pages: page_id, country, page_no, ads (array of the ad structure), failed."""
    ids = _names(platform_ids, "platform_ids")
    if not isinstance(limit, int) or limit <= 0:
        raise ValueError("limit must be a positive integer")
    if country is not None and len(country.strip()) != 2:
        raise ValueError("country must have two letters")
    rows = pages.where(F.col("page_id").isin(*ids))
    rows = rows.where(F.col("country") == country.strip().upper()) if country else rows
    scanned = ads.paged_scan(rows, "page_id", "page_no", "ads", "failed", min(limit, MOST_ADS))
    flat = ads.flat_ads(scanned, "ad", ["page_id", "page_no", "pos", "is_partial"] if trim else ["page_no", "pos", "is_partial"], trim)
    per = {r["page_id"]: r["n"] for r in flat.groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("page_id").isin(*ids)).collect()}
    return {"results": flat, "message": f"{sum(per.values())} ads", "batch_info": {"total": len(ids), "successful": len(per), "failed": len(ids) - len(per), "ads": sum(per.values())}}


@_tool
def get_cache_stats(media: DataFrame) -> dict:
    """Figures of the cache. media: media_type, file_size, analysis, brand_name, duration_seconds."""
    return {"results": cache.stats(media, "media_type", "file_size", F.col("analysis").isNotNull(), "brand_name", "duration_seconds")}


@_tool
def search_cached_media(media: DataFrame, brand_name: str | None = None, has_people: bool | None = None, color_contains: str | None = None, media_type: str | None = None, limit: int | None = SEARCH_LIMIT) -> dict:
    """Media by facets, those used last first; inline image data is left out."""
    if media_type not in (None, "image", "video"):
        raise ValueError("media_type must be image or video")
    equal = lambda c, v: F.col(c) == v if v is not None else None
    colour = ("dominant_colors", color_contains) if color_contains else None
    found = cache.search(media.drop("base64"), equal("brand_name", brand_name or None), equal("has_people", has_people), colour, equal("media_type", media_type), [F.col("last_accessed").desc(), F.col("url_hash")], limit)
    return {"results": found}


@_tool
def cleanup_media_cache(media: DataFrame, now, max_age_days: int = MAX_AGE_DAYS) -> dict:
    """What stays after media older than the limit go, and the figures of the cleanup."""
    if max_age_days <= 0:
        raise ValueError("max_age_days must be positive")
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(max_age_days))
    return {"results": cache.retained(media, "downloaded_at", cutoff), "stats": cache.cleanup_report(media, "media_type", "downloaded_at", "file_size", cutoff)}


@_tool
def analyze_ad_image(media: DataFrame, answers: DataFrame, media_urls: str | list[str]) -> dict:
    """Analyses of images: cached ones, else those of the answers (url, analysis)."""
    return _analysed(media, answers, _names(media_urls, "media_urls"), "image")


@_tool
def analyze_ad_video(media: DataFrame, answers: DataFrame, media_url: str) -> dict:
    return _analysed(media, answers, _names(media_url, "media_url"), "video")


@_tool
def analyze_ad_videos_batch(media: DataFrame, answers: DataFrame, media_urls: list[str], brand_names: list[str] | None = None, ad_ids: list[str] | None = None) -> dict:
    """Analyses of videos with what the batch saves; lists that go with the URLs must be as long."""
    for other in (brand_names, ad_ids):
        if other is not None and len(other) != len(media_urls):
            raise ValueError("lists must be of equal length")
    out = _analysed(media, answers, _names(media_urls, "media_urls"), "video")
    n = out["results"].where("origin = 'batch'").count()
    labels = media.sparkSession.createDataFrame([(u, i, (brand_names or [None] * len(media_urls))[i], (ad_ids or [None] * len(media_urls))[i]) for i, u in enumerate(media_urls)], "url string, asked int, brand_name string, ad_id string")
    return out | {"results": labels.join(out["results"].drop("pos"), "url", "left"), "tokens_saved": n * (TOKENS_EACH - TOKENS_IN_BATCH)}


def _analysed(media: DataFrame, answers: DataFrame, names: list[str], kind: str) -> dict:
    asked = media.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "url string, pos int")
    return {"results": video_flow(asked, media.where(F.col("media_type") == kind), answers)}


#: The older name of the image search.
def search_cached_images(media: DataFrame, **facets) -> dict:
    return search_cached_media(media, media_type="image", **facets)
