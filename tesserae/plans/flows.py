"""Whole dataflows. What a model or a fetch would answer is an input table; before and after it all is Spark."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import html, rules, shapes, text, urls
from tesserae.operators import cache, census, grounding, ledger, limits, pick, robots, verify


MOST_REFS = 200  # Fixed value: the references that a synthesis may have.


def ads_flow(ads: DataFrame, now: Column, cap: int = 30, max_images: int = 8, fetches: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pulled ads to (snapshot rows, sample, images): keep-first by ad, a bounded sample, then the first media that are no
    videos; with `fetches` (media_url, outcome), the first that were fetched."""
    unique = pick.first_by(ads, ["ad_id"], [F.col("pos")])
    dated = unique.withColumn("days", rules.whole_days(F.col("start_date"), F.coalesce("end_date", now))).withColumn("active", rules.is_active(F.col("end_date"), now))
    sample = pick.stratified_sample(dated, "ad_id", "pos", "days", "active", cap)
    images = sample.where("media_url IS NOT NULL AND media_type <> 'VIDEO'")
    if fetches is not None:
        images = images.join(fetches.where("outcome = 'ok'").select("media_url").distinct(), "media_url", "left_semi")
    images = images.orderBy("pos").limit(max_images)
    return unique, sample, images


def web_flow(pages: DataFrame, rules_by_origin: DataFrame, stored: DataFrame, cap: int = 40) -> DataFrame:
    """Planned pages to new captures: robots, a cap for each host, text, two hashes, nothing stored twice."""
    allowed = robots.with_permission(pages.where(urls.is_fetchable(F.col("url"))), rules_by_origin, "url").withColumn("host", urls.canonical_host(F.col("url")))
    taken = limits.capped_pages(allowed, "host", [F.col("page_id")], cap, F.col("allowed"))
    read = taken.withColumn("_t", html.page_texts(F.col("html"))).withColumn("text", F.col("_t.page")).withColumn("reviews", F.col("_t.reviews")).drop("_t")
    hashed = read.withColumn("raw_html_sha256", F.sha2("html", 256)).withColumn("content_sha256", F.sha2("text", 256)).withColumn("source_url", F.col("url"))
    new = pick.insert_absent(stored, hashed, ["content_sha256", "source_url"], [F.col("page_id")])
    return new.withColumn("captured_html_path", urls.content_path(F.col("content_sha256"))).withColumn("text_path", urls.content_path(F.col("content_sha256"), ".txt"))


def collect_flow(captures: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Captures and extraction answers to (quotes, findings, counts): well-formed rows that occur in the
    reviews (quotes) or in the page (evidence of findings). captures: capture_id, html; answers: capture_id, response."""
    read = captures.select("capture_id", html.page_texts(F.col("html")).alias("_t")).select("capture_id", "_t.page", "_t.reviews")
    items = lambda field: answers.select("capture_id", F.posexplode(shapes.items(shapes.parsed(F.col("response")), field)).alias("pos", "raw"))
    quotes = items("quotes").select("capture_id", "pos", shapes.is_quote(F.col("raw")).alias("well_formed"), shapes.read(F.col("raw"), shapes.QUOTE).alias("q")).select("capture_id", "pos", "well_formed", "q.*")
    findings = items("findings").select("capture_id", "pos", shapes.is_finding(F.col("raw")).alias("well_formed"), shapes.read(F.col("raw"), shapes.FINDING).alias("f")).select("capture_id", "pos", "well_formed", "f.*")
    # for the counts both kinds meet a capture's texts in one join, so that its page is read once
    asked = quotes.select("capture_id", F.lit("quotes").alias("kind"), "well_formed", F.col("quote").alias("_part")).unionByName(findings.select("capture_id", F.lit("findings").alias("kind"), "well_formed", F.col("evidence").alias("_part")))
    normal = read.select("capture_id", text.normalize(F.col("page")).alias("_page"), text.normalize(F.col("reviews")).alias("_reviews"))
    found = text.occurs(F.when(F.col("kind") == "quotes", F.col("_reviews")).otherwise(F.col("_page")), F.col("_part"))
    kinds = asked.join(normal.hint("merge"), "capture_id", "left").select("capture_id", "kind", (F.coalesce(found, F.lit(False)) & F.col("well_formed")).alias("admitted"))
    quotes = grounding.admit(quotes, read, "capture_id", "quote", "reviews").withColumn("admitted", F.col("admitted") & F.col("well_formed"))
    findings = grounding.admit(findings, read, "capture_id", "evidence", "page").withColumn("admitted", F.col("admitted") & F.col("well_formed"))
    counts = kinds.groupBy("capture_id", "kind").agg(F.count(F.when(F.col("admitted"), 1)).alias("minted"), F.count(F.when(~F.col("admitted"), 1)).alias("rejected"))
    return quotes, findings, counts


def verify_flow(evidence: DataFrame, captures: DataFrame, objects: DataFrame, labels: DataFrame, group: str, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence to (members with results, tally, capture verdicts): a frozen sample, integrity, grounding, labels.
    evidence: group, evidence_id, capture_id, text, quote; labels: evidence_id, response."""
    members = pick.hashed_sample(evidence, group, "evidence_id", n)
    checked = verify.integrity(members, captures, objects)
    verdicts = labels.where(shapes.is_label(F.col("response"))).select("evidence_id", F.from_json("response", shapes.LABEL)["verdict"].alias("verdict"))
    results = verify.outcomes(checked, verdicts)
    return results, verify.tally(results, [group]), verify.capture_verdict(results, "capture_id")


def voc_flow(quotes: DataFrame, evidence: DataFrame, answers: DataFrame) -> DataFrame:
    """Publishable quotes and synthesis answers to drafts: store_id, title, theme, summary, refs, confidence, thin_data.
    Answers that are not well-formed go, then citations of what is not publishable, and pains without any left. quotes: store_id, evidence_id, theme, type."""
    parsed = answers.where(shapes.is_synthesis(F.col("response"))).select("store_id", F.from_json("response", shapes.SYNTHESIS).alias("r"))
    pains = parsed.select("store_id", "r.title", F.posexplode("r.pains").alias("pos", "p")).select("store_id", "title", "pos", "p.theme", "p.summary", F.posexplode("p.evidence_refs").alias("ref_pos", "ref"))
    refs = pains.select("store_id", "title", "pos", "theme", "summary", "ref_pos", F.col("ref.kind").alias("evidence_kind"), F.col("ref.id").alias("evidence_id"))
    valid = pick.first_by(census.cited(refs, evidence, ["store_id", "evidence_kind", "evidence_id"]), ["store_id", "pos", "evidence_kind", "evidence_id"], [F.col("ref_pos")])
    cited_once = valid.groupBy("store_id").agg(F.count_distinct("evidence_kind", "evidence_id").alias("_refs")).where(F.col("_refs") <= MOST_REFS)
    valid = valid.join(cited_once.select("store_id"), "store_id", "left_semi")  # a synthesis with more references is not created
    drafts = valid.groupBy("store_id", "title", "pos", "theme", "summary").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ref_pos", "evidence_kind", "evidence_id"))), lambda r: F.concat_ws(":", r["evidence_kind"], r["evidence_id"])), ",").alias("refs"))
    cited = valid.select("store_id", "evidence_kind", "evidence_id").distinct().groupBy("store_id").agg(F.count("*").alias("cited"))
    pool = evidence.groupBy("store_id").agg(F.count("*").alias("evidence"))
    themes = quotes.groupBy("store_id", "theme", "type").agg(F.count("*").alias("n")).groupBy("store_id").agg(F.sum("n").alias("publishable"), F.count("*").alias("rows"), F.count(F.when(F.col("n") < census.THIN_BELOW, 1)).alias("thin_rows"))
    out = drafts.join(cited, "store_id").join(pool, "store_id").join(themes, "store_id", "left")
    thin = rules.is_thin(F.coalesce("publishable", F.lit(0)), F.coalesce("rows", F.lit(0)), F.coalesce("thin_rows", F.lit(0)))
    return out.select("store_id", "title", "pos", "theme", "summary", "refs", rules.confidence(F.col("evidence"), F.col("cited")).alias("confidence"), thin.alias("thin_data"), F.lit("draft").alias("status"))


def whitespace_flow(registry: DataFrame, fallback: DataFrame, header: DataFrame, rollup: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whitespace answers to (drafts, refs): candidates of the registry, the first of each, without numbers of the
    model's own; counts come from the rollup. The references are the engine's own: the batch and all of its rows.

    header: batch_id, coverage_gap, with_observations (its absence is an error); rollup: batch_id, id, angle_key,
    competitor_count, total_count; answers: batch_id, response.
    """
    live = census.active_registry(registry, fallback).where("angle_key <> 'unmapped'")
    well_formed = answers.where(shapes.is_whitespace(F.col("response")))
    parsed = well_formed.select("batch_id", F.posexplode(F.from_json("response", shapes.WHITESPACE)["candidates"]).alias("pos", "c")).select("batch_id", "pos", "c.angle_key", "c.summary")
    clean = parsed.where(~text.has_number(F.col("summary")))
    first = pick.first_by(pick.present(clean, live, ["angle_key"]), ["batch_id", "angle_key"], [F.col("pos")]).join(live, "angle_key")
    counted = census.with_absence(first, rollup.select("batch_id", "angle_key", "competitor_count", "total_count"), ["batch_id", "angle_key"])
    gap, seen = F.col("coverage_gap"), F.col("with_observations")
    drafts = census.batch(header.select("batch_id", "coverage_gap", "with_observations"), counted, "batch_id").where("angle_key IS NOT NULL")
    drafts = drafts.withColumn("confidence", rules.coverage_confidence(gap, seen)).withColumn("thin_data", rules.coverage_is_thin(gap, seen))
    return drafts, census.evidence_refs(header, rollup, "batch_id", "id").join(drafts.select("batch_id").distinct(), "batch_id", "left_semi")


def reserve_flow(calls: DataFrame, cards: DataFrame, ceiling: int, per_hour: int, per_day: int) -> DataFrame:
    """(project, ref, outcome) of calls that pass three layers in turn: the rolling guard, the price card, the ledger.
    calls: project, ref, call, seconds, job_kind, connector."""
    guard = limits.admissions(calls, "project", "seconds", "call", per_hour, per_day).select("call", (~F.col("admitted")).alias("blocked"))
    priced = ledger.priced(calls.join(guard, "call"), cards)
    return ledger.reserve_fold(priced, "project", "ref", "seconds", "est_cents", ceiling)


def video_flow(asked: DataFrame, media: DataFrame, answers: DataFrame) -> DataFrame:
    """Asked videos (url, pos) with their analysis: cached ones as they are, others by their own key from the
    answers; `origin` is cache, batch or missing. media: url, analysis, file_there; answers: url, analysis."""
    split = cache.lookup(asked, media.select("url", "analysis", "file_there"), "url", F.col("file_there") & F.col("analysis").isNotNull())
    reused = split.where("cached").select("url", "pos", "analysis", F.lit("cache").alias("origin"))
    todo = split.where("NOT cached").select("url", "pos").join(answers.select("url", "analysis"), "url", "left")
    return reused.unionByName(todo.select("url", "pos", "analysis", F.when(F.col("analysis").isNotNull(), "batch").otherwise("missing").alias("origin")))
