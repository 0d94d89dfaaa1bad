import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tesserae import tools
from tesserae.functions.text import normalize
from tesserae.operators import cache, census, grams, grounding, jobs, ledger, limits, pick, prefix, resolve, robots, rollups, snapshots, verify
from tesserae.plans import flows
from tesserae.session import materialise
from tesserae.sources import ads, state


def test_first_by_has_one_null_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "pos long, k string")
    assert sorted(r.pos for r in pick.first_by(df, ["k"], [F.col("pos")]).collect()) == [1, 3]


@pytest.mark.parametrize("undated_first", [False, True])
def test_stratified_sample(spark, undated_first):
    rows = [(i, f"ad{i}", i if i < 95 else None, i != 50) for i in range(100)]
    df = spark.createDataFrame(rows, "pos long, ad_id string, days long, active boolean")
    got = {r.pos for r in pick.stratified_sample(df, "ad_id", "pos", "days", "active", 10, undated_first).collect()}
    assert got == {0, 1, 2, 3, 4} | ({95, 96, 97, 98, 99} if undated_first else {90, 91, 92, 93, 94})
    small = df.where("pos < 5")
    assert pick.stratified_sample(small, "ad_id", "pos", "days", "active", 10).count() == 5
    undated = df.withColumn("days", F.lit(None).cast("long"))
    assert {r.pos for r in pick.stratified_sample(undated, "ad_id", "pos", "days", "active", 4).collect()} == {0, 1, 98, 99}
    none = df.withColumn("active", F.lit(False))
    assert pick.stratified_sample(none, "ad_id", "pos", "days", "active", 200).count() == 100


def test_inserts_and_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v long, facet string")
    new = spark.createDataFrame([("b", 3, 0), ("b", 4, 1), ("c", 5, 2)], "k string, v long, pos long")
    assert [(r.k, r.v) for r in pick.insert_absent(old, new, ["k"], [F.col("pos")]).collect()] == [("c", 5)]
    merged = pick.upsert(old, new.drop("pos").withColumn("v", F.col("v")), ["k"], [F.col("v").desc()])
    assert sorted((r.k, r.v, r.facet) for r in merged.collect()) == [("a", 1, "x"), ("b", 4, None), ("c", 5, None)]


def test_resolution_cascade(spark):
    options = spark.createDataFrame([("Sophie & Olivia", "1"), ("Sophie Olivia Intimates", "2"), ("SecretCoco.com", "3"), ("NIKE", "4"), ("Nike", "5"), ("Acme One", "6"), ("Acme Two", "7"), ("日本", "8"), ("Ünïversal", "9"), ("Ab", "10")], "name string, page string")
    probes = spark.createDataFrame([("日本",), ("ÜNÏVERSAL",), ("東京",), (None,), ("a",), ("Nike",), ("nIKE",), ("Sophie Olivia",), ("Secret Coco",), ("Acme",), ("Zzz",), ("&&",)], "brand string")
    got = {r.brand: (r.page, r.how) for r in resolve.resolve(probes, options, "brand", "name", "page").collect()}
    assert got == {"Nike": ("5", "exact"), "nIKE": ("4", "case"), "Sophie Olivia": ("1", "normalized"), "Secret Coco": ("3", "prefix"), "Acme": (None, "ambiguous"), "Zzz": (None, "none"), "&&": (None, "none"), "日本": ("8", "exact"), "ÜNÏVERSAL": ("9", "case"), "東京": (None, "none"), None: (None, "none"), "a": (None, "ambiguous")}
    assert resolve.resolve(probes.limit(0), options, "brand", "name", "page").count() == 0
    assert {r.how for r in resolve.resolve(probes, options.limit(0), "brand", "name", "page").collect()} == {"none"}


@pytest.mark.parametrize("bits", [grounding.LEAST_BITS, 1 << 15])
def test_containing_equals_the_plain_join(spark, monkeypatch, bits):
    monkeypatch.setattr(grounding, "LEAST_BITS", bits)
    monkeypatch.setattr(grounding, "MOST_BITS", bits)  # a fuller filter lets more through
    monkeypatch.setattr(grounding, "PART", 40)
    quotes = [(1, "one two three four five"), (2, "ree four five six seve"), (3, "short"), (4, ""), (5, None), (6, "not in any text at all"), (7, "short"), (8, "o t"), (9, "two three"), (10, "x"), (None, "e four f"), (11, "three four five six"), (11, "日本語"), (12, "a b c"), (13, "\U0001f600\U0001f600")]
    texts = [(10, "zero  one two\nthree four five six seven"), (11, "a short text"), (12, None), (13, "tone two three four fives"), (13, "short again"), (None, "a b c d 日本語x\U0001f600\U0001f600"), (14, ""), (15, "x"), (13, "short again")]
    rng = random.Random(6)
    words = ["ab", "b", "abc", "é", "the", "a"]
    texts += [(100 + i, " ".join(rng.choices(words, k=rng.randrange(12)))) for i in range(60)]
    quotes += [(100 + i, " ".join(rng.choices(words, k=rng.randrange(1, 6)))[rng.randrange(2) :]) for i in range(60)]
    q, t = spark.createDataFrame(quotes, "q long, quote string").repartition(3), spark.createDataFrame(texts, "t long, body string").repartition(3)
    got = sorted(str((r.q, r.t)) for r in grounding.containing(q, t, "q", "quote", "t", "body").collect())
    plain = q.join(t, (normalize(F.col("quote")) != "") & F.contains(normalize(F.col("body")), normalize(F.col("quote"))))
    assert got == sorted(str((r.q, r.t)) for r in plain.collect()) and len(got) > 200
    assert grounding.containing(q.limit(0), t, "q", "quote", "t", "body").count() == 0 == grounding.containing(q, t.limit(0), "q", "quote", "t", "body").count()


def test_quotes_go_by_their_rarest_gram(spark):
    texts = spark.createDataFrame([(i, f"we ship all orders free of charge to number {i} street") for i in range(200)], "t long, body string")
    quotes = spark.createDataFrame([(1, "free of charge to number 77 street"), (2, "orders free of charge and more of it")], "q long, quote string")
    out = grounding.containing(quotes, texts, "q", "quote", "t", "body")
    assert [(r.q, r.t) for r in out.collect()] == [(1, 77)]
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("repartition") == 0 and not re.search("Cartesian|cross", text)


def test_gram_hashes_depend_on_the_gram_alone():
    hasher = grams.Hasher()
    text = "the cat sat on the cat sat mat"
    of, h = hasher.grams(["x", text, "é cat sat", ""], [2])
    words = [("the", "cat"), ("cat", "sat"), ("sat", "on"), ("on", "the"), ("the", "cat"), ("cat", "sat"), ("sat", "mat"), ("é", "cat"), ("cat", "sat")]
    assert of.tolist() == [1] * 7 + [2] * 2 and [words.index(w) for w in words] == [h.tolist().index(x) for x in h.tolist()]
    of, h = hasher.grams(["abcab", "", "cab"], [-2])
    pairs = ["ab", "bc", "ca", "ab", "ca", "ab"]
    assert of.tolist() == [0] * 4 + [2] * 2 and [pairs.index(p) for p in pairs] == [h.tolist().index(x) for x in h.tolist()]
    assert [grams.kind_of(x) for x in ("a", "abcdefgh", "a b", "a b c", "a b c d", "a b c d e f")] == [-1, -6, -3, 1, 2, 3]
    assert len(hasher.grams(["a b c d"], [1], inside=True)[0]) == 2 and len(hasher.grams(["a b"], [1], inside=True)[0]) == 0


def test_theme_rollup_and_registry(spark):
    quotes = spark.createDataFrame([(i, "fit" if i < 4 else None, "desire" if i < 4 else "") for i in range(6)], "id long, theme string, kind string")
    rows = {r.theme: r for r in census.theme_rollup(quotes, "theme", "kind", "id").collect()}
    assert (rows["fit"].n, rows["fit"].data_density, rows["fit"].example_ids) == (4, "normal", [0, 1, 2]) and (rows[""].n, rows[""].data_density) == (2, "thin")
    assert (rows["fit"].first_id, rows["fit"].last_id) == (0, 3) and census.theme_members(quotes, "theme", "kind", "id").count() == 6
    fallback = spark.createDataFrame([("fit", "Fit", "d"), ("unmapped", "Unmapped", "u")], "angle_key string, label string, definition string")
    live = spark.createDataFrame([("b", "", None, "active"), ("", "x", "", "active"), ("z", "Z", "", "retired")], "angle_key string, label string, definition string, status string")
    assert [(r.angle_key, r.label) for r in census.active_registry(live, fallback).collect()] == [("b", "b"), ("unmapped", "Unmapped")]
    assert [r.angle_key for r in census.active_registry(live.limit(0), fallback).collect()] == ["fit", "unmapped"]


def brute_admissions(times, per_hour, per_day):
    held, out = [], []
    for t in times:
        held = [h for h in held if t - h <= 86_400]
        reason = "hour" if sum(t - h <= 3600 for h in held) >= per_hour else "day" if len(held) >= per_day else None
        held += [t] if reason is None else []
        out.append(reason)
    return out


def test_admissions(spark):
    times = [0, 10, 20, 3600, 3601, 3620, 3621, 40_000, 86_400, 86_401, 90_000]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "key long, call long, seconds long")
    got = [r.reason for r in limits.admissions(df, "key", "seconds", "call", 2, 4).orderBy("call").collect()]
    assert got == brute_admissions(times, 2, 4) and None in got and "hour" in got and "day" in got


def test_streamed_admissions(spark, tmp_path):
    from tesserae.streaming import admitted_stream, drain

    times = [0, 10, 20, 3600, 3601, 3620, 40_000, 86_401]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "key long, call long, seconds long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    drain(admitted_stream(stream, 2, 4), str(tmp_path / "cp"), lambda batch, i: got.extend((r.call, r.reason) for r in batch.collect()))
    assert [r for _, r in sorted(got)] == brute_admissions(times, 2, 4)


def test_first_of_day_stream(spark, tmp_path):
    from tesserae.streaming import drain, first_of_day

    df = spark.sql("select 'k1' key, timestamp'2024-01-01 10:00:00' at union all select 'k1', timestamp'2024-01-01 11:00:00' union all select 'k2', timestamp'2024-01-01 11:00:00'")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    drain(first_of_day(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "key", "at"), str(tmp_path / "cp"), lambda batch, i: got.extend(r.key for r in batch.collect()))
    assert sorted(got) == ["k1", "k2"]


def test_jobs(spark):
    events = spark.createDataFrame([("j", 1, "claimed", "a"), ("j", 2, "claimed", "b"), ("j", 3, "running", "b"), ("j", 4, "running", "a"), ("j", 5, "done", "a"), ("j", 6, "failed", "a"), ("q", 1, "running", "a")], "job string, pos long, wanted string, who string")
    got = {r.job: (r.status, r.holder, r.accepted, r.rejected) for r in jobs.folded_states(events, "job", ["pos"], "wanted", "who").collect()}
    assert got == {"j": ("done", "a", 3, 3), "q": ("queued", None, 0, 1)}
    rows = spark.createDataFrame([(1, "scrape", "running", 0), (2, "collect", "running", 400), (3, "verify", "done", 0), (4, "scrape", "queued", 5)], "id long, job_kind string, status string, claimed_at long")
    assert {r.id: (r.stale, r.status) for r in jobs.reaped(rows, jobs.lease_table(spark), "claimed_at", F.lit(700)).collect()} == {1: (True, "queued"), 2: (False, "running"), 3: (False, "done"), 4: (False, "queued")}


def test_ledger(spark):
    calls = spark.createDataFrame([("p", "r1", 1, 60), ("p", "r2", 2, 50), ("p", "r1", 3, 60), ("p", "r3", 4, 40)], "project string, ref string, at long, est long")
    assert sorted((r.ref, r.outcome) for r in ledger.reserve_fold(calls, "project", "ref", "at", "est", 100).collect()) == [("r1", "ok"), ("r1", "skip"), ("r2", "refused"), ("r3", "ok")]
    reserves = spark.createDataFrame([("r1", 60), ("r2", 50)], "ref string, est_cents long")
    done = spark.createDataFrame([("r1", 70, 0), ("r1", 10, 1), ("r9", 1, 2)], "ref string, actual_cents long, pos long")
    assert {r.ref: (r.actual_cents, r.overspent) for r in ledger.settled(reserves, done, "ref").collect()} == {"r1": (10, True), "r2": (None, False)}  # 70 is refused, as it is over the reserve
    own = spark.createDataFrame([("collect", "*", 99)], "job_kind string, connector string, cents long")
    asked = spark.createDataFrame([("collect", "x"), ("scrape", "web.fetch"), ("scrape", "other")], "job_kind string, connector string")
    assert {(r.job_kind, r.connector): r.est_cents for r in ledger.priced(asked, ledger.price_cards(spark, own)).collect()} == {("collect", "x"): 99, ("scrape", "web.fetch"): 0, ("scrape", "other"): None}


def test_robots(spark):
    pages = spark.createDataFrame([(1, "https://a.com/x"), (2, "https://a.com/private/y"), (3, "http://a.com/x"), (4, "https://b.com/x"), (5, "https://c.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([("https://a.com", 200, "User-agent: *\nDisallow: /private/"), ("https://b.com", 404, None), ("https://c.com", 500, None)], "origin string, status int, body string")
    assert {r.page_id: r.allowed for r in robots.with_permission(pages, rules, "url").collect()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    f = spark.createDataFrame([(200, "text/html", 5), (302, "text/html", 5), (404, "text/html", 5), (200, "image/png", 5), (200, "text/plain", 50)], "s int, c string, n long")
    assert [r.x for r in f.select(robots.fetched_text(F.col("s"), F.col("c"), F.col("n"), 10).alias("x")).collect()] == ["ok", "redirect", "status", "type", "size"]
    a = spark.createDataFrame([("h", "8.8.8.8"), ("h", "10.0.0.1"), ("g", "8.8.8.8")], "host string, ip string")
    assert {r.host: r.public for r in robots.all_public(a, "host", "ip").collect()} == {"h": False, "g": True}


def test_verification(spark):
    sha = "a" * 64
    captures = spark.createDataFrame([(1, "p1", sha), (2, "p2", sha), (3, "p3", None), (4, "p4", sha)], "capture_id long, path string, content_sha256 string")
    objects = spark.createDataFrame([("p1", sha), ("p2", "b" * 64), ("p3", sha)], "path string, sha256 string")
    evidence = spark.createDataFrame([("s", 1, 1, "a b c", "b"), ("s", 2, 2, "a", "a"), ("s", 3, 3, "a", "a"), ("s", 4, 4, "a", "a"), ("s", 5, 1, "a b", "z"), ("s", 6, 1, None, "z"), ("s", 7, 1, "q", "q")], "store string, evidence_id long, capture_id long, text string, quote string")
    labels = spark.createDataFrame([(1, '{"verdict":"supported","rationale":"r"}'), (7, '{"verdict":"ambiguous","rationale":"r"}')], "evidence_id long, response string")
    results, tally, verdicts = flows.verify_flow(evidence, captures, objects, labels, "store", 100)
    assert {r.evidence_id: r.result for r in results.collect()} == {1: "supported", 2: "integrity_failed", 3: "unauthenticatable", 4: "integrity_failed", 5: "unsupported", 6: "abstained", 7: "abstained"}
    row = tally.first()
    assert (row.pending, row.supported, row.unsupported, row.abstained, row.integrity_failed, row.unauthenticatable) == (0, 1, 1, 2, 2, 1)
    assert {r.capture_id: r.verification_status for r in verdicts.collect()} == {1: "mixed", 2: "failed", 3: "failed", 4: "failed"}
    assert set(verify.RESULTS) >= {r.result for r in results.collect()}


def test_nested_ads(spark):
    raw = [
        {"ad_archive_id": "1", "start_date": 86400, "snapshot": {"display_format": "IMAGE", "body": {"text": "b"}, "images": [{"resized_image_url": "i1"}, {"resized_image_url": "i2"}]}},
        {"ad_archive_id": "2", "snapshot": {"display_format": "DCO", "cards": [{"resized_image_url": "c1", "body": "x"}, {"resized_image_url": None, "body": "y"}, {"resized_image_url": "c3", "body": ""}, {"resized_image_url": "c4", "body": "z"}]}},
        {"ad_archive_id": "3", "snapshot": {"display_format": "CAROUSEL"}}, {"ad_archive_id": None, "snapshot": {"display_format": "IMAGE"}},
        {"ad_archive_id": "4", "snapshot": {"display_format": "VIDEO", "body": {"text": "v"}, "videos": []}}, {"ad_archive_id": "5", "snapshot": {"display_format": "VIDEO", "body": {"text": "v"}, "videos": [{"video_sd_url": "u"}]}},
    ]
    df = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(raw)], "pos long, j string").select("pos", F.from_json("j", ads.AD).alias("ad"))
    got = [(r.ad_id, r.media_url, r.body) for r in ads.flat_ads(df, "ad", ["pos"]).orderBy("pos", "card").collect()]
    assert got == [("1", "i1", "b"), ("2", "c1", "x"), ("2", "c4", "z"), ("5", "u", "v")]
    assert "effective_status" in ads.flat_ads(df, "ad", ["pos"], trim=False).columns


def test_counts_read_each_page_once(spark):
    """One pass of Python over the pages for both kinds, merged in whatever its estimated size."""
    captures = spark.createDataFrame([("c", "<p>Free\u200b  returns</p>"), ("d", None)], "capture_id string, html string")
    answer = {"quotes": [], "findings": [{"fact_type": "policy", "statement": "s", "detail": "", "evidence": e, "confidence": "low"} for e in ("Free returns", "Free", "no")]}
    counts = flows.collect_flow(captures, spark.createDataFrame([(c, json.dumps(answer)) for c in "cde"], "capture_id string, response string"))[2]
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Broadcast" not in plan
    assert {(r.capture_id, r.kind): (r.minted, r.rejected) for r in counts.collect()} == {("c", "findings"): (2, 1), ("d", "findings"): (0, 3), ("e", "findings"): (0, 3)}


def test_flows(spark):
    page = '<div class="jdgm-rev">Fits like a dream</div><p>Free returns for all</p>'
    captures = spark.createDataFrame([("c", page)], "capture_id string, html string")
    answer = {"quotes": [{"quote": "Fits like a dream", "type": "desire", "theme": "fit", "product_area": "", "confidence": "high"}, {"quote": "Free returns", "type": "desire", "theme": "", "product_area": "", "confidence": "high"}, {"quote": "Fits", "type": "nope", "theme": "", "product_area": "", "confidence": "high"}], "findings": [{"fact_type": "policy", "statement": "s", "detail": "", "evidence": "Free returns", "confidence": "low"}]}
    quotes, findings, counts = flows.collect_flow(captures, spark.createDataFrame([("c", json.dumps(answer))], "capture_id string, response string"))
    assert [r.admitted for r in quotes.orderBy("pos").collect()] == [True, False, False] and findings.first().admitted
    assert {r.kind: (r.minted, r.rejected) for r in counts.collect()} == {"quotes": (1, 2), "findings": (1, 0)}
    evidence = spark.createDataFrame([("s", "voc", str(i)) for i in range(9)], "store_id string, evidence_kind string, evidence_id string")
    voc = spark.createDataFrame([("s", str(i), "fit", "desire") for i in range(9)], "store_id string, evidence_id string, theme string, type string")
    draft = {"title": "T", "pains": [{"theme": "fit", "summary": "x", "evidence_refs": [{"kind": "voc", "id": str(i)} for i in (1, 2, 3, 4, 5, 1, 77)]}, {"theme": "made up", "summary": "y", "evidence_refs": [{"kind": "voc", "id": "99"}]}]}
    rows = flows.voc_flow(voc, evidence, spark.createDataFrame([("s", json.dumps(draft))], "store_id string, response string")).collect()
    assert [(r.theme, r.refs, r.confidence, r.thin_data, r.status) for r in rows] == [("fit", "voc:1,voc:2,voc:3,voc:4,voc:5", "high", False, "draft")]
    registry = spark.createDataFrame([("fit", "Fit", "", "active"), ("night", "Night", "", "active")], "angle_key string, label string, definition string, status string")
    fallback = spark.createDataFrame([("unmapped", "Unmapped", "")], "angle_key string, label string, definition string")
    rollup = spark.createDataFrame([("r1", "fit", 4, 9)], "id string, angle_key string, competitor_count long, total_count long")
    rollup = rollup.withColumn("batch_id", F.lit(1))
    header = spark.createDataFrame([(1, 0, 6)], "batch_id long, coverage_gap long, with_observations long")
    white = {"candidates": [{"angle_key": k, "summary": s} for k, s in (("night", "few do this"), ("night", "again"), ("fit", "two brands"), ("unmapped", "x"), ("zzz", "x"))]}
    answers = spark.createDataFrame([(1, json.dumps(white))], "batch_id long, response string")
    out, refs = flows.whitespace_flow(registry, fallback, header, rollup, answers)
    assert [(r.angle_key, r.summary, r.competitor_count, r.has_rollup_row, r.confidence, r.thin_data) for r in out.collect()] == [("night", "few do this", 0, False, "high", False)]
    assert sorted((r.kind, r.id) for r in refs.collect()) == [("batch", "1"), ("row", "r1")]
    with pytest.raises(Exception, match="no header for batch 2"):
        flows.whitespace_flow(registry, fallback, header, rollup, answers.withColumn("batch_id", F.lit(2).cast("long")))[0].collect()
    many = {"title": "T", "pains": [{"theme": "fit", "summary": "x", "evidence_refs": [{"kind": "voc", "id": str(i)} for i in range(201)]}]}
    pool = spark.range(300).select(F.lit("s").alias("store_id"), F.lit("voc").alias("evidence_kind"), F.col("id").cast("string").alias("evidence_id"))
    assert flows.voc_flow(voc, pool, spark.createDataFrame([("s", json.dumps(many))], "store_id string, response string")).count() == 0
    pages = spark.createDataFrame([(1, "https://a.com/1", "<p>x</p>"), (2, "https://a.com/2", "<p>y</p>"), (3, "https://a.com/3", "<p>z</p>")], "page_id long, url string, html string")
    allow = spark.createDataFrame([("https://a.com", 404, None)], "origin string, status int, body string")
    stored = pages.where("page_id = 1").select(F.sha2(F.lit("x"), 256).alias("content_sha256"), F.col("url").alias("source_url"))
    assert [r.page_id for r in flows.web_flow(pages, allow, stored, 2).collect()] == [2]
    pulled = spark.createDataFrame([(i, f"ad{i % 40}", "2024-01-01", None, "u", "VIDEO" if i % 2 else "IMAGE") for i in range(80)], "pos long, ad_id string, start_date string, end_date string, media_url string, media_type string")
    pulled = pulled.withColumn("start_date", F.col("start_date").cast("timestamp")).withColumn("end_date", F.col("end_date").cast("timestamp"))
    unique, sample, images = flows.ads_flow(pulled, F.lit("2024-02-01").cast("timestamp"))
    assert (unique.count(), sample.count(), images.count()) == (40, 30, 8)
    fetches = spark.createDataFrame([("u", "status")], "media_url string, outcome string")
    assert flows.ads_flow(pulled, F.lit("2024-02-01").cast("timestamp"), fetches=fetches)[2].count() == 0


def test_reserve_layers(spark):
    calls = spark.createDataFrame([(1, "r1", 1, 0, "collect", "x"), (1, "r2", 2, 1, "verify", "x"), (1, "r3", 3, 2, "collect", "x"), (1, "r1", 4, 4000, "collect", "x"), (1, "r4", 5, 8000, "scrape", "other"), (1, "r5", 6, 12_000, "synthesize", "x")], "project long, ref string, call long, seconds long, job_kind string, connector string")
    got = sorted((r.ref, r.outcome) for r in flows.reserve_flow(calls, ledger.price_cards(spark), 100, 2, 10).collect())
    assert got == [("r1", "ok"), ("r1", "skip"), ("r2", "ok"), ("r3", "blocked"), ("r4", "unpriced"), ("r5", "refused")]


def test_rates_and_retries(spark):
    rates = ledger.rate_table(spark)
    model = next(iter(ledger.MODEL_RATES))
    calls = spark.createDataFrame([(model, 1_000_000, 0)], "model string, i long, o long")
    assert ledger.rated(calls, rates, "model", "i", "o").first().actual_cents == 300
    with pytest.raises(Exception, match="no rate for model nobody"):
        ledger.rated(calls.withColumn("model", F.lit("nobody")), rates, "model", "i", "o").collect()
    tries = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("b", 0, False), ("b", 1, False), ("b", 2, False), ("b", 3, True), ("c", 0, True)], "ref string, attempt long, ok boolean")
    assert {r.ref: (r.attempts, r.settled) for r in ledger.settled_with_retries(tries, "ref", "attempt", "ok").collect()} == {"a": (2, True), "b": (3, False), "c": (1, True)}


def test_outcomes_are_recorded_once(spark):
    members = spark.createDataFrame([(1, "pending", "ok"), (2, "supported", "ok"), (3, "pending", "integrity_failed"), (4, "pending", "ok")], "m long, result string, integrity string")
    outcomes = spark.createDataFrame([(1, "unsupported", 2), (1, "supported", 1), (2, "unsupported", 1), (3, "supported", 1), (4, "no such result", 1)], "m long, outcome string, pos long")
    assert {r.m: r.result for r in verify.recorded(members, outcomes, "m", "pos").collect()} == {1: "supported", 2: "supported", 3: "pending", 4: "pending"}


def test_cache_and_tools(spark):
    media = spark.createDataFrame([("u1", "h1", "image", 10, "a1", "B", True, "Red,blue", "2024-01-05", "2024-01-01", None, True), ("u2", "h2", "video", 20, None, "B", None, "green", "2024-01-06", "2024-03-01", 3.0, True), ("u3", "h3", "video", 30, "a3", "C", False, None, "2024-01-07", "2024-03-01", 5.0, False)], "url string, url_hash string, media_type string, file_size long, analysis string, brand_name string, has_people boolean, dominant_colors string, last_accessed string, downloaded_at string, duration_seconds double, file_there boolean").withColumn("downloaded_at", F.col("downloaded_at").cast("timestamp"))
    got = {r.scope: r for r in tools.get_cache_stats(media)["results"].collect()}
    assert (got["all"].total, got["all"].analysed, got["all"].brands, got["video"].avg_duration) == (3, 2, 2, 4.0)
    assert cache.stats(media.limit(0), "media_type", "file_size", F.col("analysis").isNotNull(), "brand_name").first().total_bytes == 0
    assert [r.url for r in tools.search_cached_media(media, color_contains="RED")["results"].collect()] == ["u1"]
    assert [r.url for r in tools.search_cached_media(media, limit=2)["results"].collect()] == ["u3", "u2"]
    odd = spark.createDataFrame([("a", "ÉCLAIR 5%"), ("b", "éclair"), ("c", None), ("d", "x\\y")], "k string, c string")
    found = lambda t: sorted(r.k for r in cache.search(odd, colour=("c", t)).collect())
    assert (found("CLAIR"), found("é"), found("é_LAIR"), found("x\\Y"), found("%")) == (["a", "b"], ["b"], ["b"], ["d"], ["a", "b", "d"])
    assert tools.search_cached_media(media, has_people=False)["results"].count() == 1 and tools.search_cached_images(media)["results"].count() == 1
    assert tools.search_cached_media(media, media_type="audio")["success"] is False
    assert tools.cleanup_media_cache(media, "2024-03-02 00:00:00")["results"].count() == 2 and not tools.cleanup_media_cache(media, "2024-03-02", 0)["success"]
    answers = spark.createDataFrame([("u2", "new"), ("u3", "new3")], "url string, analysis string")
    out = tools.analyze_ad_videos_batch(media, answers, ["u3", "u2", "u9"], ad_ids=["x", "y", "z"])
    assert {r.url: (r.origin, r.ad_id) for r in out["results"].collect()} == {"u3": ("batch", "x"), "u2": ("batch", "y"), "u9": ("missing", "z")} and out["tokens_saved"] == 2 * 880
    assert not tools.analyze_ad_videos_batch(media, answers, ["u1"], ad_ids=[])["success"]
    found = spark.createDataFrame([("Nike", json.dumps({"searchResults": [{"name": "Nike", "page_id": "1"}, {"name": "Nike", "page_id": "2"}, {"name": "X", "page_id": None}]}))], "brand string, body string")
    pages = tools.get_meta_platform_id(found, ["Nike", "Nike", "Other"])
    assert {r.brand: r.pages for r in pages["results"].collect()} == {"Nike": {"Nike": "2"}, "Other": {}} and pages["batch_info"]["successful"] == 1
    assert not tools.get_meta_platform_id(found, " ")["success"]
    image = json.dumps({"ad_archive_id": "1", "snapshot": {"display_format": "IMAGE", "body": {"text": "b"}, "images": [{"resized_image_url": "i"}]}})
    scan = spark.createDataFrame([("p", "DE", 0, image, False), ("p", "DE", 1, image, False), ("p", "DE", 2, image, True)], "page_id string, country string, page_no long, j string, failed boolean").select("page_id", "country", "page_no", F.array(F.from_json("j", ads.AD)).alias("ads"), "failed")
    got = tools.get_meta_ads(scan, "p", 5, "de")
    assert got["results"].count() == 2 and got["results"].first().is_partial and not tools.get_meta_ads(scan, "p", 0)["success"] and not tools.get_meta_ads(scan, "p", 5, "deu")["success"]


def test_state_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/calls"
    assert state.load_calls(spark, path).count() == 0
    state.save_calls(spark.createDataFrame([(1, 0.0), (1, 90_000.0)], "key long, seconds double"), path)
    row = state.recent(state.load_calls(spark, path), 90_010.0).first()
    assert (row.in_hour, row.in_day) == (1, 1)
    again = state.load_calls(spark, path)
    state.save_calls(again.unionByName(spark.createDataFrame([(2, 5.0)], "key long, seconds double")), path)  # reads and replaces the same state
    assert state.load_calls(spark, path).count() == 3


def test_a_save_that_is_cut_off_leaves_the_old_state(spark, tmp_path):
    path = f"file://{tmp_path}/calls"
    state.save_calls(spark.createDataFrame([(1, 1.0)], "key long, seconds double"), path)
    with pytest.raises(Exception, match="broken"):
        state.save_calls(spark.range(1).select(F.col("id").alias("key"), F.raise_error(F.lit("broken")).cast("double").alias("seconds")), path)
    assert state.load_calls(spark, path).count() == 1 and {"calls"} <= {p.name for p in tmp_path.iterdir()} and not (tmp_path / "calls.old").exists()  # a task that is still running may leave files beside it
    (tmp_path / "calls").rename(tmp_path / "calls.old")  # as a crash between the two renames would leave it
    assert state.load_calls(spark, path).count() == 1
    state.save_calls(spark.createDataFrame([(3, 3.0), (4, 4.0)], "key long, seconds double"), path)
    assert state.load_calls(spark, path).count() == 2
    (tmp_path / "calls" / "x.json").write_text("{broken")
    with pytest.raises(Exception):  # noqa: B017
        state.load_calls(spark, path).collect()


def test_a_refusal_aborts_the_batch(spark):
    ok = json.dumps({"searchResults": [{"name": "A", "page_id": "1"}]})
    rows = spark.createDataFrame([("A", ok, 200), ("B", "out of credits", 403), ("C", "x", 500)], "brand string, body string, status int")
    assert not tools.get_meta_platform_id(rows, ["A", "B"])["success"] and tools.get_meta_platform_id(rows, ["A", "C"])["success"]


def test_snapshots_follow_from_their_contents(spark):
    def ids(rows, schema="entity string, ad_id string, cents long"):
        return {r.entity: r.snapshot_id for r in snapshots.taken(spark.createDataFrame(rows, schema).repartition(3), "entity", F.lit(1))[0].collect()}

    ads = lambda entity, *numbers: [(entity, f"ad{n}", n) for n in numbers]
    one = ids(ads("e", 1, 2, 5, 8))["e"]
    assert one == ids(ads("e", 8, 1, 5, 2))["e"] != ids(ads("e", 1, 3, 4, 8))["e"] and ids(ads("x", 1, 2, 5, 8))["x"] != one
    assert len({ids(ads("e", 1, 2))["e"], ids(ads("e", 1, 2, 2))["e"], ids([("e", "ad1", 1), ("e", "ad2", None)])["e"], ids([("e", "ad1", 1), ("e", None, 2)])["e"], ids([("e", "ad12", 1), ("e", "", 2)])["e"]}) == 5
    parts = [snapshots.digests(spark.createDataFrame(ads("e", *n), "entity string, ad_id string, cents long"), "entity", ["ad_id", "cents"]) for n in ((1, 2), (5,), (8,))]
    whole = snapshots.digests(spark.createDataFrame(ads("e", 1, 2, 5, 8), "entity string, ad_id string, cents long"), "entity", ["ad_id", "cents"])
    assert snapshots.merged(parts, "entity").collect() == whole.collect()


def test_snapshots_are_appended(spark):
    df = lambda rows: spark.createDataFrame(rows, "entity string, ad_id string, cents long")
    first = snapshots.taken(df([("a", "1", 5), ("a", "2", 6), ("b", "3", 7), (None, "4", 8)]), "entity", F.lit(10))
    again = snapshots.taken(df([("b", "3", 7), ("a", "2", 6), ("a", "1", 9), (None, "4", 8)]), "entity", F.lit(20))
    assert {(r.entity, r.ad_count) for r in first[0].collect()} == {("a", 2), ("b", 1), (None, 1)} and first[1].count() == 4
    headers, rows = snapshots.appended(*first, *again)
    assert {(r.entity, r.taken_at) for r in headers.collect()} == {("a", 20), ("b", 20), (None, 20)}
    assert {(r.entity, r.ad_id, r.cents) for r in rows.collect()} == {("a", "1", 9), ("a", "2", 6)}
    same = snapshots.appended(*first, *first)
    assert same[0].count() == 0 == same[1].count()
    cited = first[0].join(df([("a", "1", 0), ("a", "3", 0), ("b", "3", 0)]).select("entity", "ad_id"), "entity").select("entity", "snapshot_id", "ad_id")
    assert {(r.entity, r.ad_id): r.known for r in snapshots.cited_in(cited, first[1], "ad_id").collect()} == {("a", "1"): True, ("a", "3"): False, ("b", "3"): True}


def hot(spark, n, span, seed=1):
    """n rows, nine tenths of one key."""
    rng = random.Random(seed)
    return spark.createDataFrame([(7 if rng.random() < 0.9 else rng.randrange(5), i, rng.randrange(span), rng.randrange(-3, 9)) for i in range(n)], "k long, i long, s long, v long").repartition(4)


def test_rolling_counts_of_a_hot_key(spark):
    rows = hot(spark, 3000, 6 * 86_400)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # tasks as they are dealt
    try:
        for size in (86_400, 40_000, 7200, 200_000):
            out = limits.rolling_counts(rows, "k", "s", size)
            got = {r.i: (r.in_hour, r.in_day) for r in out.collect()}
            if size == 7200:
                per_task = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    given = rows.collect()
    times = {}
    for r in given:
        times.setdefault(r.k, []).append(r.s)
    assert got == {r.i: tuple(sum(r.s - w <= t <= r.s for t in times[r.k]) for w in (3600, 86_400)) for r in given}
    assert max(per_task) < 0.5 * len(given) and len(per_task) == 4
    odd = spark.createDataFrame([(None, 1, 5), (None, 2, None), (1, 3, None)], "k long, i long, s long")
    assert {r.i for r in limits.rolling_counts(odd, "k", "s").collect()} == {1, 2, 3}


def test_prefix_sums_of_a_hot_key(spark):
    rows = hot(spark, 3000, 900)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = prefix.sliced(rows, ["k"], ["s", "i"])
        sums = prefix.prefix_sums(cut, ["k"], ["s", "i"], {"run": F.col("v"), "n": F.lit(1)})
        got = {r.i: (r.run, r.n, r.mark) for r in prefix.last_before(sums, ["k"], ["s", "i"], "mark", F.when(F.col("v") == 8, F.col("i"))).collect()}
        slices = cut.where("k = 7").groupBy("_slice").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, state = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.k, r.s, r.i)):
        run, n, mark = state.get(r.k, (0, 0, None))
        want[r.i] = (run + r.v, n + 1, mark)
        state[r.k] = (run + r.v, n + 1, r.i if r.v == 8 else mark)
    assert got == want and len(slices) >= 3 and max(r["count"] for r in slices) < 1500
    flushes = sorted((r.flush_no, r.n, r.first, r.last) for r in pick.buffer_flushes(rows, "s", "i", 25).collect())
    ordered = [r.i for r in sorted(rows.collect(), key=lambda r: (r.s, r.i))]
    assert flushes == [(j, 25, min(ordered[25 * j :][:25]), max(ordered[25 * j :][:25])) for j in range(120)]
    empty = ledger.running_costs(rows.limit(0), "k", ["s", "i"], "v", F.lit(True))
    assert empty.columns == ["k", "i", "s", "v", "running", "drained"] and empty.count() == 0


def test_reservations_without_cost(spark):
    rng = random.Random(2)
    calls = [(rng.randrange(2), rng.randrange(300), f"r{rng.randrange(40)}", rng.choice([0, 3, 5, None]), rng.random() < 0.2) for _ in range(400)]
    calls = list({(p, t, r, e): b for p, t, r, e, b in calls}.items())
    calls = [(*k, b) for k, b in calls]
    df = spark.createDataFrame(calls, "project long, at long, ref string, est long, blocked boolean")
    got = sorted((r.project, r.ref, r.outcome) for r in ledger.reserve_fold(df, "project", "ref", "at", "est", 9).collect())
    want, state = [], {}
    for p, t, r, e, b in sorted(calls, key=lambda c: (c[0], c[1], c[2], -1 if c[3] is None else c[3])):
        total, held = state.setdefault(p, [0, set()])
        outcome = "skip" if r in held else "blocked" if b else "unpriced" if e is None else "refused" if total + e > 9 else "ok"
        if outcome == "ok":
            state[p][0] += e
            held.add(r)
        want.append((p, r, outcome))
    assert got == sorted(want) and {"ok", "skip", "refused", "blocked", "unpriced"} == {w[2] for w in want}


def test_admissions_are_linear(spark):
    rows = spark.range(60_000).selectExpr("1L as k", "id", "id div 100 as s")
    began = time.time()
    out = limits.admissions(rows, "k", "s", "id", 1_000_000, 1_000_000)
    assert out.where("admitted").count() == 60_000 and time.time() - began < 20


def test_rollups_by_signed_changes_equal_a_rebuild(spark):
    rng = random.Random(4)
    counters = {"n": F.lit(1), "good": F.col("good")}
    schema = "k string, who long, good long"
    rows, references, rollup = [], None, None
    for step in range(4):
        came = [(rng.choice(["a", "b", None]), rng.randrange(4), rng.randrange(2)) for _ in range(12)]
        went = [rows.pop(rng.randrange(len(rows))) for _ in range(len(rows) if step == 3 else len(rows) // 2)]
        rows += came if step < 3 else []
        changes = rollups.signed(spark.createDataFrame(came if step < 3 else [], schema), spark.createDataFrame(went, schema))
        references, rollup = (materialise(x, "x") for x in rollups.entities_applied(references, rollup, changes, ["k"], "who", "whos", counters))
        want = {}
        for k, who, good in rows:
            w = want.setdefault(k, [set(), 0, 0])
            w[0].add(who), w.__setitem__(1, w[1] + 1), w.__setitem__(2, w[2] + good)
        assert {r.k: (r.whos, r.n, r.good) for r in rollup.collect()} == {k: (len(w[0]), w[1], w[2]) for k, w in want.items()}
    assert rollup.count() == 0 == references.count()
    with pytest.raises(Exception, match="more went than was there"):
        rollups.applied(rollup.select("k", "n"), rollups.signed(went=spark.createDataFrame([("z",)], "k string")), ["k"], {"n": F.lit(1)}).collect()


def test_later_analyses_replace_earlier_ones(spark):
    df = lambda rows: spark.createDataFrame(rows, "who string, at long, id long, ok boolean")
    current = df([("a", 5, 1, True), ("b", 5, 2, True)])
    new = df([("a", 4, 9, True), ("b", 6, 3, False), ("b", 5, 4, True), ("c", 1, 5, True), ("c", 1, 6, True)])
    latest, changes = rollups.replaced_latest(current, new, "who", "at", "id", F.col("ok"))
    assert {(r.who, r.id) for r in latest.collect()} == {("a", 1), ("b", 4), ("c", 6)}
    assert {(r.who, r.id, r["_sign"]) for r in changes.collect()} == {("b", 2, -1), ("b", 4, 1), ("c", 6, 1)}
