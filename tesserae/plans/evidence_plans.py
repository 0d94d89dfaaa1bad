"""Queries over texts: grounding, hashes, pages, verification, rendering."""

from pyspark.sql import functions as F

from tesserae.functions import html, text, urls
from tesserae.operators import grounding, limits, pick, verify
from tesserae.plans import flows
from tesserae.plans.registry import query
from tesserae.sources import table

#: DuckDB's form of the engine's normal form: the same characters, the same order.
_SPACE = r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NORMAL = lambda c: f"regexp_replace(regexp_replace(translate({c}, chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8203) || chr(8204) || chr(8205) || chr(65279), '''''\"\"'), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"""WITH q AS (SELECT item_id, {_NORMAL("text")} AS quote FROM benchmark), t AS (SELECT doc_id, {_NORMAL("text")} AS body FROM documents)
SELECT item_id, doc_id FROM q JOIN t ON quote <> '' AND contains(body, quote)""")
def verbatim_grounding(spark, sf_dir):
    """Which documents contain which benchmark texts word for word."""
    return grounding.containing(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


_QUOTE = "CASE doc_id % 4 WHEN 0 THEN substring(text, 11, 40) WHEN 1 THEN '  ' || substring(text, 1, 30) || ' ' WHEN 2 THEN upper(substring(text, 5, 30)) ELSE '' END"


@query(f"""WITH c AS (SELECT doc_id, source, text, {_QUOTE} AS quote FROM documents)
SELECT source, count(*) FILTER (WHERE {_NORMAL("quote")} <> '' AND contains({_NORMAL("text")}, {_NORMAL("quote")})) AS minted,
count(*) FILTER (WHERE NOT ({_NORMAL("quote")} <> '' AND contains({_NORMAL("text")}, {_NORMAL("quote")}))) AS rejected,
sum(CASE WHEN quote <> '' AND instr(text, quote) > 0 THEN instr(text, quote) - 1 END)::BIGINT AS starts FROM c GROUP BY 1""")
def admission_counts(spark, sf_dir):
    """Candidates that are in their own text and those that are not, by source, and the sum of the spans' starts."""
    docs = table(spark, sf_dir, "documents")
    candidates = docs.select("doc_id", "source", F.expr(_QUOTE).alias("quote"))
    out = grounding.admit(candidates, docs.select("doc_id", "text"), "doc_id", "quote", "text")
    return out.groupBy("source").agg(F.count(F.when(F.col("admitted"), 1)).alias("minted"), F.count(F.when(~F.col("admitted"), 1)).alias("rejected"), F.sum("source_start").alias("starts"))


@query("""WITH m AS (SELECT lang, CASE WHEN doc_id % 10 = 0 THEN 'unauthenticatable' WHEN doc_id % 10 = 1 THEN 'integrity_failed' WHEN text = '' OR doc_id % 10 = 2 THEN 'abstained'
  WHEN doc_id % 10 = 3 THEN 'unsupported' WHEN quality = 1 THEN 'supported' WHEN quality = 0 THEN 'unsupported' ELSE 'abstained' END AS result FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, count(*) FILTER (WHERE result = 'pending') AS pending, count(*) FILTER (WHERE result = 'supported') AS supported, count(*) FILTER (WHERE result = 'unsupported') AS unsupported,
count(*) FILTER (WHERE result = 'abstained') AS abstained, count(*) FILTER (WHERE result = 'integrity_failed') AS integrity_failed, count(*) FILTER (WHERE result = 'unauthenticatable') AS unauthenticatable FROM m GROUP BY 1""")
def verdict_tally(spark, sf_dir):
    """Integrity, grounding and labels of every member, tallied with zeros."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    sha = F.sha2("text", 256)
    captures = docs.select(F.col("doc_id").alias("capture_id"), F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 10 != 0, sha).alias("content_sha256"))
    objects = docs.where("doc_id % 10 <> 1").select(F.col("doc_id").cast("string").alias("path"), sha.alias("sha256"))
    quote = F.when(F.col("doc_id") % 10 == 2, "").when(F.col("doc_id") % 10 == 3, "no text has this sentence at all").otherwise(F.regexp_extract("text", r"(\S+)", 1))
    members = docs.select("lang", F.col("doc_id").alias("capture_id"), F.col("doc_id").alias("evidence_id"), "text", quote.alias("quote"))
    checked = verify.integrity(members, captures, objects)
    verdicts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("evidence_id"), F.when(F.col("quality") == 1, "supported").otherwise("unsupported").alias("verdict"))
    return verify.tally(verify.outcomes(checked, verdicts), ["lang"])


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, left(sha256(text), 16) AS short_sha, 'captures/' || sha256(text) || '.html' AS path FROM documents")
def content_hash(spark, sf_dir):
    """Identities of contents."""
    sha = F.sha2("text", 256)
    return table(spark, sf_dir, "documents").select("doc_id", sha.alias("sha256"), F.md5("text").alias("md5"), F.substring(sha, 1, 16).alias("short_sha"), urls.content_path(sha).alias("path"))


#: DuckDB's form of the text of regular pages: hidden elements, comments and declarations, tags, the entities that occur.
_DROPPED = lambda c, tag: f"regexp_replace({c}, '<{tag}[^>]*>.*?</{tag}>', ' ', 'gs')"
_READ = lambda c: (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace("
    + _DROPPED(_DROPPED(_DROPPED(_DROPPED(c, "script"), "style"), "noscript"), "template")
    + r", '<!--.*?-->', ' ', 'gs'), '<![^>]*>', '', 'g'), '</?[a-zA-Z][^>]*>', ' ', 'g'), '&middot;', chr(183)), '&copy;', chr(169)), "
    + r"""'&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#39;', chr(39), 'g'), '&amp;?', '&', 'g')"""
)
_PAGE = lambda c: f"trim(regexp_replace({_READ(c)}, '{_SPACE}+', ' ', 'g'))"
_HOST, _ORIGIN = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))", "regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"


@query(f"""WITH p AS (SELECT page_id, url, html, {_HOST} AS host, {_ORIGIN} AS origin, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^#]*)?', 1) AS path FROM pages),
a AS (SELECT *, CASE length(origin) % 4 WHEN 0 THEN true WHEN 1 THEN NOT starts_with(path, '/en/1') WHEN 2 THEN true ELSE false END AS allowed FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS ordinal FROM a WHERE allowed QUALIFY ordinal <= 40),
r AS (SELECT *, {_PAGE("html")} AS text FROM t), s AS (SELECT sha256({_PAGE("html")}) AS sha, url FROM pages WHERE page_id % 7 = 0),
n AS (SELECT page_id, url, host, ordinal, sha256(html) AS raw_html_sha256, sha256(text) AS content_sha256, length(text) AS text_chars FROM r)
SELECT *, 0 AS review_chars, 'captures/' || content_sha256 || '.html' AS captured_html_path, 'captures/' || content_sha256 || '.txt' AS text_path, 'text@v2' AS extractor_version
FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.sha = content_sha256 AND s.url = n.url) QUALIFY row_number() OVER (PARTITION BY content_sha256, url ORDER BY page_id) = 1""")
def capture_pipeline(spark, sf_dir):
    """Planned pages to captures: robots, a cap for each host, both texts in one pass, two hashes, and nothing stored twice."""
    pages = table(spark, sf_dir, "pages")
    origins = pages.select(urls.canonical_origin(F.col("url")).alias("origin")).distinct()
    kind = F.length("origin") % 4
    robots_rules = origins.withColumn("status", F.when(kind == 0, 404).when(kind == 3, 500).otherwise(200)).withColumn("body", F.when(kind == 1, "User-agent: *\nDisallow: /en/1").when(kind == 2, ""))
    stored = pages.where("page_id % 7 = 0").select(F.sha2(html.canonical_text(F.col("html")), 256).alias("content_sha256"), F.col("url").alias("source_url"))
    found = flows.web_flow(pages, robots_rules, stored).withColumn("extractor_version", F.lit(html.EXTRACTOR_VERSION))
    return found.select("page_id", "url", "host", F.col("ordinal").cast("long"), "raw_html_sha256", "content_sha256", F.length("text").cast("long").alias("text_chars"), F.length("reviews").alias("review_chars"), "captured_html_path", "text_path", "extractor_version")


@query("""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)
SELECT page_id, host, ordinal FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS ordinal FROM h) WHERE ordinal <= 8""")
def host_page_cap(spark, sf_dir):
    """The first pages of each host."""
    pages = table(spark, sf_dir, "pages").select("page_id", urls.canonical_host(F.col("url")).alias("host"))
    return limits.capped_pages(pages, "host", [F.col("page_id")], 8).select("page_id", "host", F.col("ordinal").cast("long"))


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^([a-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) || '/robots.txt' AS robots,
md5(url) AS url_key, regexp_extract(url, '^([a-z]+)://', 1) IN ('http', 'https') AS fetchable FROM pages""")
def url_parts(spark, sf_dir):
    """Canonical hosts, robots addresses and cache keys."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_host(u).alias("host"), urls.robots_url(u).alias("robots"), urls.url_key(u).alias("url_key"), urls.is_fetchable(u).alias("fetchable"))


@query("""SELECT conv_id, string_agg(role || ': ' || left(text, 60), chr(10) ORDER BY turn) FILTER (WHERE turn_rank <= 4) AS prompt, count(*) AS turns
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS turn_rank FROM conversations) GROUP BY 1""")
def prompt_render(spark, sf_dir):
    """The first turns of each conversation as one text, each clipped."""
    rows = table(spark, sf_dir, "conversations")
    line = F.concat(F.col("role"), F.lit(": "), text.clipped(F.col("text"), 60))
    order = F.struct("turn", "role", "text")
    return rows.groupBy("conv_id").agg(text.rendered(order, line, 4).alias("prompt"), F.count("*").alias("turns"))


_WORDS = "|".join(text.NUMBER_WORDS)


@query(f"""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || ' three pairs' WHEN 1 THEN text || ' pair, then' WHEN 2 THEN text || ' 42' ELSE text END AS summary FROM documents)
SELECT doc_id, regexp_matches(summary, '[0-9]') OR regexp_matches(' ' || regexp_replace(lower(summary), '[^\\p{{L}}]+', ' ', 'g') || ' ', ' ({_WORDS}) ') AS has_number FROM t""")
def number_word_filter(spark, sf_dir):
    """Summaries that state a number."""
    summary = "CASE doc_id % 5 WHEN 0 THEN text || ' three pairs' WHEN 1 THEN text || ' pair, then' WHEN 2 THEN text || ' 42' ELSE text END"
    return table(spark, sf_dir, "documents").select("doc_id", text.has_number(F.expr(summary)).alias("has_number"))


@query("""SELECT 'voc' AS evidence_kind, doc_id AS evidence_id, source AS store_id, left(text, 40) AS summary FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)
UNION ALL SELECT 'finding', item_id, 'bench', left(text, 40) FROM benchmark""")
def publishable_union(spark, sf_dir):
    """Quotes and findings under one schema."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    voc = table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select(F.lit("voc").alias("evidence_kind"), F.col("doc_id").alias("evidence_id"), F.col("source").alias("store_id"), text.clipped(F.col("text"), 40).alias("summary"))
    findings = table(spark, sf_dir, "benchmark").select(F.lit("finding").alias("evidence_kind"), F.col("item_id").alias("evidence_id"), F.lit("bench").alias("store_id"), text.clipped(F.col("text"), 40).alias("summary"))
    return voc.unionByName(findings)


@query("""SELECT conv_id, n, CASE WHEN n >= 1 THEN trim(split_part('VIDEO 1: ' || body, 'VIDEO 2:', 1)[9:]) END AS first_part,
CASE WHEN n >= 2 THEN 'second ' || conv_id ELSE 'Analysis not found in batch response for video 2' END AS second_part
FROM (SELECT conv_id, min(left(role, 4)) AS body, count(*) AS n FROM conversations GROUP BY 1)""")
def marker_split(spark, sf_dir):
    """A batch answer cut at its numbered markers."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min(F.substring("role", 1, 4)).alias("body"), F.count("*").alias("n"))
    answer = F.concat(F.lit("VIDEO 1: "), "body", F.when(F.col("n") >= 2, F.concat(F.lit("\nVIDEO 2: second "), F.col("conv_id").cast("string"))).otherwise(""))
    parts = rows.withColumn("parts", text.marked_segments(answer, 2))
    return parts.select("conv_id", "n", F.col("parts")[0].alias("first_part"), F.col("parts")[1].alias("second_part"))
