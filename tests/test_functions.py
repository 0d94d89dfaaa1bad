import hashlib
import json
import random
import re
import time
from html.parser import HTMLParser

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import html, rules, shapes, text, urls


def one(spark, expression, **columns):
    names = list(columns)
    schema = ", ".join(f"{n} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for n, v in columns.items())
    return spark.createDataFrame([tuple(columns[n] for n in names)], schema).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "wanted"), [
    ("<p>a</p><p>b</p>", "a b"), ("<td>a</td><td>b</td>", "a b"), ("x<script>var a = '<b>';</script>y", "x y"), ("a<!-- nonce 1 -->b", "a b"),
    ("&amp; &lt;b&gt; &#39;", "& <b> '"), ("<style>p{}</style><noscript>n</noscript><template>t</template>z", "z"), ("", ""), (None, ""),
    ("one<br/>two", "one two"), ("keep<!-- open and never closed <p>stays</p>", "keep<!-- open and never closed <p>stays"), ("<script>never closed <p>text</p>", ""),
    ("a&nbsp;b\n\t c", "a b c"), ("</script>after a stray end", "after a stray end"),
    ('<p>Before</p><script>var a="<!--";</script><p>Hello after</p>', "Before Hello after"), ('<p title="<!-- x">A</p><p>B</p>', "A B"), ("a<![of no kind x>b", "a b"), ("closed<!-- c -->in<!-- open", "closed in<!-- open"),
])
def test_page_text(given, wanted):
    assert html.page_text(given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [
    ('<div class="jdgm-rev x">Great <b>fit</b></div><p>copy</p>', "Great fit"), ('<div id="judgeme_w">in</div>out', "in"), ('<div class="loox-review">l</div>', "l"),
    ('<div data-oke-reviews>o</div>', "o"), ('<section class="oke-w">o2</section>', "o2"), ('<div class="content-review">y</div><div class="content-reviews">n</div>', "y"), ('<i class="yotpo-x">yy</i>', "yy"),
    ('<div class="stamped-review-a">s</div>', "s"), ('<div class="ruk_x">r</div><div class="reviewsio">r2</div>', "r r2"), ("<p>no widget</p>", ""),
    ('<div class="jdgm-rev">a<script>js</script>b<div>c</div>d</div>e', "a b c d"), ('<div class="jdgm-rev"><p>unclosed</div>after', "unclosed"), ('</div><div class="jdgm-rev">x</span>y</div>z', "x y"), (None, ""),
])
def test_review_text(given, wanted):
    assert html.page_text(given, True) == wanted


def to_size(part):
    return part * (1_000_000 // len(part))


HOSTILE = (
    *map(to_size, ("<script>", "<!--", "<!-- >", "<a ", '<a b="', "<a b='>", "<a<", "<a<b ", "<a\x00", "<a \x00<b", "</", "</a ", "<?", "<!", "<![cdata[>", "<![if>", "<![", "<", "&", "&#", "<div>", "</p>", "<a/", "<a / ", "<a b= \"x>", "<a ==", "<![CDATA[ ]", "-->", "<a " + "b=c " * 20, "<script/>", "<template>")),
    "<p>hello world</p>" + "<script>" * 50_000 + "<!--" * 50_000, "<p>ok</p>" + "<!--" * 100_000, "<!--" * 100_000 + "<p>x</p>", "<div>" * 100_000 + "</p>" * 100_000, "<div>" * 100_000 + "</div>" * 100_000,
    "<a " + 'b=">" <a ' * 100_000, "<a " + "b='>' c=\">\" <a " * 60_000, "<a" + "<a" * 300_000 + ' b=">', "<a" * 300_000 + "\x00", "<a " * 300_000 + ">", "<a b=" + " " * 900_000 + '"', "<a b" + " " * 900_000 + "c", "<!--" + "--" * 400_000 + "<p>", "<!--" + "-- " * 300_000, "<p>" * 1000 + "<div><i>" * 50_000 + "</b></p>" * 50_000,
)


@pytest.mark.parametrize("page", HOSTILE, ids=range(len(HOSTILE)))
def test_hostile_pages_stay_fast(page):
    began = time.process_time()
    found = html.read_page(page)
    assert time.process_time() - began < 2
    assert "hello world" not in page or "hello world" in found[0] and found[1] == ""


class Plain(HTMLParser):
    """The same rules on the standard library's parser, which looks for the end of each construct anew."""

    def __init__(self, widgets_only):
        super().__init__(convert_charrefs=True)
        self.widgets_only, self.found, self.hidden, self.open = widgets_only, [], 0, [("", False, False)]

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def boundary(self, *_):
        self.found.append(" ")

    handle_comment = handle_startendtag = boundary

    def handle_starttag(self, tag, attrs):
        self.boundary()
        hides = tag in html.HIDDEN
        self.hidden += hides
        _, inside, dark = self.open[-1]
        self.open.append((tag, inside or html.is_widget(attrs), dark or hides))

    def handle_endtag(self, tag):
        self.boundary()
        depth = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i][0] == tag), None)
        if depth is not None:
            del self.open[depth:]
        if tag in html.HIDDEN:
            self.hidden = max(0, self.hidden - 1)

    def handle_data(self, data):
        if (self.open[-1][1] and not self.open[-1][2]) if self.widgets_only else not self.hidden:
            self.found.append(data)


def plainly_read(page):
    out = []
    for widgets in (False, True):
        plain = Plain(widgets)
        plain.feed(page)
        plain.close()
        out.append(re.sub(r"\s+", " ", "".join(plain.found)).strip())
    return tuple(out)


MARKUP = ["<!--", "-->", "--", "-- >", ">", "/>", "<p>", "</p>", "a", " ", "\n", "\x0b", "\x00", "&amp", "&amp;", "&#6", ";", "<script>", "</script>", "</ SCRIPT >", "<script", "<style>", "</style", '<div class="yotpo-x">', "</div>", "<DIV class='x jdgm-rev&#45;'", "<i data-oke-z", "<!", "<?", "<!doctype", "<![", "<![cdata[", "]]>", "] >", "<![if x", "<![nope[", '"', "'", "=", "= ", "==", "/", "<b title='<!--'>", "<b t=", "<b ", "<b\x00", "</b ", "</", "<", "<template>", "</template>", "<br/>", "<b a = c d>", "<b'\x00c>", "</3>", "</>"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(MARKUP), max_size=30))
def test_pages_read_as_the_parser_reads_them(parts):
    assert html.read_page("".join(parts)) == plainly_read("".join(parts))


def test_pages_of_the_tables_read_as_the_parser_reads_them():
    rng = random.Random(3)
    for (page,) in duckdb.sql("select html from read_parquet('/root/testdata/sf0.001/pages.parquet') where html is not null limit 400").fetchall():
        cut = rng.randrange(len(page) + 1)
        for text in (page, page[:cut], page[cut:], page[:cut] + rng.choice(MARKUP) + page[cut:]):
            assert html.read_page(text) == plainly_read(text)


def test_udfs_in_a_frame(spark):
    df = spark.createDataFrame([("<p>a</p>b",), (None,)], "h string")
    assert [r.x for r in df.select(html.canonical_text(F.col("h")).alias("x")).collect()] == ["a b", ""]
    raw = spark.createDataFrame([(bytearray("é".encode("latin-1")), "latin-1"), (bytearray(b"\xff"), None), (bytearray("é".encode()), "no-such")], "b binary, c string")
    assert [r.x for r in raw.select(html.decoded(F.col("b"), F.col("c")).alias("x")).collect()] == ["é", "�", "é"]


@pytest.mark.parametrize(("given", "wanted"), [(" a \n b ", "a b"), ("“Hi” it’s", "\"Hi\" it's"), ("a​b﻿", "ab"), ("Case STAYS", "Case STAYS"), ("", ""), (None, ""), ("x  y\x1cz", "x y z")])
def test_normalize(spark, given, wanted):
    assert one(spark, text.normalize(F.col("s")), s=given) == wanted


def test_text_functions(spark):
    df = spark.createDataFrame([("Sophie & Olivia.com", "the cat's ‘hat’", "'hat'")], "name string, body string, part string")
    r = df.select(
        text.alnum_key(F.col("name")).alias("k"), text.slug(F.lit("  Big \t Brand ")).alias("s"), text.is_verbatim(F.col("body"), F.col("part")).alias("v"), text.is_verbatim(F.col("body"), F.lit(" ")).alias("e"),
        text.span(F.lit("abcabc"), F.lit("ca")).alias("sp"), text.span(F.lit("abc"), F.lit("x")).alias("no"), text.job_key("scrape", F.lit(None).cast("string"), F.lit(7)).alias("j"), text.attempt_key(F.lit("k"), F.lit(2)).alias("a"), text.attempt_key(F.lit("k"), F.lit(1)).alias("b"),
        text.marked_segments(F.lit("VIDEO 1: one VIDEO 3: three"), 3).alias("m"), text.joined_colours(F.array(F.lit("red"), F.lit("blue"))).alias("c"), text.joined_elements(F.create_map(F.lit("a"), F.array(F.lit("x"), F.lit("y")))).alias("t"),
    ).first()
    assert (r.k, r.s, r.v, r.e, r.no, r.j, r.a, r.b, r.c, r.t) == ("sophieoliviacom", "big-brand", True, False, None, "scrape::7", "k:a2", "k", "red,blue", "x | y")
    assert (r.sp.start, r.sp.end) == (2, 4)
    assert r.m == ["one VIDEO 3: three", "Analysis not found in batch response for video 2", "three"]


@pytest.mark.parametrize(("s", "wanted"), [("three angles", True), ("a PAIR of ads", True), ("12 ads", True), ("x²", True), ("several people", False), ("someone atone", False), ("", False), (None, False)])
def test_has_number(spark, s, wanted):
    assert one(spark, text.has_number(F.col("s")), s=s) == wanted


@pytest.mark.parametrize(("url", "host", "origin"), [
    ("https://EXAMPLE.com:443/a", "example.com", "https://example.com"), ("http://user:p@Shop.com:8443/x?y#z", "shop.com:8443", "http://shop.com:8443"), ("http://a.com:80", "a.com", "http://a.com"),
    ("https://a.com:80/", "a.com:80", "https://a.com:80"), ("http://[::1]:8080/x", "::1:8080", "http://::1:8080"),
])
def test_hosts(spark, url, host, origin):
    assert one(spark, urls.canonical_host(F.col("u")), u=url) == host
    assert one(spark, urls.canonical_origin(F.col("u")), u=url) == origin
    assert one(spark, urls.robots_url(F.col("u")), u=url) == origin + "/robots.txt"


def test_addresses_and_paths(spark):
    df = spark.createDataFrame([(a,) for a in ("8.8.8.8", "10.0.0.1", "127.0.0.1", "169.254.1.1", "::1", "224.0.0.1", "0.0.0.0", "nonsense", "2606:4700::1111")], "a string")
    assert [r.x for r in df.select(urls.is_public(F.col("a")).alias("x")).collect()] == [True, False, False, False, False, False, False, False, True]
    assert one(spark, urls.resolved(F.col("b"), F.col("t")), b="https://a.com/x/y", t="../z") == "https://a.com/z"
    assert one(spark, urls.is_fetchable(F.col("u")), u="ftp://a.com/") is False and one(spark, urls.is_fetchable(F.col("u")), u=None) is False
    assert one(spark, urls.is_text(F.col("c")), c="Text/HTML; charset=x") and not one(spark, urls.is_text(F.col("c")), c="image/png")
    assert one(spark, urls.extension(F.col("c"), F.col("m")), c="IMAGE/png", m="image") == ".png" and one(spark, urls.extension(F.col("c"), F.col("m")), c="x", m="video") == ".mp4"
    assert one(spark, F.sha2(F.col("s"), 256), s="é") == hashlib.sha256("é".encode()).hexdigest()


@pytest.mark.parametrize(("given", "wanted"), [("86400", 86400), ("86400.5", None), ("12.5", None), ("2024-05", None), ("2024-1-2", None), ("1970-01-02T00:00", 86400), ("1970-01-02 00", 86400), ("1970-01-02T00:00:00.250+00", 86400), ("1970-01-02T05:30:00+0530", 86400), ("99999999999999999999", None), ("2024-02-30", None), (1700000000.0, 1700000000), (86400, 86400), (-1.0, -1), (1e30, None), ("1970-01-02T00:00:00Z", 86400), ("1970-01-02", 86400), ("1970-01-02T01:00:00+01:00", 86400), ("soon", None), ("", None), (None, None)])
def test_moment(spark, given, wanted):
    assert one(spark, F.unix_seconds(rules.moment(F.col("s"))), s=given) == wanted


def test_rules(spark):
    c = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    t = lambda s: F.lit(s).cast("timestamp")
    assert c(rules.whole_days(t("2024-01-01 12:00:00"), t("2024-01-03 11:59:59"))) == 1 and c(rules.whole_days(t("2024-01-03"), t("2024-01-01"))) == 0
    assert c(rules.local_iso(t("2024-01-02 03:04:05"))) == "2024-01-02T03:04:05" and c(rules.local_iso(t("2024-01-02 03:04:05.25"))) == "2024-01-02T03:04:05.250000"
    assert [c(rules.confidence(F.lit(a), F.lit(b))) for a, b in ((8, 5), (8, 4), (3, 2), (2, 2), (20, 1))] == ["high", "medium", "medium", "low", "low"]
    assert [c(rules.is_thin(F.lit(a), F.lit(b), F.lit(d))) for a, b, d in ((7, 0, 0), (8, 0, 0), (9, 2, 2), (9, 2, 1))] == [True, False, True, False]
    null = F.lit(None).cast("long")
    assert [c(rules.coverage_confidence(a, b)) for a, b in ((F.lit(0), F.lit(6)), (F.lit(1), F.lit(6)), (F.lit(0), F.lit(2)), (F.lit(0), null), (null, F.lit(9)))] == ["high", "medium", "low", "low", "medium"]
    assert [c(rules.coverage_is_thin(a, b)) for a, b in ((F.lit(0), F.lit(3)), (F.lit(1), F.lit(9)), (F.lit(0), F.lit(2)), (null, F.lit(9)))] == [False, True, True, True]
    assert c(rules.cents(F.lit(1000), F.lit(100), F.lit(3.0), F.lit(15.0))) == 1 and c(rules.cents(F.lit(0), F.lit(0), F.lit(3.0), F.lit(15.0))) == 0
    assert c(rules.is_content_rejection(F.lit("Quote is not VERBATIM"))) and not c(rules.is_content_rejection(F.lit("timeout")))
    assert c(rules.is_duplicate_object(F.lit(None).cast("string"), F.lit(409), F.lit("it exists"))) and not c(rules.is_duplicate_object(F.lit("x"), F.lit(500), F.lit("exists")))
    assert c(rules.is_object_missing(F.lit("not_found"), F.lit(404))) and not c(rules.is_object_missing(F.lit("not_found"), F.lit(500)))
    assert [c(rules.credit_status(F.lit(s))) for s in (402, 429, 200)] == ["exhausted", "rate_limited", "ok"]
    assert [c(rules.credit_status(F.lit(403), F.lit(b))) for b in ("Out of CREDITS", "quota reached", "forbidden", None)] == ["exhausted", "exhausted", "ok", "ok"]
    assert c(rules.credit_figures(F.create_map(F.lit("x-credits-remaining"), F.lit("5"), F.lit("credit-cost"), F.lit("x"))))["credits_remaining"] == 5
    assert c(rules.or_default(F.lit(-0.0), F.lit(2.5))) == 2.5
    assert c(rules.or_default(F.lit(0), F.lit(30))) == 30 and c(rules.or_default(F.lit(4), F.lit(30))) == 4


ODD = (5, -1, 1.5, True, None, ["x"], {"x": 1}, [], {}, " ", "\n\t\u2003", "")


def test_shapes(spark):
    label = {"verdict": "supported", "rationale": "r"}
    bad = ['{"verdict":"maybe","rationale":"r"}', '{"verdict":"supported","rationale":"r","x":1}', "broken", None, "null", "[]", '"x"', '{"verdict":"supported"}', '{"verdict":"supported","verdict":"supported","rationale":"r"}']
    bad += [json.dumps(label | {k: v}) for k in label for v in ODD]
    df = spark.createDataFrame([(json.dumps(label),), (' {"rationale":"\\u00e9","verdict":"ambiguous"} ',), *((x,) for x in bad)], "j string")
    assert [r.x for r in df.select(shapes.is_label(F.col("j")).alias("x")).collect()] == [True, True] + [False] * len(bad)


def test_usage(spark):
    good = [(0, 0), (12, 1024), (900, 3)]
    bad = [(-1, 3), (True, 3), (1.5, 3), ("12", 3), (3, 1025), (901, 3), (None, 3), ([1], 3), (10**20, 3)]
    df = spark.createDataFrame([(json.dumps({"input_tokens": a, "output_tokens": b}),) for a, b in good + bad] + [('{"input_tokens":3.0,"output_tokens":1}',), ('{"input_tokens":3}',)], "j string")
    assert [r.x for r in df.select(shapes.is_usage(F.col("j"), 900, 1024).alias("x")).collect()] == [True] * 3 + [False] * (len(bad) + 2)


@pytest.mark.parametrize(("shape", "check", "base"), [
    (shapes.QUOTE, shapes.is_quote, {"quote": "q", "type": "desire", "theme": "", "product_area": "", "confidence": "high"}),
    (shapes.FINDING, shapes.is_finding, {"fact_type": "policy", "statement": "s", "detail": "", "evidence": "e", "confidence": "low"}),
])
def test_items_of_extractions(spark, shape, check, base):
    loose = {"theme", "product_area", "detail"}  # these may be blank
    odd = [base | {k: v} for k in base for v in ODD if not (k in loose and isinstance(v, str))] + [base | {"x": 1}, 5, "text", json.dumps(base), [base], None]
    df = spark.createDataFrame([(json.dumps({"quotes": [base, *odd]}),), (json.dumps({"quotes": "none"}),), ("broken",)], "j string")
    rows = df.select(F.posexplode(shapes.items(shapes.parsed(F.col("j")), "quotes")).alias("pos", "v")).select("pos", check(F.col("v")).alias("x"), shapes.read(F.col("v"), shape).alias("r")).orderBy("pos").collect()
    assert [r.x for r in rows] == [True] + [False] * len(odd) and rows[0].r.asDict() == base


def test_exact_keys(spark):
    ok = {"title": "T", "pains": [{"theme": "t", "summary": "s", "evidence_refs": [{"kind": "voc", "id": "1"}]}, {"theme": "t", "summary": "s", "evidence_refs": []}]}
    bad = [
        ok | {"x": 1}, {"title": "T"}, ok | {"title": " "}, ok | {"pains": "none"}, {"title": "T", "pains": [{"theme": "t", "summary": "s"}]}, {"title": "T", "pains": [{"theme": "t", "summary": "s", "evidence_refs": [], "more": 1}]},
        {"title": "T", "pains": [{"theme": "t", "summary": "s", "evidence_refs": [{"kind": "voc", "id": "1", "n": 2}]}]}, {"title": "T", "pains": [{"theme": "t", "summary": "s", "evidence_refs": [{"kind": "page", "id": "1"}]}]},
        {"title": "T", "pains": [{"theme": "t", "summary": "s", "evidence_refs": [{"kind": "voc", "id": " "}]}]}, [], "x",
        *({"title": v, "pains": []} for v in ODD), *(ok | {"pains": v} for v in ODD if v != []), *({"title": "T", "pains": [{"theme": "t", "summary": "s", "evidence_refs": []} | {k: v}]} for k in ("theme", "summary") for v in ODD),
        *({"title": "T", "pains": [{"theme": "t", "summary": "s", "evidence_refs": [{"kind": "voc", "id": "1"}, {"kind": "voc", "id": "1"} | {k: v}]}]} for k in ("kind", "id") for v in ODD),
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in [ok, ok | {"pains": []}, *bad]] + [(None,), ("broken",)], "j string")
    assert [r.x for r in df.select(shapes.is_synthesis(F.col("j")).alias("x")).collect()] == [True, True] + [False] * (len(bad) + 2)
    white = [{"candidates": []}, {"candidates": [{"angle_key": "a", "summary": "s"}]}, {"candidates": [{"angle_key": "a", "summary": " "}]}, {"candidates": [], "title": "t"}, {"candidates": [{"angle_key": "a", "summary": "s", "n": 1}]}]
    white += [{"candidates": [{"angle_key": "a", "summary": "s"}, {"angle_key": "a", "summary": "s"} | {k: v}]} for k in ("angle_key", "summary") for v in ODD]
    df = spark.createDataFrame([(json.dumps(x),) for x in white], "j string")
    assert [r.x for r in df.select(shapes.is_whitespace(F.col("j")).alias("x")).collect()] == [True, True] + [False] * (3 + 2 * len(ODD))


def test_json_schema():
    built = shapes.json_schema(shapes.EXTRACTION, {"type": shapes.QUOTE_TYPES, "confidence": shapes.CONFIDENCES})
    quote = built["properties"]["quotes"]["items"]
    assert quote["required"] == ["quote", "type", "theme", "product_area", "confidence"] and not quote["additionalProperties"]
    assert quote["properties"]["type"]["enum"][0] == "desire" and "enum" not in quote["properties"]["theme"]


def test_decoding_goes_in_small_batches(spark):
    """Pieces of a batch come back in order, and the query bounds the batches of a session that has no bound of its own."""
    from tesserae.plans.registry import REGISTRY

    rows = spark.range(500).selectExpr("id", "cast(repeat(cast(id as string), 3000) as binary) b", "CASE WHEN id % 2 = 0 THEN 'no-such' END c").coalesce(1)
    assert rows.select(F.col("id"), html.decoded(F.col("b"), F.col("c")).alias("x")).where("x = repeat(cast(id as string), 3000)").count() == 500
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(setting)
    REGISTRY["decoded_pages"].run(spark, "/root/testdata/sf0.001")
    assert spark.conf.get(setting).rstrip("b") == str(8 << 20)
