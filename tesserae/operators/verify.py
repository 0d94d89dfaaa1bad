"""Verification of frozen samples: integrity, verdicts, tallies."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import is_verbatim
from tesserae.operators.pick import first_by

# The results that a member can have.
RESULTS = ("pending", "supported", "unsupported", "abstained", "integrity_failed", "unauthenticatable")


def integrity(members: DataFrame, captures: DataFrame, objects: DataFrame) -> DataFrame:
    """members with `integrity`: captures without a proper hash are unauthenticatable; a missing object or
    another hash fails; the rest is ok. objects: path, sha256."""
    joined = members.join(captures.select("capture_id", "path", "content_sha256"), "capture_id", "left").join(objects.select("path", F.col("sha256").alias("_sha")), "path", "left")
    proper = F.coalesce(F.rlike("content_sha256", F.lit("^[0-9a-f]{64}$")), F.lit(False))
    return joined.withColumn("integrity", F.when(~proper, "unauthenticatable").when(F.col("_sha").eqNullSafe(F.col("content_sha256")), "ok").otherwise("integrity_failed")).drop("_sha", "path", "content_sha256")


def outcomes(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (integrity, text, quote) with `result`: failed integrity stands; evidence that is gone or empty is
    abstained; a quote that does not occur is unsupported; then the label decides, and without one it is abstained."""
    labelled = members.join(labels.select("evidence_id", "verdict"), "evidence_id", "left")
    verdict = F.when(F.col("verdict").isin("supported", "unsupported"), F.col("verdict")).otherwise("abstained")
    result = (
        F.when(F.col("integrity") != "ok", F.col("integrity"))
        .when(F.col("text").isNull() | (F.coalesce("quote", F.lit("")) == ""), "abstained")
        .when(~is_verbatim(F.col("text"), F.col("quote")), "unsupported")
        .otherwise(verdict)
    )
    return labelled.withColumn("result", result)


def outcomes_by_kind(members: DataFrame, pages: DataFrame, quotes: DataFrame, findings: DataFrame, labels: DataFrame) -> DataFrame:
    """members (evidence_kind, evidence_id, capture_id, integrity) with `result`, each kind looked up in its own table.

    Failed integrity stands. A row that is gone, or a kind that is not known, is abstained. A quote must occur in the
    reviews, a finding's evidence in the page, else it is unsupported; a finding without evidence falls back on its
    detail, and is abstained where that does not occur. Then the label decides.
    pages: capture_id, page, reviews; quotes: evidence_id, quote; findings: evidence_id, evidence, detail.
    """
    kind = F.col("evidence_kind")
    on = lambda rows, name: (kind == name) & (F.col("evidence_id") == rows["_id"])
    q = quotes.select(F.col("evidence_id").alias("_id"), F.coalesce("quote", F.lit("")).alias("_quote"))
    f = findings.select(F.col("evidence_id").alias("_id"), F.coalesce("evidence", F.lit("")).alias("_evidence"), F.coalesce("detail", F.lit("")).alias("_detail"))
    met = members.join(pages.select("capture_id", F.coalesce("page", F.lit("")).alias("_page"), F.coalesce("reviews", F.lit("")).alias("_reviews")), "capture_id", "left")
    met = met.join(q, on(q, "voc"), "left").drop("_id").join(f, on(f, "finding"), "left").drop("_id").join(labels.select("evidence_kind", "evidence_id", "verdict"), ["evidence_kind", "evidence_id"], "left")
    occurs = lambda text, part: F.coalesce(is_verbatim(F.col(text), F.col(part)), F.lit(False))
    filled = F.trim("_evidence") != ""
    result = (
        F.when(F.col("integrity") != "ok", F.col("integrity"))
        .when((kind == "voc") & F.col("_quote").isNotNull(), F.when(~occurs("_reviews", "_quote"), "unsupported"))
        .when((kind == "finding") & F.col("_evidence").isNotNull(), F.when(filled & ~occurs("_page", "_evidence"), "unsupported").when(~filled & ~occurs("_page", "_detail"), "abstained"))
        .otherwise("abstained")
    )
    verdict = F.when(F.col("verdict").isin("supported", "unsupported"), F.col("verdict")).otherwise("abstained")
    return met.withColumn("result", F.coalesce(result, verdict)).drop("_page", "_reviews", "_quote", "_evidence", "_detail", "verdict")


def recorded(members: DataFrame, outcomes: DataFrame, key: str, order: str) -> DataFrame:
    """members after their outcomes came in: a pending one of ok integrity takes its first, and nothing changes it afterwards."""
    first = first_by(outcomes.where(F.col("outcome").isin(*[r for r in RESULTS if r != "pending"])), [key], [F.col(order)]).select(key, F.col("outcome").alias("_outcome"))
    takes = (F.col("result") == "pending") & (F.col("integrity") == "ok") & F.col("_outcome").isNotNull()
    return members.join(first, key, "left").withColumn("result", F.when(takes, F.col("_outcome")).otherwise(F.col("result"))).drop("_outcome")


def tally(members: DataFrame, by: list[str], result: str = "result") -> DataFrame:
    """A column for each of RESULTS, zero where there is none; other results do not count."""
    return members.groupBy(*by).agg(*[F.count(F.when(F.col(result) == r, 1)).alias(r) for r in RESULTS])


def capture_verdict(members: DataFrame, capture: str) -> DataFrame:
    """Our rule: a capture with a pending member is pending, with an integrity failure failed, verified if one is supported and none unsupported, else mixed."""
    has = lambda *r: F.coalesce(F.bool_or(F.col("result").isin(*r)), F.lit(False))
    verdict = F.when(has("pending"), "pending").when(has("integrity_failed", "unauthenticatable"), "failed").when(has("supported") & ~has("unsupported"), "verified").otherwise("mixed")
    return members.groupBy(capture).agg(verdict.alias("verification_status"))
