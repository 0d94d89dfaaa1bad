"""Rollups over evidence and censuses that state absence."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.pick import latest_by, top_by

THIN_BELOW = 3  # our cut: a theme with fewer quotes is thin


def tagged(quotes: DataFrame, theme: str, kind: str) -> DataFrame:
    """quotes with theme and quote_type; blank and null are one untagged bucket."""
    return quotes.withColumn("theme", F.coalesce(theme, F.lit(""))).withColumn("quote_type", F.coalesce(kind, F.lit("")))


def theme_rollup(quotes: DataFrame, theme: str, kind: str, key: str, examples: int = 3, thin_below: int = THIN_BELOW) -> DataFrame:
    """theme, quote_type, n, first_id, last_id, data_density and the ids of the first examples. All members are `theme_members`."""
    rows = tagged(quotes, theme, kind)
    out = rows.groupBy("theme", "quote_type").agg(F.count("*").alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))
    first = top_by(theme_members(quotes, theme, kind, key).distinct(), ["theme", "quote_type"], [F.col(key)], examples)
    few = first.groupBy("theme", "quote_type").agg(F.sort_array(F.collect_list(key)).alias("example_ids"))  # `examples` ids at most
    return out.withColumn("data_density", F.when(F.col("n") < thin_below, "thin").otherwise("normal")).join(few, ["theme", "quote_type"])


def theme_members(quotes: DataFrame, theme: str, kind: str, key: str) -> DataFrame:
    """(theme, quote_type, key): the members of the rollup's rows, as a table."""
    return tagged(quotes, theme, kind).select("theme", "quote_type", key)


def batch(header: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of a batch under its header; no rows are legal, a missing header is an error when the rows are read.

    header: key, and what else a batch says of itself; the result has a row without members for a batch that has none.
    """
    there = header.withColumn("_header", F.lit(True))
    met = there.join(rows, key, "full")
    missing = F.raise_error(F.concat(F.lit("no header for batch "), F.col(key).cast("string"))).cast("boolean")
    return met.where(F.when(F.col("_header").isNull(), missing).otherwise(True)).drop("_header")


def evidence_refs(headers: DataFrame, rows: DataFrame, batch_id: str, row_id: str) -> DataFrame:
    """(batch_id, kind, id): the reference of each batch's header, and those of all its rows."""
    own = headers.select(batch_id, F.lit("batch").alias("kind"), F.col(batch_id).cast("string").alias("id"))
    return own.unionByName(rows.select(batch_id, F.lit("row").alias("kind"), F.col(row_id).cast("string").alias("id")))


def theme_basis(rollup: DataFrame) -> DataFrame:
    """One row: total_publishable, rows, thin_rows, and thin_data as the fixed rule has it."""
    from tesserae.functions.rules import is_thin

    out = rollup.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_publishable"), F.count("*").alias("rows"), F.count(F.when(F.col("data_density") == "thin", 1)).alias("thin_rows"))
    return out.withColumn("thin_data", is_thin(F.col("total_publishable"), F.col("rows"), F.col("thin_rows")))


def angle_census(analyses: DataFrame, entity: str, at: str, tie: str, ok: Column, angle: list[str], verbatim: Column) -> DataFrame:
    """For each angle, over each entity's latest ok analysis: distinct entities, rows, verbatim and other rows."""
    latest = latest_by(analyses, [entity], at, tie, ok)
    return latest.groupBy(*angle).agg(
        F.countDistinct(entity).alias("competitor_count"), F.count("*").alias("total_count"),
        F.count(F.when(verbatim, 1)).alias("verbatim_count"), F.count(F.when(~verbatim, 1)).alias("not_verbatim_count"),
    )


def angle_members(analyses: DataFrame, entity: str, at: str, tie: str, ok: Column, angle: list[str]) -> DataFrame:
    """(angle, entity, analysis): who stands behind each row of the census, as a table instead of lists."""
    return latest_by(analyses, [entity], at, tie, ok).select(*angle, entity, F.col(tie).alias("analysis"))


def with_absence(registry: DataFrame, census: DataFrame, keys: list[str]) -> DataFrame:
    """Every registry row with its counts, explicit zeros where the census has no row, and has_rollup_row."""
    counts = [c for c in census.columns if c not in keys]
    joined = registry.join(census.withColumn("_there", F.lit(True)), keys, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {"has_rollup_row": F.coalesce("_there", F.lit(False))}).drop("_there")


def coverage_basis(selected: DataFrame, observed: DataFrame, entity: str) -> DataFrame:
    """One row: how many entities were selected, how many have observations, and the gap."""
    a = selected.agg(F.countDistinct(entity).alias("selected"))
    b = observed.join(selected.select(entity).distinct(), entity, "left_semi").agg(F.countDistinct(entity).alias("with_observations"))
    return a.join(b, F.lit(True)).withColumn("coverage_gap", F.col("selected") - F.col("with_observations"))  # one row each


def active_registry(rows: DataFrame, fallback: DataFrame, sentinel: str = "unmapped") -> DataFrame:
    """angle_key, label, definition of active rows with a key, the fallback if there is none, the sentinel in any case."""
    live = rows.where((F.col("status") == "active") & (F.trim("angle_key") != "")).select("angle_key", F.coalesce(F.when(F.col("label") != "", F.col("label")), "angle_key").alias("label"), F.coalesce("definition", F.lit("")).alias("definition"))
    used = live.unionByName(fallback.select("angle_key", "label", "definition").where(F.lit(live.isEmpty())))
    own = fallback.where(F.col("angle_key") == sentinel).select("angle_key", "label", "definition")
    return used.unionByName(own.join(used.select("angle_key"), "angle_key", "left_anti")).orderBy("angle_key")


def cited(citations: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Citations of what is publishable, each pair once for each deliverable, in first order."""
    return citations.join(evidence.select(*keys).distinct(), keys, "left_semi")


def winning_concepts(ads: DataFrame, concept: list[str], days: str, recent: str, n: int) -> DataFrame:
    """The n concepts that most likely work: by the number of their variants, then of the recent ones, then by longevity
    as a share of the longest. confidence is our rule: high needs three variants and a second sign, medium two variants."""
    rows = ads.groupBy(*concept).agg(F.count("*").alias("variants"), F.count(F.when(F.col(recent), 1)).alias("recent"), F.max(days).alias("_days"))
    longest = F.broadcast(ads.agg(F.max(days).alias("_longest")))  # one row
    rated = rows.join(longest, F.lit(True)).withColumn("longevity", F.col("_days") / F.col("_longest"))
    confidence = F.when((F.col("variants") >= 3) & ((F.col("longevity") >= 0.5) | (F.col("recent") >= 2)), "high").when(F.col("variants") >= 2, "medium").otherwise("low")
    return rated.withColumn("confidence", confidence).drop("_days", "_longest").orderBy(F.desc("variants"), F.desc("recent"), F.desc("longevity"), *concept).limit(n)
