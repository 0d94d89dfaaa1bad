"""The media cache as a table: figures, faceted search, lookups, upserts, retention."""

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats(media: DataFrame, kind: str, size: str, analysed: Column, brand: str, duration: str | None = None) -> DataFrame:
    """A row for all media and one for each kind; sums over nothing are 0. Gigabytes come from the rounded megabytes."""
    figures = [
        F.count("*").alias("total"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"), F.count(F.when(analysed, 1)).alias("analysed"),
        F.countDistinct(brand).alias("brands"), *([F.avg(duration).alias("avg_duration")] if duration else []),
    ]
    both = media.groupBy(kind).agg(*figures).withColumnRenamed(kind, "scope").unionByName(media.agg(*figures).withColumn("scope", F.lit("all")))
    mb = F.round(F.col("total_bytes") / 1024 / 1024, 2)
    return both.withColumn("total_mb", mb).withColumn("total_gb", F.round(F.col("total_mb") / 1024, 2))


def search(media: DataFrame, brand: Column | None = None, people: Column | None = None, colour: tuple[str, str] | None = None, kind: Column | None = None, order: list[Column] | None = None, limit: int | None = 20) -> DataFrame:
    """Rows that meet every condition given, nulls dropped; colour is (column, text), matched anywhere without
    regard to the case of A-Z, with % and _ as wildcards. A limit of None or 0 keeps all."""
    for condition in (brand, people, kind):
        media = media.where(condition) if condition is not None else media
    if colour:
        low = lambda c: F.translate(c, ascii_uppercase, ascii_lowercase)
        media = media.where(F.like(low(F.col(colour[0])), low(F.lit(f"%{colour[1]}%")), F.lit("\x01")))  # no character is an escape
    media = media.orderBy(*order) if order else media
    return media.limit(limit) if limit else media


def lookup(urls: DataFrame, media: DataFrame, key: str, file_there: Column) -> DataFrame:
    """Every asked key with its media row; entries whose file is gone count as missing. `cached` splits reuse from work."""
    usable = media.where(file_there).withColumn("_hit", F.lit(True))
    return urls.join(usable, key, "left").withColumn("cached", F.coalesce("_hit", F.lit(False))).drop("_hit")


def retained(media: DataFrame, at: str, cutoff: Column) -> DataFrame:
    """What a cleanup keeps: rows at or after the cutoff."""
    return media.where(F.col(at) >= cutoff)


def cleanup_report(media: DataFrame, kind: str, at: str, size: str, cutoff: Column) -> DataFrame:
    """Per kind: rows before and after the cleanup, rows and bytes that go."""
    old = F.col(at) < cutoff
    return media.groupBy(kind).agg(
        F.count("*").alias("before"), F.count(F.when(~old, 1)).alias("after"), F.count(F.when(old, 1)).alias("deleted"),
        F.coalesce(F.sum(F.when(old, F.col(size))), F.lit(0)).alias("freed"),
    )


def touched(media: DataFrame, reads: DataFrame, key: str, at: str) -> DataFrame:
    """media with last_accessed moved to the latest read."""
    latest = reads.groupBy(key).agg(F.max(at).alias("_at"))
    return media.join(latest, key, "left").withColumn("last_accessed", F.greatest("last_accessed", "_at")).drop("_at")


def with_analysis(media: DataFrame, results: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """media with the analysis columns of the results where there are any: an update by key."""
    new = results.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    out = media.join(new, key, "left")
    return out.withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_new", *[f"_{c}" for c in columns])
