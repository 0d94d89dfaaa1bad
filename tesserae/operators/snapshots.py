"""Append-only snapshots whose ids follow from their contents.

A row's text has every column by name, length and value; its sha256 gives two numbers of 60 bits. A snapshot's digest is the
number of its rows and the sums of both: the order of rows does not matter, partial sums merge, a row more or less or changed
changes it, and two different sets of rows agree by chance only. So a snapshot of the same ads has the same id wherever and
whenever it is taken, and appending it twice adds its rows once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.pick import absent

DIGITS = 15  # hexadecimal digits of one number
FIGURES = ("ad_count", "sum_a", "sum_b")


def row_text(columns: list[str]) -> Column:
    """One text for each combination of values: `name=length:value;`, `name=-;` where the value is null, names in order."""
    parts = []
    for c in sorted(columns):
        v = F.col(f"`{c}`").cast("string")
        parts += [F.lit(f"{c}="), F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")), F.lit(";")]
    return F.concat(*parts)


def digests(ads: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """(entity, ad_count, sum_a, sum_b) of each entity's rows, added up before the shuffle."""
    number = lambda at: F.conv(F.substring("_h", at, DIGITS), 16, 10).cast("decimal(20,0)")
    hashed = ads.select(entity, F.sha2(row_text(columns), 256).alias("_h"))
    return hashed.groupBy(entity).agg(F.count("*").alias("ad_count"), *[F.sum(number(at)).cast("decimal(38,0)").alias(n) for n, at in (("sum_a", 1), ("sum_b", 1 + DIGITS))])


def merged(parts: list[DataFrame], entity: str) -> DataFrame:
    """The digests of what several disjoint parts hold together."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(entity).agg(*[F.sum(c).cast(out.schema[c].dataType).alias(c) for c in FIGURES])


def snapshot_id(entity: str) -> Column:
    """The id that follows from an entity and its digest."""
    return F.sha2(F.concat_ws(":", F.coalesce(F.col(entity).cast("string"), F.lit("")), *[F.col(c).cast("string") for c in FIGURES]), 256)


def taken(ads: DataFrame, entity: str, at: Column, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(headers, rows): a header (entity, snapshot_id, ad_count, taken_at) for each entity, and its ads under the same id."""
    columns = columns or ads.columns
    heads = digests(ads, entity, columns).select(F.col(entity).alias("_entity"), snapshot_id(entity).alias("snapshot_id"), "ad_count")
    rows = ads.join(heads.select("_entity", "snapshot_id"), F.col(entity).eqNullSafe(F.col("_entity"))).select("snapshot_id", *ads.columns)
    return heads.select(F.col("_entity").alias(entity), "snapshot_id", "ad_count", at.alias("taken_at")), rows


def appended(headers: DataFrame, rows: DataFrame, new_headers: DataFrame, new_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, rows) to append: every header at a time that is not there, and the rows of ids that are not; nothing is overwritten."""
    return absent(new_headers, headers, ["snapshot_id", "taken_at"]), absent(new_rows, rows.select("snapshot_id").distinct(), ["snapshot_id"])


def cited_in(citations: DataFrame, rows: DataFrame, ad: str) -> DataFrame:
    """citations (snapshot_id, ad) with `known`: whether the snapshot has the ad."""
    there = rows.select("snapshot_id", ad).distinct().withColumn("_there", F.lit(True))
    return citations.join(there, ["snapshot_id", ad], "left").withColumn("known", F.coalesce("_there", F.lit(False))).drop("_there")
