"""Running sums and last values over ordered rows, where one key may have most of them.

Rows are dealt in contiguous ranges of (key, order), so a hot key lies in many slices. Each slice is summed by key, an
exclusive scan over these sums says what came before each slice, and that becomes a row at the head of the slice's key. The
rows of a slice are then summed on their own, head first. No window spans a key: the scan runs over one row for each slice
that a key is in.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import materialise

SLICE, HEAD = "_slice", "_head"


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df in contiguous ranges of (keys, order), numbered in that order by `_slice`, written so that the numbers stay."""
    ranged = df.repartitionByRange(*keys, *order)
    return materialise(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")


def with_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """rows, and before those of each slice and key its head, whose other columns are null."""
    return rows.withColumn(HEAD, F.lit(1)).unionByName(heads.withColumn(HEAD, F.lit(0)), allowMissingColumns=True)


def within(keys: list[str], order: list[str]):
    """The window over a slice's rows of a key up to the current one, its head among them."""
    return Window.partitionBy(SLICE, *keys).orderBy(HEAD, *order)


def prefix_sums(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Rows of `sliced` with a running sum for each name, the current row included; null counts as nothing."""
    given = rows.withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    totals = given.groupBy(SLICE, *keys).agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(SLICE, *keys, *[F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)).alias(f"_v_{n}") for n in sums])
    upto = within(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    out = with_heads(given, heads).withColumns({n: F.sum(f"_v_{n}").over(upto) for n in sums})
    return out.where(F.col(HEAD) == 1).select(*rows.columns, *sums)


def last_before(rows: DataFrame, keys: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    """Rows of `sliced` with the last value that is not null before the current row of the key."""
    given = rows.withColumn("_v", value)
    lasts = given.where("_v IS NOT NULL").groupBy(SLICE, *keys).agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    slices = given.select(SLICE, *keys).distinct()
    met = slices.withColumn("_last", F.lit(None).cast(given.schema["_v"].dataType)).unionByName(lasts).groupBy(SLICE, *keys).agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    heads = met.select(SLICE, *keys, F.last("_last", ignorenulls=True).over(before).alias("_v"))
    upto = within(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    out = with_heads(given, heads).withColumn(name, F.last("_v", ignorenulls=True).over(upto))
    return out.where(F.col(HEAD) == 1).select(*rows.columns, name)
