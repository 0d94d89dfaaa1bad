"""Rollups that are kept by signed changes instead of being rebuilt.

A change is a row with `_sign`: +1 for a row that came, -1 for one that went; an update is both. Counts add up, so a stored
rollup and the changes since give the rollup as it would be built anew. How many different entities stand behind a group does
not add up; it follows from the references of each entity, which do: an entity counts as long as it has any. What is read for
a batch of changes is the stored rollup and references, never the rows behind them.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.pick import latest_by

SIGN = "_sign"


def signed(came: DataFrame | None = None, went: DataFrame | None = None) -> DataFrame:
    """One frame of changes of rows that came and rows that went. An update is its row before among the latter, and after among the former."""
    parts = [df.withColumn(SIGN, F.lit(s)) for df, s in ((came, 1), (went, -1)) if df is not None]
    return reduce(DataFrame.unionByName, parts)


def applied(stored: DataFrame | None, changes: DataFrame, keys: list[str], counters: dict[str, Column]) -> DataFrame:
    """(keys, counters) after the changes; `counters` says what a row adds to each, the first being the number of rows. Groups
    without rows go. A group with fewer than none is an error: what went was not there."""
    added = changes.groupBy(*keys).agg(*[F.sum(F.col(SIGN) * c).alias(n) for n, c in counters.items()])
    both = added if stored is None else stored.select(*keys, *counters).unionByName(added)
    out = both.groupBy(*keys).agg(*[F.sum(n).cast("long").alias(n) for n in counters])
    first = next(iter(counters))
    below = F.raise_error(F.concat(F.lit(f"more went than was there, {first} is "), F.col(first).cast("string"))).cast("boolean")
    return out.where(F.when(F.col(first) < 0, below).otherwise(F.col(first) > 0))


def entities_applied(references: DataFrame | None, rollup: DataFrame | None, changes: DataFrame, keys: list[str], entity: str, entities: str, counters: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(references, rollup) after the changes. references: keys, entity and the counters of each; rollup: keys, `entities` (how many
    have references) and the counters."""
    by = [*keys, entity]
    first = next(iter(counters))
    after = applied(references, changes, by, counters)
    there = lambda df, side: df.select(*by, F.lit(side).alias("_turn"))
    sides = there(after, 1) if references is None else there(after, 1).unionByName(there(references, -1))
    turned = sides.groupBy(*by).agg(F.sum("_turn").alias("_turn")).where("_turn <> 0")  # began, or ceased, to have references
    moves = turned.select(*keys, F.sign("_turn").cast("int").alias(SIGN), F.lit(1).alias("_entity"), *[F.lit(0).alias(f"_c_{n}") for n in counters])
    added = changes.select(*keys, SIGN, F.lit(0).alias("_entity"), *[c.alias(f"_c_{n}") for n, c in counters.items()])
    columns = {first: F.col(f"_c_{first}"), entities: F.col("_entity"), **{n: F.col(f"_c_{n}") for n in counters if n != first}}
    return after, applied(rollup, moves.unionByName(added), keys, columns)


def replaced_latest(current: DataFrame, new: DataFrame, entity: str, at: str, tie: str, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(latest, changes): each entity's latest ok row among the current and the new ones, and the signed changes that lead there."""
    fresh = new.where(ok).join(current.select(entity, F.col(at).alias("_at"), F.col(tie).alias("_tie")), entity, "left")
    later = fresh.where(F.col("_at").isNull() | (F.struct(at, tie) > F.struct("_at", "_tie"))).drop("_at", "_tie")
    came = latest_by(later, [entity], at, tie)
    went = current.join(came.select(entity), entity, "left_semi")
    return current.join(came.select(entity), entity, "left_anti").unionByName(came.select(*current.columns)), signed(came.select(*current.columns), went)
