"""Entity resolution by a cascade of ever looser matches."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import alnum_key


def _best(options: DataFrame, on: Column, *order: Column) -> DataFrame:
    """One row for each value of `on` that is not empty: the first name's key in this order, and how many names there are."""
    first = F.min_by("_key", F.struct(*order, "_name", "_key"))
    return options.select(on.alias("_on"), "_name", "_key").where("_on <> ''").groupBy("_on").agg(first.alias("_found"), F.count("*").alias("_n"))


def resolve(probes: DataFrame, options: DataFrame, probe: str, name: str, key: str) -> DataFrame:
    """(probe, key, how): exact, case-insensitive, normalised (the shortest name), or the only normalised
    prefix; key null and how `ambiguous` or `none` otherwise. An empty normal form matches nothing, but a name that
    has one still matches as it is written.

    Every step reduces the options to one row for each value before an equi-join, so a probe never meets more than one
    row, however many names begin with it. Prefixes are cut to the lengths that probes have.
    """
    p = probes.select(probe).distinct().withColumn("_pn", alnum_key(F.col(probe))).withColumn("_pl", F.lower(probe))
    o = options.select(F.col(name).alias("_name"), F.col(key).alias("_key"))
    normal = alnum_key(F.col("_name"))
    lengths = [n for n in p.agg(F.sort_array(F.collect_set(F.length("_pn")))).first()[0] or [] if n]  # no more than the longest name has letters
    cut = F.array(*map(F.lit, lengths)).cast("array<int>")
    starts = o.withColumn("_normal", normal).select("_name", "_key", F.explode(F.transform(F.filter(cut, lambda n: n <= F.length("_normal")), lambda n: F.substring("_normal", F.lit(1), n))).alias("_start"))
    steps = [
        ("exact", probe, _best(o, F.col("_name"))),
        ("case", "_pl", _best(o, F.lower("_name"))),
        ("normalized", "_pn", _best(o, normal, F.length("_name"))),
        ("prefix", "_pn", _best(starts, F.col("_start"))),
    ]
    out = p
    for how, on, found in steps:
        out = out.join(found.select(F.col("_on").alias(f"_{how}_on"), F.col("_found").alias(f"_{how}"), F.col("_n").alias(f"_{how}_n")), F.col(on) == F.col(f"_{how}_on"), "left")
    by = [(F.col(f"_{how}_n").isNotNull() & ((F.col(f"_{how}_n") == 1) if how == "prefix" else F.lit(True)), how) for how, _, _ in steps]
    how, found = F.when(*[by[0][0], F.lit("exact")]), F.when(by[0][0], F.col("_exact"))
    for there, step in by[1:]:
        how, found = how.when(there, F.lit(step)), found.when(there, F.col(f"_{step}"))
    return out.select(probe, found.alias(key), how.when(F.col("_prefix_n") > 1, F.lit("ambiguous")).otherwise("none").alias("how"))
