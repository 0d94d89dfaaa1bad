"""One row for each key, top rows, unions that keep the first, and inserts that respect what is there."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order; nulls are one key. Scan tasks prune before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def top_by(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each key; `rank` names a column that keeps their place."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def latest_by(df: DataFrame, keys: list[str], at: str, tie: str, ok: Column | None = None) -> DataFrame:
    """The latest row of each key among those that are ok, ties by the largest id."""
    return first_by(df.where(ok) if ok is not None else df, keys, [F.col(at).desc(), F.col(tie).desc()])


def pinned(df: DataFrame, keys: list[str], primary: Column, seen: str, tie: str) -> DataFrame:
    """The primary row of each key, else the one seen last."""
    return first_by(df, keys, [primary.desc(), F.col(seen).desc(), F.col(tie).desc()])


def union_keep_first(parts: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """All parts in turn; of equal keys the row of the earliest part stays. `_part` is its place."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return first_by(out, keys, [F.col("_part"), *order])


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The new rows whose keys are not there yet, the first of each key: insert, on conflict do nothing."""
    return first_by(new, keys, order).join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The table after whole rows were replaced: the last new row of each key, else the existing row.

    Columns that the new rows do not have become null for them.
    """
    last = first_by(new, keys, order)
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def present(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(existing.select(*keys), keys, "left_semi")


def absent(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(existing.select(*keys), keys, "left_anti")


def stratified_sample(ads: DataFrame, key: str, pos: str, days: str, active: str, cap: int = 30, undated_first: bool = False) -> DataFrame:
    """A bounded sample: the freshest half and the longest-running rest.

    Only active rows count, or all if none is. Up to `cap` rows stay as they are. If `cap` or more have a
    number of days, the sample is the first half by days ascending and the rest by days descending, one row
    for each key; otherwise the first and the last rows in order of arrival. With `undated_first` the longest
    half starts with rows without days. Sorts are top-n, never of the whole input.
    """
    facts = ads.agg(F.count("*").alias("n"), F.count(F.when(F.col(active), 1)).alias("active"), F.count(F.when(F.col(active), F.col(days))).alias("dated_active"), F.count(days).alias("dated")).first()
    rows, n, dated = (ads.where(active), facts["active"], facts["dated_active"]) if facts["active"] else (ads, facts["n"], facts["dated"])
    cap = cap or 30
    if n <= cap:
        return rows
    half = cap // 2
    if dated < cap:
        return rows.orderBy(pos).limit(half).unionByName(rows.orderBy(F.col(pos).desc()).limit(cap - half))
    fresh = rows.orderBy(F.col(days).asc_nulls_last(), pos).limit(half)
    longest = F.col(days).desc_nulls_first() if undated_first else F.col(days).desc_nulls_last()
    long = rows.orderBy(longest, F.col(pos).desc()).limit(cap - half)
    return union_keep_first([fresh, long], [key], [F.col(pos)]).drop("_part").limit(cap)


def hashed_sample(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """A frozen sample: n rows of each group in the order of a hash of the key, with sample_rank from 1."""
    return top_by(df.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)), [group], [F.col("_h"), F.col(key)], n, "sample_rank").drop("_h")


def bounded_buffer(df: DataFrame, at: str, tie: str, most: int, chunk: int) -> DataFrame:
    """The newest `most` rows in order, in chunks: those that a drop-oldest buffer still holds."""
    kept = df.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(most)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(at, tie)) - 1  # at most `most` rows
    return kept.withColumn("place", place).withColumn("chunk", F.floor(F.col("place") / chunk).cast("long"))


def buffer_flushes(events: DataFrame, at: str, tie: str, flush: int = 25) -> DataFrame:
    """(flush_no, n, first, last) of a buffer that is sent whenever it holds `flush` events; the last may hold fewer.

    Places are counted within contiguous slices of time and offset by the slices before, so no task sees all events of a day.
    """
    from tesserae.operators.prefix import prefix_sums, sliced

    placed = prefix_sums(sliced(events.select(at, tie), [], [at, tie]), [], [at, tie], {"_place": F.lit(1)})
    return placed.groupBy(F.floor((F.col("_place") - 1) / flush).cast("long").alias("flush_no")).agg(F.count("*").alias("n"), F.min(tie).alias("first"), F.max(tie).alias("last"))


def dropped_from_buffer(events: DataFrame, most: int) -> DataFrame:
    """One row: how many events came and how many a buffer of `most` has dropped."""
    return events.agg(F.count("*").alias("seen")).withColumn("dropped", F.greatest(F.lit(0), F.col("seen") - most))


def minted(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column], id_: str) -> DataFrame:
    """The new rows, the first of each key, with the id that stands for them: that of the row already there, else their own; `inserted` says which."""
    first = first_by(new, keys, order)
    there = first_by(existing.select(*keys, F.col(id_).alias("_there")), keys, [F.col("_there")])
    out = first.join(there, keys, "left").withColumn("inserted", F.col("_there").isNull())
    return out.withColumn(id_, F.coalesce("_there", id_)).drop("_there")


def run_states(started: DataFrame, finished: DataFrame, run: str, order: str) -> DataFrame:
    """Started runs with the status and the end of their last finish; `running` where none came. Finishes of unknown runs are left out."""
    last = first_by(finished, [run], [F.col(order).desc()]).select(run, "status", F.col(order).alias("finished_at"))
    return started.join(last, run, "left").withColumn("status", F.coalesce("status", F.lit("running")))


def replaced(existing: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """Delete, then insert: the groups of the new rows are theirs alone."""
    return existing.join(new.select(*group).distinct(), group, "left_anti").unionByName(new)
