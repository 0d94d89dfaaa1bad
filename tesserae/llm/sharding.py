"""Sharding by Hilbert-curve order, in DataFrame and SQL functions only.

Several metadata columns are quantised into 2^bits cells each at quantiles of all rows, the cells'
Hilbert index orders the rows, and runs of that order are cut into shards. Strings are compared whole, so paths with a
long common beginning fall into cells like any other; their quantiles are exact. Those of numbers come from a sketch of all
rows, within 1/2000 of the rows of the exact ones. Rows of a shard are close in all of the columns at once, so the minima
and maxima of its files prune scans on any of them.

The order is a range partitioning with sorted partitions; its row ids are written once to the shared
folder, and the partitions' sizes (a row for each partition) turn them into global ranks. Ties within a cell
are ordered by key and text hash, and the range partitioning splits on them too, so a cell that holds a
third of all rows is dealt to many tasks.

Law `rows`: the shards' row counts differ by one at most. Law `bytes`: a shard ends where the running
size passes its share.

Defined cases: nulls of a dimension share the lowest cell; a null text has the size of the row overhead;
rows that are equal in everything get neighbouring slots in either order; fewer rows than shards leave
shards empty; an empty table gives an empty result; input columns named like added ones are replaced.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.session import forget, materialise

BITS = 5
OVERHEAD = 16
ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row within it below


def hilbert_index(point: str, n: int, bits: int = BITS) -> Column:
    """The place on the Hilbert curve (Skilling's transform) of `point`, the name of a column with an array of n integers below 2^bits."""
    steps = lambda low: ", ".join(f"named_struct('q', {q}, 'i', {i})" for q in range(bits - 1, low - 1, -1) for i in range(n))
    low_bits = "(shiftleft(1, s.q) - 1)"
    undone = f"""aggregate(array({steps(1)}), _point, (x, s) -> IF((shiftright(x[s.i], s.q) & 1) = 1,
        transform(x, (v, j) -> IF(j = 0, v ^ {low_bits}, v)),
        transform(x, (v, j) -> IF(j = 0 OR j = s.i, v ^ ((x[0] ^ x[s.i]) & {low_bits}), v))))""" if bits > 1 else "_point"
    mixed = f"transform(array({undone}), x -> transform(x, (v, j) -> aggregate(slice(x, 1, j + 1), 0, (a, e) -> a ^ e)))[0]"
    turns = ", ".join(str(q) for q in range(bits - 1, 0, -1))
    turned = f"transform(array({mixed}), x -> transform(x, v -> v ^ aggregate(array({turns}), 0, (t, q) -> IF((shiftright(x[{n - 1}], q) & 1) = 1, t ^ (shiftleft(1, q) - 1), t))))[0]" if bits > 1 else mixed
    woven = f"transform(array({turned}), x -> aggregate(array({steps(0)}), 0L, (h, s) -> h * 2 + (shiftright(x[s.i], s.q) & 1)))[0]"
    return F.expr(woven.replace("_point", point))


def ordinal(column: Column, kind: T.DataType) -> Column:
    """A number in the order of the column; strings stay as they are."""
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return F.unix_timestamp(column).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_timestamp(column.cast("timestamp")).cast("double")
    return column.cast("double")


def _below(column: str):
    return lambda edge: edge < F.col(column)


def string_edges(rows: DataFrame, columns: list[str], cells: int) -> dict[str, list[str]]:
    """The inner quantiles of string columns, exact: of all rows' values, whatever the number of distinct ones.

    Distinct values with their counts are range-partitioned and sorted; running counts say which of them hold the wanted
    ranks. The driver gets a row for each column and partition, and the quantiles.
    """
    if not columns:
        return {}
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("__t_dim"), F.col(c).alias("__t_value")) for i, c in enumerate(columns)]))
    counted = rows.select(each).where("__t_value IS NOT NULL").groupBy("__t_dim", "__t_value").agg(F.count("*").alias("__t_n"))
    keys = ("__t_dim", "__t_value")
    ordered = materialise(counted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__t_row", F.monotonically_increasing_id()), "values")
    totals = {r["__t_dim"]: r["n"] for r in ordered.groupBy("__t_dim").agg(F.sum("__t_n").alias("n")).collect()}
    wanted, before = [], 0  # ranks among the values of all columns, one column's after the other's
    for i in sorted(totals):
        wanted += [before + k * totals[i] // cells for k in range(1, cells)]
        before += totals[i]
    placed, _, _ = ranked(ordered, "__t_n")
    within = Window.partitionBy("__t_part").orderBy("__t_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("__t_from", F.col("__t_size_before") + F.coalesce(F.sum("__t_n").over(within), F.lit(0)))
    ranks = F.array(*[F.lit(r).cast("long") for r in sorted(set(wanted))])
    hit = F.exists(ranks, lambda r: (r >= F.col("__t_from")) & (r < F.col("__t_from") + F.col("__t_n")))
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in placed.where(hit).select(*keys).collect():
        found[columns[r["__t_dim"]]].append(r["__t_value"])
    forget(ordered)
    return found


def order_by_hilbert(docs: DataFrame, dimensions: list[str], ties: list[Column], bits: int = BITS) -> DataFrame:
    """docs with `hilbert` (long) and `__t_row`, a row id that follows the Hilbert order; written once."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    numbers = {f"__t_d{i}": ordinal(F.col(f"`{d}`"), kinds[d]) for i, d in enumerate(dimensions)}
    strings = [f"__t_d{i}" for i, d in enumerate(dimensions) if isinstance(kinds[d], T.StringType)]
    rows = docs.withColumns(numbers)
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    others = [d for d in numbers if d not in strings]
    edges = rows.agg(*[F.percentile_approx(d, cuts, 2000).alias(d) for d in others]).first().asDict() if others else {}
    edges |= string_edges(rows, strings, 1 << bits)
    cells = []
    for d in numbers:  # null is in the lowest cell
        at = F.array(*[F.lit(v) for v in sorted(set(edges[d] or []))])
        cells.append(F.coalesce(F.size(F.filter(at, _below(d))), F.lit(0)) if edges[d] else F.lit(0))
    placed = rows.withColumn("__t_cells", F.array(*[c.cast("int") for c in cells])).withColumn("hilbert", hilbert_index("__t_cells", len(cells), bits)).drop(*numbers, "__t_cells")
    keys = [F.col("hilbert"), *ties]
    return materialise(placed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__t_row", F.monotonically_increasing_id()), "hilbert")


def ranked(rows: DataFrame, size: str) -> tuple[DataFrame, int, int]:
    """rows with __t_rank (from 0) in the order of __t_row; the number of rows and the sum of `size`.

    Each partition's count goes to the driver and comes back as a literal map: one entry for a partition.
    """
    part = F.shiftrightunsigned("__t_row", ROW_BITS)
    counts = sorted(tuple(r) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.sum(size).alias("s")).collect())
    before, start, total = {}, 0, 0
    for p, n, s in counts:
        before[p] = (start, total)
        start, total = start + n, total + s
    lists = [F.array(*map(F.lit, column)).cast("array<bigint>") for column in (before, [b for b, _ in before.values()], [b for _, b in before.values()])]
    offsets = rows.sparkSession.range(1).select(F.inline(F.arrays_zip(*lists)).alias("__t_part", "__t_before", "__t_size_before"))
    out = rows.withColumn("__t_part", part).join(F.broadcast(offsets), "__t_part").withColumn("__t_rank", F.col("__t_before") + F.col("__t_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    return out, start, total


def shard(docs: DataFrame, shards: int, dimensions: list[str], ties: list[str], size: str, law: str = "rows", bits: int = BITS) -> DataFrame:
    """docs with shard (int, from 0), slot (long, gapless from 0 in its shard) and hilbert (long)."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law: {law}")
    docs = docs.drop("shard", "slot", "hilbert")
    out, n, total = ranked(order_by_hilbert(docs, dimensions, [F.col(f"`{t}`") for t in ties], bits), size)
    if law == "rows":
        number = F.floor(F.col("__t_rank") * shards / F.lit(max(n, 1))).cast("int") if n * shards < 1 << 52 else F.expr(f"int(__t_rank * {shards}BD div {n}BD)")
        first = F.ceil(F.col("shard") * F.lit(n) / F.lit(float(shards))) if n * shards < 1 << 52 else F.expr(f"(shard * {n}BD + {shards - 1}) div {shards}")
        out = out.withColumn("shard", number).withColumn("slot", (F.col("__t_rank") - first).cast("long"))
    else:
        within = Window.partitionBy("__t_part").orderBy("__t_row").rowsBetween(Window.unboundedPreceding, -1)
        middle = F.col("__t_size_before") + F.coalesce(F.sum(size).over(within), F.lit(0)) + F.col(size) / 2
        out = out.withColumn("shard", F.least(F.floor(middle * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int"))
        out = materialise(out, "sharded")
        firsts = out.groupBy("shard").agg(F.min("__t_rank").alias("__t_first"))
        out = out.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("__t_rank") - F.col("__t_first"))
    return out.select(*[f"`{c}`" for c in docs.columns], "hilbert", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
