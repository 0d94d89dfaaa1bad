"""Ordered folds over the rows of a key, as streams: rows are hashed by key and sorted, and a task holds the state of one
key at a time, whatever the number of its rows."""

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import ship

_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def kind(rows: DataFrame, column: str) -> str:
    """How a fold's output declares a key column of these rows."""
    return "string" if rows.schema[column].dataType.simpleString() == "string" else "long"


def streamed(rows: DataFrame, key: str, order: list[str], columns: list[str], schema: str, fold: Callable[[object, Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """The rows that `fold` yields for each key, given its rows (key, order, columns) in order. schema: long, string and boolean columns."""
    ship(rows.sparkSession)
    names, kinds = zip(*[f.split() for f in schema.split(", ")], strict=True)
    wanted = list(dict.fromkeys([key, *order, *columns]))

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        held: list[tuple] = []
        for k, group in groupby(given, lambda r: r[0]):
            for out in fold(k, group):
                held.append(out)
                if len(held) == 4096:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    return rows.select(*[F.col(c) for c in wanted]).repartition(key).sortWithinPartitions(key, *[c for c in order if c != key]).mapInArrow(run, schema)
