"""Rolling admission, idempotent enqueueing and draining as structured streams."""

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesserae.operators.limits import DAY, HOUR


def admitted_stream(calls: DataFrame, per_hour: int = 20, per_day: int = 80) -> DataFrame:
    """(key, call, seconds, admitted, reason) of a stream with key, call and seconds.

    The state of a key is the times of its admitted calls of the last day, so it is bounded by per_day.
    Calls are decided in the order of their times within a micro-batch, and batches as they come.
    """

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = sorted(state.get[0]) if state.exists else []  # in order of time, also where a batch comes late
        rows = pd.concat(list(frames)).sort_values(["seconds", "call"], kind="stable")
        out = []
        for call, now in zip(rows["call"], rows["seconds"], strict=True):
            del held[: bisect_left(held, now - DAY)]
            in_hour = len(held) - bisect_left(held, now - HOUR)
            reason = "hour" if in_hour >= per_hour else "day" if len(held) >= per_day else None
            if reason is None:
                insort(held, int(now))
            out.append((key[0], call, now, reason is None, reason))
        state.update((held,))
        yield pd.DataFrame(out, columns=["key", "call", "seconds", "admitted", "reason"])

    return calls.groupBy("key").applyInPandasWithState(decide, "key long, call long, seconds long, admitted boolean, reason string", "held array<long>", "append", GroupStateTimeout.NoTimeout)


def first_of_day(jobs: DataFrame, key: str, at: str, span: str = "1 day") -> DataFrame:
    """The first job of each idempotency key within the watermark; later ones are no-ops."""
    return jobs.withWatermark(at, span).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Runs a batch handler over all that is there now, then stops. A rerun goes on after the last batch done."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
