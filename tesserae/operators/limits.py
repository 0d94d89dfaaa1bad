"""Rolling windows and rate limits. A decision that depends on earlier decisions is an ordered fold over
its key's rows; plain counts are range windows."""

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.folds import streamed

HOUR, DAY = 3600, 86_400


def rolling_counts(events: DataFrame, key: str, seconds: str, slice_seconds: int = DAY) -> DataFrame:
    """events with in_hour and in_day: rows of the key in the last hour and day, both ends included.

    A key's rows are dealt by time: each slice of `slice_seconds` is counted on its own and is also given the day before it, of
    which only key and time go along. A row is in 1 + DAY / slice_seconds slices; shorter ones spread a hot key further.
    """
    own = F.floor(F.col(seconds) / slice_seconds)
    halo = F.explode_outer(F.sequence(own, F.floor((F.col(seconds) + DAY) / slice_seconds)))
    dealt = events.withColumns({"_key": F.col(key), "_s": F.col(seconds), "_own": own, "_slice": halo})
    mine = F.col("_own").eqNullSafe(F.col("_slice"))
    dealt = dealt.select(*[F.when(mine, F.col(f"`{c}`")).alias(c) for c in events.columns], "_key", "_s", "_slice", mine.alias("_mine"))
    window = lambda span: Window.partitionBy("_key", "_slice").orderBy("_s").rangeBetween(-span, 0)
    counted = dealt.withColumn("in_hour", F.count("*").over(window(HOUR))).withColumn("in_day", F.count("*").over(window(DAY)))
    return counted.where("_mine").select(*events.columns, "in_hour", "in_day")


def admissions(calls: DataFrame, key: str, seconds: str, call: str, per_hour: int = 20, per_day: int = 80, known: str | None = None) -> DataFrame:
    """(key, call, seconds, admitted, reason, warned): a call passes if fewer than the caps were admitted in
    the hour and the day before it; the hour is asked first, and a refused call uses up nothing. warned: the
    hour's count has come to the soft limit, eight tenths of the cap."""
    soft = max(1, int(0.8 * per_hour))
    columns = f"{key} long, {call} long, {seconds} long, admitted boolean, reason string, warned boolean"

    def fold(k, rows):
        day, hour = deque(), deque()  # the times admitted in the last day and hour, `per_day` and `per_hour` at most
        for _, now, c, before in rows:
            while day and now - day[0] > DAY:
                day.popleft()
            while hour and now - hour[0] > HOUR:
                hour.popleft()
            reason = None if before else "hour" if len(hour) >= per_hour else "day" if len(day) >= per_day else None
            if reason is None:
                day.append(now)
                hour.append(now)
            if before:
                continue
            yield k, c, now, reason is None, reason, reason is None and len(hour) >= soft

    before = F.lit(False) if known is None else F.col(known)
    rows = calls.select(F.col(key).cast("long"), F.col(call).cast("long"), F.col(seconds).cast("long"), before.alias("_known"))
    return streamed(rows, key, [seconds, call], ["_known"], columns, fold)


def capped_pages(pages: DataFrame, host: str, order: list[Column], cap: int, allowed: Column | None = None) -> DataFrame:
    """The pages that a run fetches: the first `cap` of each host among those that robots allow, with `ordinal`."""
    from tesserae.operators.pick import top_by

    return top_by(pages.where(allowed) if allowed is not None else pages, [host], order, cap, "ordinal")


def waits(requests: DataFrame, host: str, seconds: str, tie: str, interval: float) -> DataFrame:
    """requests with wait: what is left of the interval since the host's request before."""
    before = F.lag(seconds).over(Window.partitionBy(host).orderBy(seconds, tie))
    return requests.withColumn("wait", F.coalesce(F.greatest(F.lit(0.0), F.lit(float(interval)) - (F.col(seconds) - before)), F.lit(0.0)))


def schedule(requests: DataFrame, host: str, seconds: str, tie: str, interval: int, cap: int, page: str) -> DataFrame:
    """(host, tie, starts, refused): requests in order, each no sooner than the interval after the one before;
    pages over the cap are refused and take no time. Requests that are no pages use time only."""
    columns = f"{host} string, {tie} long, starts long, refused boolean"

    def fold(h, rows):
        last, pages = None, 0
        for _, now, t, is_page in rows:
            if is_page and pages >= cap:
                yield h, t, None, True
                continue
            pages += bool(is_page)
            last = now if last is None else max(now, last + interval)
            yield h, t, last, False

    return streamed(requests, host, [seconds, tie], [page], columns, fold)
