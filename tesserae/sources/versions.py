"""State in numbered versions, each created only if it is not there, so that of two writers one loses and decides again.

A version is a small file that names a table of rows; the newest number is the state. A writer reads it, decides, writes its
rows beside it, and creates the next number. Where another writer has taken that number, its own rows go and it begins again
with what the other left. Whatever cannot be read, decided or written blocks: nothing is admitted on state that is not known.
"""

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.limits import DAY, admissions
from tesserae.session import materialise

COLUMNS = "key long, seconds long"
KEPT = 16  # versions that stay


class StateBlocked(RuntimeError):
    """The state cannot be read or written, so nothing may be decided on it."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that are there, in order."""
    fs, p = _path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def newest(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """(number, rows) of the newest version; number 0 and no rows where there is none. A version that is broken blocks."""
    try:
        found = numbers(spark, path)
        if not found:
            return 0, spark.createDataFrame([], COLUMNS)
        fs, p = _path(spark, f"{path}/v{found[-1]}")
        text = "\n".join(r["value"] for r in spark.read.text(p.toString()).collect())
        named = json.loads(text)
        rows = spark.read.schema(COLUMNS).option("mode", "FAILFAST").json(f"{path}/{named['data']}")
        if rows.where("key IS NOT NULL AND seconds IS NOT NULL").count() != named["rows"]:
            raise ValueError(f"version {found[-1]} does not have its {named['rows']} rows")
        return found[-1], rows
    except Exception as e:
        raise StateBlocked(f"{path} cannot be read: {e}") from e


def create(spark: SparkSession, path: str, number: int, named: dict) -> bool:
    """Creates a version whole, unless its number is taken."""
    fs, p = _path(spark, f"{path}/v{number}")
    text = json.dumps(named)
    if fs.getScheme() == "file":
        own = p.toUri().getPath()
        draft = f"{os.path.dirname(own)}/.draft-{uuid.uuid4().hex}"
        with open(draft, "x") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, own)  # fails where the name is taken
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            return False
        raise StateBlocked(f"{p.toString()} cannot be created: {e}") from e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def decide(spark: SparkSession, path: str, calls: DataFrame, per_hour: int, per_day: int, attempts: int = 20) -> DataFrame:
    """(key, call, seconds, admitted, reason, warned) of new calls (key, call, seconds), and the state that counts what was admitted.

    The state keeps admitted calls for a day after the latest call. StateBlocked where it is broken, cannot be written, or
    other writers come first `attempts` times.
    """
    calls = materialise(calls.selectExpr("key", "call", "seconds"), "calls")
    for _ in range(attempts):
        number, before = newest(spark, path)
        known = before.selectExpr("key", "cast(null as long) as call", "seconds", "true as known")
        decided = materialise(admissions(known.unionByName(calls.selectExpr("*", "false as known")), "key", "seconds", "call", per_hour, per_day, "known"), "decided")
        data = f"data-{uuid.uuid4().hex}"
        try:
            after = before.unionByName(decided.where("admitted").select("key", "seconds"))
            latest = after.agg(F.max("seconds")).first()[0]
            after = after.where(F.col("seconds") >= (latest or 0) - DAY)
            after.write.json(f"{path}/{data}")
            rows = spark.read.schema(COLUMNS).json(f"{path}/{data}").count()
            if create(spark, path, number + 1, {"data": data, "rows": rows}):
                forget_old(spark, path, number + 1 - KEPT)
                return decided
        except StateBlocked:
            raise
        except Exception as e:
            raise StateBlocked(f"{path} cannot be written: {e}") from e
        fs, p = _path(spark, f"{path}/{data}")
        fs.delete(p, True)
    raise StateBlocked(f"{path} was written by others {attempts} times")


def forget_old(spark: SparkSession, path: str, upto: int) -> None:
    """Removes versions up to a number, and their rows."""
    for n in numbers(spark, path):
        if n <= upto:
            fs, p = _path(spark, f"{path}/v{n}")
            named = json.loads("".join(r["value"] for r in spark.read.text(p.toString()).collect()))
            fs.delete(p, False)
            fs.delete(_path(spark, f"{path}/{named['data']}")[1], True)


def guarded(spark: SparkSession, path: str, calls: DataFrame, per_hour: int, per_day: int) -> DataFrame:
    """As `decide`, but where the state blocks, every call is refused with the reason `state`."""
    try:
        return decide(spark, path, calls, per_hour, per_day)
    except StateBlocked:
        return calls.selectExpr("key", "call", "seconds", "false as admitted", "'state' as reason", "false as warned")
