"""Sessions, the code that executors need, and intermediate tables in the shared folder."""

import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN_DIRS: dict[str, str] = {}  # by application, of local sessions without a shared folder

#: Bytes of a batch that goes to Python and back, where the session has no setting of its own: rows of long texts are cut by size, not by number.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT = 64 << 20


def session(master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A local session as the tests and the benchmark use it."""
    return (
        SparkSession.builder.master(master)
        .appName("tesserae")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors, once for each application, and bounds the batches that go to Python."""
    if spark.conf.get(_BATCH_SETTING).rstrip("b") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        path = os.path.join(tempfile.mkdtemp(prefix="tesserae-"), "tesserae_code.zip")
        with zipfile.ZipFile(path, "w") as out:
            for p in sorted(root.rglob("*.py")):
                out.write(p, str(p.relative_to(root.parent)))
        spark.sparkContext.addPyFile(path)  # goes out through the driver's file server
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names one.

    Only a local session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = f"file://{tempfile.mkdtemp(prefix='tesserae-shared-')}"
    return _OWN_DIRS[app]


def materialise_parts(df: DataFrame, label: str, by: str, values: tuple) -> list[DataFrame]:
    """Writes df as a table for each value of a column, in one pass, and reads them again, each to be forgotten on its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserae-{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    parts = []
    for value in values:
        own = f"{path}/{by}={value}"
        p = spark._jvm.org.apache.hadoop.fs.Path(own)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)  # a value may have no rows
        out = spark.read.schema(df.drop(by).schema).parquet(own)
        out._tesserae_path = own
        parts.append(out)
    return parts


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it again.

    This cuts the lineage: a lost executor costs the tasks it ran, not the jobs before. The tables
    stay until `forget` or until the folder's own retention removes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserae-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tesserae_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table behind a frame that `materialise` returned, once nothing reads it any more."""
    path = getattr(df, "_tesserae_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of finished jobs go now: Spark deletes them once the driver's references are collected, which
    otherwise waits until the driver needs memory. For operators whose exchanges come one after the other."""
    gc.collect()  # frames with Python functions are part of cycles
    gone = getattr(spark._jvm._gateway_client, "finalizer_deque", ())  # what Python has dropped and the JVM has not been told of yet
    until = time.monotonic() + 3
    while len(gone) and time.monotonic() < until:
        time.sleep(0.02)
    spark._jvm.java.lang.System.gc()
