"""Session helpers: the time zone the library works in and the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_SETTLED: list[str] = []


def pin_utc(spark: SparkSession) -> SparkSession:
    """Wall-clock arithmetic on `timestamp_ntz` goes through the session zone; keep it at UTC.

    Parsing the log makes one method of more than 8,000 bytes, which the JVM never compiles; where the session leaves
    the limit at Spark's own, such plans are cut into smaller methods.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get(_METHOD_LIMIT) == "65535":
        spark.conf.set(_METHOD_LIMIT, "8000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named in `spark.checkpoint.dir`.

    Where that is unset, a local master (a laptop or a test) gets a local folder, which goes when Python ends; on a
    cluster there is no such folder, so a missing setting is an error.
    """
    named = spark.conf.get(_CHECKPOINT_DIR, None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError(f"{_CHECKPOINT_DIR} must name a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="kerbline-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set(_CHECKPOINT_DIR, named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _SETTLED.append(path)
    return path


def settle(df, label: str):
    """Write a table used by many later jobs and read it back.

    Cuts the lineage through storage that outlives executors. Files are packed tightly: text takes the most room there.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._settled_at = path
    return table


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = hadoop(path)
        place.getFileSystem(conf).delete(place, True)


def discard(*tables) -> None:
    """Delete the files of settled tables that nothing reads any more, here or in a result handed out."""
    for table in tables:
        path = table.__dict__.get("_settled_at")
        if path in _SETTLED:
            _SETTLED.remove(path)
            _delete(table.sparkSession, [path])


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs whose tables are settled.

    Spark removes them once the driver has collected the plans that made them, which long after the last job of a chain
    has not happened by itself; until then they fill the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: A settled lookup of at most so many rows may be broadcast.
BROADCAST_ROWS = 100_000


def lookup(df, label: str):
    """A lookup table, written and counted: broadcast within the bound, so that the large side need not be shuffled by
    a key that few values dominate; beyond the bound the join is left to Spark, which splits skewed keys of tables."""
    from pyspark.sql import functions as F

    table = settle(df, label)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def join_grown(left, right, on, how: str = "inner"):
    """A join of two tables that both grow with the log: both sides are shuffled, whatever their files weigh.

    Spark takes the size of a written table's files for that of its rows. Packed tightly, millions of rows can be a few
    megabytes of files, would pass for a small side and be gathered in the driver.
    """
    return left.join(right.hint("merge"), on, how)


def release(spark: SparkSession) -> int:
    """Delete every path given out so far, once no result that reads them is needed. Returns how many there were."""
    gone, _SETTLED[:] = list(_SETTLED), []
    _delete(spark, gone)
    return len(gone)
