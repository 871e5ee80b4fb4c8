"""Cutting lineage: intermediate tables are written as Parquet in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a bounded lookup table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Seconds between two collections of the executors' garbage.
SHRINK_S = 2.0
_shrunk: dict[str, float] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder in the warehouse, or on a single machine (tests, a laptop) a temporary one, that is then set for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        alone = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        found = "file://" + tempfile.mkdtemp(prefix="joinwright-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/joinwright-tables"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    lead = ""
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def quoted(names: list[str]) -> list[str]:
    """Column names as expressions, whatever characters they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one: applications that share a cluster don't meet there."""
    return f"{shared_folder(spark)}/joinwright-{spark.sparkContext.applicationId}"


def saved(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Computes df once, and returns it as read from the shared folder: a lost executor costs no recomputation upstream.

    With ``tasks`` it is written by so many at most: small tables in hundreds of partitions would be hundreds of files.
    """
    df = df.coalesce(tasks) if tasks else df
    shrink(df.sparkSession)
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    trim(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def trim(spark: SparkSession) -> bool:
    """Has the driver's JVM return to the system what its native allocator keeps free, hundreds of MB after many plans; False if this JVM cannot."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        # the server's own class isn't open to calls from outside, its interface is
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        args = new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # a JVM without this command
        return False
    return True


def shrink(spark: SparkSession) -> int:
    """Has each executor's JVM collect its garbage and return the heap that it no longer fills, every SHRINK_S seconds at most; how many were asked.

    As many tasks as executors: where all are idle, as between the jobs of an operator, the scheduler gives each one.
    """
    if time.monotonic() < _shrunk.get(spark.sparkContext.applicationId, -SHRINK_S) + SHRINK_S:
        return 0
    executors = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1  # without the driver, which is all there is in local mode
    _shrunk[spark.sparkContext.applicationId] = time.monotonic()
    if executors:
        spark.range(0, executors, 1, executors).selectExpr("reflect('java.lang.System', 'gc')").collect()
    return executors


def _delete(spark: SparkSession, pattern: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for x in fs.globStatus(at) or []:
        fs.delete(x.getPath(), True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` returned, once all that was derived from them is itself saved."""
    for df in tables:
        _delete(df.sparkSession, df._saved_at)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, which it does once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Deletes what ``saved`` has written for this application; only for use when no result of an operator is still to be read."""
    _delete(spark, f"{own_folder(spark)}/*")


def size_estimate(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame, per_bucket: int = 8 << 20) -> int:
    """Hash buckets for packed shuffles over df: in proportion to its bytes, and at least two for each core.

    An estimate beyond a petabyte is the optimizer's word for not knowing, as for rows that come from the driver; then there are
    as many as the session has shuffle partitions.
    """
    size = size_estimate(df)
    if size >= 1 << 50:
        return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return max(-(-size // per_bucket), 2 * df.sparkSession.sparkContext.defaultParallelism)


#: Bytes of input that a task is given at least, where there are more tasks than cores.
TASK_BYTES = 16 << 20


def task_count(df: DataFrame) -> int:
    """Tasks enough for tables that are no larger than df: one for each core, or for TASK_BYTES. Each file that a task writes is a moment at which its executor's memory may count twice."""
    return max(df.sparkSession.sparkContext.defaultParallelism, min(size_estimate(df), 1 << 50) // TASK_BYTES)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it has at most ``limit`` rows, else as it is (a shuffled join)."""
    return df.hint("broadcast") if df.limit(limit + 1).count() <= limit else df


#: Groups of so great a share of all rows, as one in GROUPS, or of two where rows are few, may be broadcast: there are GROUPS at most.
GROUPS = 50_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows left-joined to groups (saved, with the rows of each group as ``n``): no group, however large, meets in one task.

    Few groups are broadcast; of many, those that hold a fixed share of the rows, and only the rows of the others are shuffled.
    """
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(groups.hint("broadcast"), key, "left")
    large = F.col("n") >= max(2, total // GROUPS)
    big = groups.filter(large).hint("broadcast")
    rest = rows.join(big.select(key), key, "left_anti").join(groups.filter(~large), key, "left")
    return rows.join(big, key).unionByName(rest)
