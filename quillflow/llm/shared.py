"""Tables, shared working storage and small helpers that the operators have in common."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the ASCII space and the controls 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quillflow-")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in
    tests, a temporary folder serves a local master only."""
    key = "spark.checkpoint.dir"
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{key} has to name a folder that driver and executors share")
    return (root or _local_root()).rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/quillflow/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write df to shared storage once, and read it back from there."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    shrink_heap(spark)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that written() made, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shrink_heap(spark: SparkSession, above: int = 360 << 20) -> None:
    """Give back the driver's memory: the heap where it has grown, since plans leave garbage, which the JVM would let pile up to the heap's limit, and what
    the C library holds on to after the JVM freed it."""
    if spark._jvm.java.lang.Runtime.getRuntime().totalMemory() > above:
        with _little_spare(spark):
            spark._jvm.java.lang.System.gc()
    trim_native(spark)


@contextmanager
def _little_spare(spark: SparkSession, percent: int = 40) -> Iterator[None]:
    """Meanwhile a full collection leaves this share of the heap free at most (70 as a rule), on JVMs where that can be said."""
    jvm, flag, before = spark._jvm, "MaxHeapFreeRatio", None
    try:
        about = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
        before = about.getVMOption(flag).getValue()
        about.setVMOption(flag, str(max(percent, int(about.getVMOption("MinHeapFreeRatio").getValue()))))
    except Py4JError:  # another JVM
        pass
    try:
        yield
    finally:
        if before is not None:
            about.setVMOption(flag, before)


def trim_native(spark: SparkSession) -> bool:
    """Let the C library give back memory that the driver's JVM has freed (compilers, collectors, threads that ended). Whether this JVM can."""
    jvm = spark._jvm
    try:
        server = jvm.java.lang.Class.forName("javax.management.MBeanServer")  # the object's own class is not open to reflection
        invoke = next(m for m in server.getMethods() if m.getName() == "invoke")
        call = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JError:  # an older or another JVM, or not Linux
        return False
    return True


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Batches between JVM and Python hold few texts, so that neither side needs much memory for them. Lower limits that are set already stay."""
    for key, limit in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= limit):
            spark.conf.set(name, str(limit))


def short_plans(spark: SparkSession, limit: int = 200_000) -> None:
    """Plans with large literals are not kept as text at full length: the driver holds on to the texts of past plans."""
    spark.conf.set("spark.sql.maxPlanStringLength", str(limit))


def ascii_lower(column):
    """Lower-case A to Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; extra columns, whatever their names, take no part."""
    return df.select(*(df[n] for n in names))


# --- joins with keys that a large share of the rows may hold ---------------------------------------------------------------
#
# The rows of a key are dealt to SALTS parts by a hash of another column. What is joined to them is there once for each part that the key has, so a rare
# key costs one row, and a frequent one SALTS at most.

SALTS = 64


def salt(by: Column | str) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")


def salts(by: Column | str) -> Column:
    """Which parts the rows of a group are in, as an aggregate: a bit for each part."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), salt(by)))


def each_salt(bits: Column | str) -> Column:
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit(bits, k) == 1))


def join_hot(rows: DataFrame, facts: DataFrame, on: str, by: str, like: DataFrame | None = None) -> DataFrame:
    """rows with the fact of their key (inner); facts has a row for each key at most. by: a column of rows that differs within a key. like: the same
    keys and by-columns as in rows, where rows are wide or costly to make twice."""
    parts = (rows if like is None else like).groupBy(on).agg(salts(by).alias("_parts"))
    dealt = facts.join(parts, on).withColumn("_salt", each_salt(F.col("_parts"))).drop("_parts")
    return rows.withColumn("_salt", salt(by)).join(dealt, [on, "_salt"]).drop("_salt")
