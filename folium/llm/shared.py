"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where that is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="folium-"))
    return "file://" + _own[0]


_open: list[list[str]] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_folder(spark)}/folium/{label}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators wrote to the shared folder within: results that are used must be written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        clear(spark, _open.pop())


def write_table(df: DataFrame, label: str, small: bool = False, scratch: list[str] | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here, lost executors cost nothing before it.

    small: the table holds few or narrow rows, so Spark gathers them into files of a fair size, after the work that makes them.
    scratch: takes the path of a table that its operator removes once nothing reads it any more.
    """
    path = new_folder(df.sparkSession, label)
    if scratch is not None:
        scratch.append(path)
    (df.hint("rebalance") if small else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes tables that are used up; the queries over them are done, so the driver gives back memory too."""
    for path in scratch:
        remove(spark, path)
    scratch.clear()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> bool:
    """Hands memory that the driver's JVM freed outside its heap, mostly by compiling, back to the system; whether this JVM can."""
    jvm = spark._jvm
    try:
        # The bean server's class is hidden from Py4J, its interface is not.
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # other systems, other or older JVMs: nothing is lost
        return False
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system, wherever the shared folder is."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def give_back() -> None:
    """Hands memory that a worker has freed back to the system: workers stay for the next stage, and the JVM beside them needs the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where there is no such function, nothing is lost
        ctypes.CDLL(None).malloc_trim(0)


def tidy_worker(work: Callable) -> Callable:
    """A function over the batches, or the table, of a task that gives its memory back when it is done."""

    @functools.wraps(work)
    def run(given):
        if isinstance(given, pa.Table):
            try:
                return work(given)
            finally:
                give_back()
        return _through(work, given)

    return run


def _through(work: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        yield from work(batches)
    finally:
        give_back()


#: Rows of an Arrow batch: texts are long, and a worker holds a few batches at a time.
BATCH_ROWS = 1_000


def lean_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session hands Python small batches, unless somebody set the size, to whatever number.

    Spark has no such setting for a single query. One that is set, on the session or when it was built, stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not df.sparkSession._jsparkSession.sessionState().conf().contains(name):
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text: Column) -> Column:
    """A-Z as a-z; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def input_bytes(df: DataFrame) -> int:
    """The planner's size of the input, for choosing partition counts; results never depend on it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    return size if size < 1 << 60 else 0
