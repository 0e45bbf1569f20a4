"""What the operators of this subpackage share: shipping code, reading tables, durable intermediates."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that none needs it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="kairosight-")
    target = os.path.join(folder, "kairosight_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent).as_posix())
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; read by Spark alone, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="kairosight-shared-")  # one machine, one process: shared by itself
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is temporary anyway
        pass


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kairosight/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # shuffle files of what is written now go once the driver's references do
    atexit.register(_remove, spark, path)
    found = spark.read.schema(df.schema).parquet(path)
    _paths[id(found)] = path
    weakref.finalize(found, _paths.pop, id(found), None)
    return found


_paths: dict[int, str] = {}


def drop(*tables: DataFrame) -> None:
    """Delete tables that durable() returned and that nothing reads any more."""
    for found in tables:
        path = _paths.pop(id(found), None)
        if path:
            _remove(found.sparkSession, path)


#: Bytes of an Arrow batch that Python gets, where the session sets none.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_releases: list[Callable[[], None]] = []
_last: list[str] = [""]


def remembers(release: Callable[[], None]) -> Callable[[], None]:
    """Register what drops a module's memory in a worker; it runs when the worker turns to another operator."""
    _releases.append(release)
    return release


def _begin(name: str) -> None:
    if _last[0] != name:
        _last[0] = name
        for release in _releases:
            release()
        pa.set_memory_pool(pa.system_memory_pool())


def _end() -> None:
    """Give freed memory back to the machine: workers are kept, and an executor may have several idle ones."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def prepare_batches(spark: SparkSession) -> None:
    """Send the package to the workers, and bound Arrow batches in bytes where the session does not."""
    ship(spark)
    if not spark.conf.get(_BATCH, None):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def map_tasks(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of a task's batches, which are bounded in bytes."""
    prepare_batches(df.sparkSession)
    name = f"{fn.__module__}.{fn.__qualname__}"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(name)
        try:
            yield from fn(batches)
        finally:
            _end()

    return df.mapInArrow(each, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """map_tasks with a function of one batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    each.__module__, each.__qualname__ = fn.__module__, fn.__qualname__
    return map_tasks(df, each, schema)
