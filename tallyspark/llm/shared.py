"""Intermediate tables in the folder all executors share, and the session settings the operators rely on."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

_CHECKPOINT = "spark.checkpoint.dir"
_folders: dict[str, tuple[SparkSession, str]] = {}
_kept: dict[int, tuple[weakref.ref, str]] = {}


#: Rows and bytes of an Arrow batch, where the session has Spark's own defaults (these come first).
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": (("-1", "268435456", "67108864"), str(2 << 20))}


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the executors, and bound the Arrow batches that reach Python by bytes as well as rows. A session's own
    settings stay; results are lazy, so the bounds hold for as long as the session does."""
    ship(spark)
    for key, (usual, bound) in _BATCHES.items():
        if spark.conf.get(key, None) in (None, *([usual] if isinstance(usual, str) else usual)):
            spark.conf.set(key, bound)
    return spark


def base_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Only where none is set (local tests) a temporary folder takes its place."""
    base = spark.sparkContext.getConf().get(_CHECKPOINT) or spark.conf.get(_CHECKPOINT, None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{_CHECKPOINT} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tally-shared-")
        spark.conf.set(_CHECKPOINT, base)
        _folders[base] = (spark, base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one intermediate; removed when the driver's Python ends."""
    path = f"{base_folder(spark)}/tally/{name}-{uuid.uuid4().hex}"
    _folders[path] = (spark, path)
    return path


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a folder or file of the shared folder, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else f"file://{uri}")


def read_part(folder: str, columns: list[str]) -> pa.Table | None:
    """What one folder of a table that Spark wrote with partitionBy holds, for tasks that need some folders and not a shuffle; None for no rows."""
    system, path = file_system(folder)
    files = [x.path for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.path.endswith(".parquet")]
    tables = [pq.read_table(x, filesystem=system, partitioning=None, columns=columns) for x in sorted(files)]
    return pa.concat_tables(tables).combine_chunks() if tables else None


def forget(spark: SparkSession, path: str) -> None:
    """Delete an intermediate that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _folders.pop(path, None)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and the files outlive executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _kept[id(out)] = (weakref.ref(out), path)
    return out


def drop(*kept: DataFrame) -> None:
    """Delete what ``keep`` wrote for these tables, once nothing that is still to run reads them."""
    for df in kept:
        of, path = _kept.pop(id(df), (None, None))
        if of is not None and of() is df:
            forget(df.sparkSession, path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@atexit.register
def _clean() -> None:
    for path, (spark, _) in list(_folders.items())[::-1]:
        try:
            forget(spark, path)
        except Exception:  # the session may be gone already
            return
