"""Tables of the document store on disk, laid out so that an edit rewrites, and a lookup reads, only the parts that it concerns.

A table is Parquet partitioned by ``part``, a hash of its key columns, with a fixed number of parts: as many files as the data asks for, however
many keys there are, and tables with the same key and number of parts agree on where a key lies. Rows within a part are sorted by key and their
files carry Bloom filters of it, so that a lookup opens one part and skips what can't hold the key.

A batch of changes replaces the parts it touches and no other file. Its number is written down once the parts are in place: a batch that runs again is
left out, and one that was cut off is repeated, which gives the same rows since the last change of a key counts.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

PART, SCHEMA, BATCHES, NEXT, READY = "part", "_schema", "_batches", "_next-", "_ready"
_CHECKPOINT = "spark.checkpoint.dir"
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share, below ``spark.checkpoint.dir``; removed when the driver's Python ends. Only ``local[..]`` sessions
    that name none get a temporary one."""
    base = spark.sparkContext.getConf().get(_CHECKPOINT) or spark.conf.get(_CHECKPOINT, None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{_CHECKPOINT} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tally-shared-")
        spark.conf.set(_CHECKPOINT, base)
    path = f"{base.rstrip('/')}/store/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    target, system = _hadoop(spark, path)
    system.delete(target, True)


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already
            return


def part_of(keys: Sequence[Column | str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _laid_out(rows: DataFrame, keys: Sequence[str], parts: int):
    placed = rows.withColumn(PART, part_of(keys, parts))
    placed = placed.repartition(min(parts, 20_000), PART).sortWithinPartitions(PART, *keys)
    writer = placed.write.partitionBy(PART).option("compression", "zstd")
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    return writer


def write_table(rows: DataFrame, path: str, keys: Sequence[str], parts: int = 64) -> None:
    """The whole table, anew. ``parts`` stays with the table; choose it so that a part is a few hundred MB."""
    if PART in rows.columns:
        raise ValueError(f"a column can't be named {PART}")
    _laid_out(rows, keys, parts).mode("overwrite").parquet(path)
    target, system = _hadoop(rows.sparkSession, f"{path}/{SCHEMA}")
    out = system.create(target, True)  # a table without rows has no files to tell its columns by
    out.write(bytearray(rows.schema.json().encode()))
    out.close()


def _read(spark: SparkSession, path: str) -> DataFrame:
    target, system = _hadoop(spark, f"{path}/{SCHEMA}")
    stream = system.open(target)
    schema = StructType.fromJson(json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    stream.close()
    return spark.read.schema(schema.add(PART, IntegerType())).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path).drop(PART)


def lookup(spark: SparkSession, path: str, parts: int, **key: str) -> DataFrame:
    """The rows of a key, given by all key columns in their order: one part is opened, and the key is pushed to its files."""
    rows = _read(spark, path)
    for name, value in key.items():
        rows = rows.where(F.col(name) == F.lit(value))
    place = spark.range(1).select(part_of([F.lit(v) for v in key.values()], parts)).first()[0]
    return rows.where(F.col(PART) == place).drop(PART)


def batch_done(spark: SparkSession, path: str, batch: int) -> bool:
    """Whether a batch of this number, or a later one, is in the table."""
    return max(map(int, _names(spark, f"{path}/{BATCHES}")), default=-1) >= batch


def _note(spark: SparkSession, path: str, batch: int) -> None:
    _touch(spark, f"{path}/{BATCHES}/{batch}")
    for old in _names(spark, f"{path}/{BATCHES}"):
        if int(old) < batch:  # the last number says it all
            remove(spark, f"{path}/{BATCHES}/{old}")


def change_parts(spark: SparkSession, path: str, keys: Sequence[str], parts: int, changed_keys: DataFrame, change: Callable[[DataFrame], DataFrame], batch: int | None = None) -> list[int]:
    """Replaces the parts in which ``changed_keys`` (the key columns) lie by ``change`` of their rows; returns these parts.

    Rows of other parts are neither read nor written, and their files keep their names; a part that loses all its rows loses its folder. ``change`` may
    add, drop or alter rows of the changed keys, and must leave rows in their parts. With a ``batch`` number, a batch that is in the table already changes
    nothing. The new parts are written whole beside the table before the first one takes its place; a run that is cut off while they do is finished by
    the next change, or by ``recover``."""
    recover(spark, path)
    if batch is not None and batch_done(spark, path, batch):
        return []
    touched = sorted(r[0] for r in changed_keys.select(part_of(keys, parts)).distinct().collect())  # no more than there are parts
    if touched:
        old = _read(spark, path)
        names = [n for n in old.columns if n != PART]
        folder = f"{path}/{NEXT}{uuid.uuid4().hex}"  # no reader of the table looks into it
        try:
            _laid_out(change(old.where(F.col(PART).isin(touched)).drop(PART)).select(*names), keys, parts).parquet(folder)
            there = [_part(name) for name in _names(spark, folder) if _part(name) is not None]
            if not set(there) <= set(touched):
                raise ValueError("a change moved rows to parts that it doesn't touch")
            for k in {*touched} - {*there}:
                _touch(spark, f"{folder}/_emptied/{k}")
            if batch is not None:
                _touch(spark, f"{folder}/_batch/{batch}")
            _touch(spark, f"{folder}/{READY}")
        except BaseException:
            remove(spark, folder)
            raise
        recover(spark, path)
    elif batch is not None:
        _note(spark, path, batch)
    return touched


def recover(spark: SparkSession, path: str) -> None:
    """Finishes a change that was cut off after all its parts were written, and clears away one that didn't get so far. For the table's one writer."""
    for name in _names(spark, path):
        if not name.startswith(NEXT):
            continue
        folder = f"{path}/{name}"
        if READY in _names(spark, folder):
            for k in _names(spark, f"{folder}/_emptied"):
                remove(spark, f"{path}/{PART}={k}")
            for part in _names(spark, folder):
                if _part(part) is not None:  # one that was put in place before isn't there any more
                    old, system = _hadoop(spark, f"{path}/{part}")
                    system.delete(old, True)
                    if not system.rename(_hadoop(spark, f"{folder}/{part}")[0], old):
                        raise OSError(f"{old} could not be put in place")
            for batch in map(int, _names(spark, f"{folder}/_batch")):
                _note(spark, path, batch)
        remove(spark, folder)


def _names(spark: SparkSession, folder: str) -> list[str]:
    target, system = _hadoop(spark, folder)
    return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []


def _part(name: str) -> int | None:
    return int(name.removeprefix(f"{PART}=")) if name.startswith(f"{PART}=") else None


def _touch(spark: SparkSession, path: str) -> None:
    target, system = _hadoop(spark, path)
    system.create(target, True).close()
