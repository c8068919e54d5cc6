"""ZIP archives written by executors: parts of stored entries, their central directory, and the file that joins them.

Entries are dealt to tasks in ranges of their order. A task fetches its entries one at a time and writes them, each behind its header, to a
part of its own; only where they went (name, checksum, size, place in the part) comes back. Sums of the parts' sizes turn places in parts into places in the
archive, so tasks write the central directory as well, each that of one part; only the closing record is left to the driver. The parts
follow each other in the archive as they are: joining them copies bytes and looks at none.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import error_text
from . import store

# Fixed values of the ZIP format: signatures of an entry, of its line in the directory, of the closing records; flag for names in UTF-8;
# the first day that it can name; the greatest numbers of its short fields.
_ENTRY, _LINE, _END, _END64, _WHERE64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_UTF8, _DAY, _MOST16, _MOST32 = 0x800, 0x21, 0xFFFF, 0xFFFFFFFF
_PLACES = "part int, file string, n long, name string, crc long, size long, at long"


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"\w+:/", uri) else f"file://{uri}")


def entry_header(name: bytes, crc: int, size: int) -> bytes:
    return struct.pack("<IHHHHHIIIHH", _ENTRY, 20, _UTF8, 0, 0, _DAY, crc, size, size, len(name), 0) + name


def directory_line(name: bytes, crc: int, size: int, offset: int) -> bytes:
    """An entry's line; an offset beyond 32 bits goes to a field of its own."""
    far = offset >= _MOST32
    extra = struct.pack("<HHQ", 1, 8, offset) if far else b""
    return struct.pack("<IHHHHHHIIIHHHHHII", _LINE, 45 if far else 20, 45 if far else 20, _UTF8, 0, 0, _DAY, crc, size, size, len(name), len(extra), 0, 0, 0, 0, min(offset, _MOST32)) + name + extra


def closing_record(entries: int, offset: int, size: int) -> bytes:
    """What ends an archive whose directory begins at ``offset``; more than 65,534 entries, or 4 GB, take the long form as well."""
    long = b""
    if entries >= _MOST16 or offset >= _MOST32 or size >= _MOST32:
        long = struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, entries, entries, size, offset) + struct.pack("<IIQI", _WHERE64, 0, offset + size, 1)
    return long + struct.pack("<IHHHHIIH", _END, 0, 0, min(entries, _MOST16), min(entries, _MOST16), min(size, _MOST32), min(offset, _MOST32), 0)


@dataclass(frozen=True)
class Archive:
    """An archive in parts: the files to be joined, in order; the bytes that end it; and its directory as a table (name, crc, size, offset)."""

    files: list[str]
    end: bytes
    entries: int
    directory: DataFrame


def write_parts(entries: DataFrame, folder: str, fetch: Callable[[str], tuple[str, bytes]], order: tuple[str, ...] = ("ord",), kind: str | None = "image/jpeg") -> Archive:
    """Writes the parts of an archive of entries (id, name, and the columns of ``order``) to ``folder``, which all executors share.

    ``fetch`` runs in the tasks and returns the MIME type and the bytes of an id; one entry is in memory at a time. An error, or another type than
    ``kind``, fails the export: a RuntimeError names the file and the id, and the folder is removed. A task that runs again writes another part, and the one that its
    job has committed counts."""
    spark = entries.sparkSession
    wide = "entry names are limited to 65,535 bytes"

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, file = TaskContext.get().partitionId(), f"{folder}/body-{uuid.uuid4().hex}"
        at, n, out = 0, 0, None
        for batch in batches:
            rows = []
            for id_, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    mime, data = fetch(id_)
                    if kind and mime.split(";", 1)[0].strip().lower() != kind:
                        raise ValueError("the image is not a JPEG" if kind == "image/jpeg" else f"the file is not {kind}")
                    raw = name.encode()
                    if len(raw) > _MOST16:
                        raise ValueError(wide)
                except Exception as error:
                    raise RuntimeError(f"export of {name} (receipt {id_}) failed: {error_text(error)}") from error
                if out is None:
                    system, path = _system(file)
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(path)
                head, crc = entry_header(raw, zlib.crc32(data), len(data)), zlib.crc32(data)
                out.write(head)
                out.write(data)
                rows.append((part, file, n, name, crc, len(data), at))
                at, n = at + len(head) + len(data), n + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["part", "file", "n", "name", "crc", "size", "at"])
        if out is not None:
            out.close()

    try:
        entries.orderBy(*order).select(F.col("id").cast("string"), "name").mapInArrow(body, _PLACES).write.parquet(f"{folder}/places")
    except PySparkException as error:
        store.remove(spark, folder)
        said = re.search(r"RuntimeError: (export of .* failed: .*)", str(error))
        if not said:
            raise
        raise RuntimeError(said[1]) from error
    places = spark.read.schema(_PLACES).parquet(f"{folder}/places")
    length = F.col("size") + F.octet_length("name") + 30
    parts = places.groupBy("part").agg(F.first("file").alias("file"), F.sum(length).alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row for each task
    starts, total = [], 0
    for p in parts:
        starts.append((p["part"], total))
        total += p["bytes"]
    bases = F.broadcast(spark.createDataFrame(starts, "part int, base long"))
    directory = places.join(bases, "part").select("part", "n", "name", "crc", "size", (F.col("base") + F.col("at")).alias("offset"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, file, size = None, None, None, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file]), pa.array([size])], names=["part", "file", "bytes"])

        for batch in batches:
            for k, _, name, crc, length_, offset in zip(*(c.to_pylist() for c in batch.columns)):
                if k != part:
                    if out is not None:
                        yield done()
                    file, part, size = f"{folder}/lines-{uuid.uuid4().hex}", k, 0
                    system, path = _system(file)
                    out = system.open_output_stream(path)
                line = directory_line(name.encode(), crc, length_, offset)
                out.write(line)
                size += len(line)
        if out is not None:
            yield done()

    written = directory.repartition(max(1, min(len(parts), 2_000)), "part").sortWithinPartitions("part", "n").mapInArrow(lines, "part int, file string, bytes long")
    written.write.parquet(f"{folder}/written")
    lists = spark.read.parquet(f"{folder}/written").orderBy("part").collect()
    count = sum(p["n"] for p in parts)
    return Archive([p["file"] for p in parts] + [p["file"] for p in lists], closing_record(count, total, sum(p["bytes"] for p in lists)), count, directory.select("name", "crc", "size", "offset"))


def join_parts(spark: SparkSession, archive: Archive, target: str) -> None:
    """Writes the archive as one file, by one task that copies its parts in blocks: a file has one writer."""
    files, end = archive.files, archive.end

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            system, path = _system(target)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path) as out:
                for file in files:
                    source, place = _system(file)
                    with source.open_input_stream(place) as part:
                        while block := part.read(8 << 20):
                            out.write(block)
                out.write(end)
            yield batch

    spark.range(1).repartition(1).mapInArrow(copy, "id long").collect()


def export_archive(entries: DataFrame, fetch: Callable[[str], tuple[str, bytes]], target: str, order: tuple[str, ...] = ("ord",), kind: str | None = "image/jpeg") -> int:
    """A ZIP file of the entries (id, name, ord), made by executors; returns how many there are. Nothing is left behind at ``target`` if it fails."""
    spark = entries.sparkSession
    folder = store.shared_folder(spark, "archive")
    archive = write_parts(entries, folder, fetch, order, kind)
    join_parts(spark, archive, target)
    store.remove(spark, folder)
    return archive.entries


def read_entries(spark: SparkSession, directory: DataFrame, target: str) -> DataFrame:
    """What an archive file holds at the places of its directory (name, crc, size, offset): name, size, crc (of the bytes read), offset, data. Entries are read where
    they lie, each once, and in parallel."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _system(target)
        with system.open_input_file(path) as file:
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    rows = []
                    for offset in batch.column(0).slice(i, 256).to_pylist():
                        file.seek(offset)
                        head = struct.unpack("<IHHHHHIIIHH", file.read(30))
                        if head[0] != _ENTRY:
                            raise ValueError(f"no entry at {offset} of {target}")
                        name, data = file.read(head[9]).decode(), file.read(head[7])
                        rows.append((name, len(data), zlib.crc32(data), offset, data))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["name", "size", "crc", "offset", "data"])

    return directory.select("offset").mapInArrow(read, "name string, size long, crc long, offset long, data binary")
