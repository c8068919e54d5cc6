"""Image files: types told by their leading bytes, images beside the receipts that name them, decoded pixels, and files under given names.

Decoding is left to Spark's ``image`` source (the JVM's codecs: JPEG, PNG, GIF, BMP); a file's name says nothing about what is in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What files of each type begin with, in hexadecimal; dots stand for any digit.
LEADING = {
    "image/jpeg": "FFD8FF", "image/png": "89504E470D0A1A0A", "image/gif": "474946383[79]61", "image/bmp": "424D", "image/webp": "52494646........57454250",
    "image/tiff": "(49492A00|4D4D002A)", "image/heic": "........66747970(68656963|68656978|68657663|6D696631)", "application/pdf": "255044462D",
}
TAKEN = tuple(t for t in LEADING if t.startswith("image/"))


def content_type(data: Column) -> Column:
    """The MIME type that a file's first bytes stand for, null if none is known."""
    head = F.hex(F.substring(data, 1, 12))
    return F.coalesce(*(F.when(head.rlike(f"^{start}"), kind) for kind, start in LEADING.items()))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The files below a folder: path, length, modified, type (by content, null if unknown), content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), content_type(F.col("content")).alias("type"), "content")


def read_pictures(spark: SparkSession, path: str, types: tuple[str, ...] = TAKEN) -> DataFrame:
    """The files that are images of the given types, whatever they are called."""
    return read_files(spark, path).where(F.col("type").isin(*types))


def check_types(files: DataFrame, types: tuple[str, ...] = TAKEN) -> DataFrame:
    """``files`` (path, type, ..), refusing the whole lot as soon as one of another type is read."""
    wrong = F.concat(F.col("path"), F.lit(" is "), F.coalesce("type", F.lit("no known image type")))
    return files.withColumn("type", F.when(F.col("type").isin(*types), F.col("type")).otherwise(F.raise_error(wrong).cast("string")))


def beside(receipts: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Receipts with the ``type`` and ``content`` of the file that their image_url, a path below ``root``, names; nulls where there is none, or a blank path.

    Both sides meet on the path alone; a path leading out of ``root`` finds nothing."""
    top = root.rstrip("/") + "/"
    own = F.regexp_replace(F.col("path"), "^" + re.escape(re.sub(r"^\w+:/+", "/", top)), "")
    placed = files.withColumn("path", F.regexp_replace("path", r"^\w+:/+", "/")).select(own.alias("_path"), "type", "content")
    return receipts.join(placed, F.regexp_replace(F.trim("image_url"), "^/+", "") == F.col("_path"), "left").drop("_path")


def _rgba(images: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for widths, heights, channels, datas in images:
        out = []
        for w, h, n, data in zip(widths, heights, channels, datas):
            if not w or w <= 0 or h <= 0 or data is None or n not in (1, 3, 4):
                out.append(None)
                continue
            own = np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(n))
            pixels = np.full((int(h), int(w), 4), 255, np.uint8)
            pixels[..., :3] = own[..., 2::-1] if n > 1 else own
            if n == 4:
                pixels[..., 3] = own[..., 3]
            out.append(pixels.tobytes())
        yield pd.Series(out, dtype=object)


def decode_pictures(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, pixels, original): RGBA pixels of every file below a folder; for one that can't be decoded its bytes in ``original``, and nulls."""
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path).select("image.*")
    known = F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & F.col("data").isNotNull() & F.col("nChannels").isin(1, 3, 4), F.lit(False))
    pixels = F.pandas_udf(_rgba, "binary")("width", "height", "nChannels", "data")
    decoded = images.where(known).select(F.col("origin").alias("path"), "width", "height", pixels.alias("pixels"), F.lit(None).cast("binary").alias("original"))
    plain = lambda c: F.regexp_replace(c, r"^\w+:/+", "/")
    none = [F.lit(None).cast(images.schema[c].dataType).alias(c) for c in ("width", "height")]
    broken = images.where(~known).select(F.col("origin").alias("path"), plain(F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))).alias("_path"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(plain("path").alias("_path"), F.col("content").alias("original"))
    kept = broken.join(files, "_path", "left").select("path", *none, F.lit(None).cast("binary").alias("pixels"), "original")
    return decoded.unionByName(kept)  # pixels are never shuffled


def save_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row's ``content`` to a file called ``name`` in ``folder``, which all executors reach; gives (name, path, bytes) when it is run. A file appears whole or
    not at all, and a task that runs again writes the same file. Names may not lead out of the folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder if re.match(r"\w+:/", folder) else f"file://{folder}")
        for batch in batches:
            rows = []
            system.create_dir(top, recursive=True)
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not name or "/" in name or name in (".", ".."):
                    raise ValueError(f"{name!r} can't name a file")
                aside, path = f"{top}/.{uuid.uuid4().hex}", f"{top}/{name}"
                data = content.as_py() or b""
                with system.open_output_stream(aside) as out:
                    out.write(data)
                system.move(aside, path)
                rows.append((name, path, len(data)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["name", "path", "bytes"])

    return files.select("name", F.col("content").cast("binary")).mapInArrow(write, "name string, path string, bytes long")
