"""Writers: CSV text with its line ends, and ZIP archives of stored entries."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import error_text
from ..operators import exports as X


def write_csv(lines: DataFrame, header: tuple[str, ...], path: str, order: list) -> None:
    """One text file in ``path``: the header and the lines in order, each ended by CR LF; line feeds in fields stay as they are.

    ``order`` sorts ``lines`` (line, ..); an export is one file by nature, so its rows end in one task, streamed."""
    top = lines.sparkSession.createDataFrame([(X.header_line(header),)], "line string").select("line", F.lit(0).alias("part"))
    body = lines.withColumn("part", F.lit(1))
    rows = body.unionByName(top, allowMissingColumns=True).repartition(1).sortWithinPartitions("part", *order).select("line")
    rows.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_csv_parts(lines: DataFrame, header: tuple[str, ...], path: str, order: list) -> None:
    """The same in as many files as the data asks for, in order of their names, the header as a file of its own before them."""
    spark = lines.sparkSession
    lines.orderBy(*order).select("line").write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/lines")
    spark.createDataFrame([(X.header_line(header),)], "line string").coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/header")


def stored_zip(entries: Iterable[tuple[str, bytes]], target: BinaryIO) -> int:
    """Writes entries uncompressed, with UTF-8 names, one at a time; returns how many."""
    n = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_STORED) as archive:
        for name, data in entries:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.flag_bits |= 0x800
            archive.writestr(info, data, zipfile.ZIP_STORED)
            n += 1
    return n


def export_images(receipts: DataFrame, fetch: Callable[[str], tuple[str, bytes]], target: BinaryIO, on_progress: Callable[[int, str], None] | None = None) -> int:
    """A ZIP of the receipts' images under their numbered names, one image in memory at a time.

    Names are given before anything is fetched. ``fetch`` returns the MIME type and the bytes for a receipt id; an error, or
    anything but a JPEG, ends the export with the file's name and the receipt's id."""
    names = X.image_names(receipts).orderBy("ord")
    total = names.count()

    def entries() -> Iterator[tuple[str, bytes]]:
        for done, row in enumerate(names.toLocalIterator()):
            try:
                kind, data = fetch(row["id"])
                if kind.split(";", 1)[0].strip().lower() != "image/jpeg":
                    raise ValueError("the image is not a JPEG")
            except Exception as error:
                raise RuntimeError(f"export of {row['name']} (receipt {row['id']}) failed: {error_text(error)}") from error
            yield row["name"], data
            if on_progress:
                on_progress(X.progress(done + 1, 0, total), row["name"])

    return stored_zip(entries(), target)
