import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import exports as X
from tallyspark.sources import archives as Z
from tallyspark.sources import sinks


jpeg = eval("lambda key: ('image/JPEG; q=1', f'data of {key}'.encode())", {})  # not this module's, which executors don't have


def receipts(spark, n=30):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.col("id").alias("ord"), F.lit("2026-01-02").alias("purchase_date"), F.when(F.col("id") % 3 == 0, "Ünï").otherwise("b").alias("vendor"))


def test_same_archive_as_one_writer(spark, tmp_path):
    target, one = str(tmp_path / "out" / "a.zip"), io.BytesIO()
    rows = receipts(spark).repartition(5)
    assert Z.export_archive(X.image_names(rows), jpeg, target) == sinks.export_images(rows, jpeg, one) == 30
    with zipfile.ZipFile(target) as a, zipfile.ZipFile(one) as b:
        assert a.testzip() is None and [(i.filename, i.compress_type, i.date_time, i.flag_bits & 0x800, a.read(i)) for i in a.infolist()] == [(i.filename, i.compress_type, i.date_time, i.flag_bits & 0x800 or 0x800, b.read(i)) for i in b.infolist()]


def test_nested_order_and_no_entries(spark, tmp_path):
    rows = receipts(spark, 4).withColumn("ord", F.struct((3 - F.col("ord")).alias("shard_ord"), F.lit(0).alias("pos")))
    Z.export_archive(X.image_names(rows), jpeg, str(tmp_path / "a.zip"))
    with zipfile.ZipFile(tmp_path / "a.zip") as a:
        assert [a.read(i) for i in a.infolist()] == [b"data of 3", b"data of 2", b"data of 1", b"data of 0"]
    assert Z.export_archive(X.image_names(rows.limit(0)), jpeg, str(tmp_path / "b.zip")) == 0
    assert zipfile.ZipFile(tmp_path / "b.zip").namelist() == []


def test_more_entries_than_short_numbers_count(spark, tmp_path):
    target = str(tmp_path / "a.zip")
    rows = spark.range(70_000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("ord"), F.concat("id", F.lit(".jpg")).alias("name"))
    archive = Z.write_parts(rows, str(tmp_path / "parts"), lambda i: ("image/jpeg", i.encode()))
    Z.join_parts(spark, archive, target)
    with zipfile.ZipFile(target) as a:
        names = a.namelist()
        assert len(names) == archive.entries == 70_000 and names == [f"{i}.jpg" for i in range(70_000)]
        assert a.read("69999.jpg") == b"69999"
    got = Z.read_entries(spark, archive.directory, target)
    assert got.where("name = concat(decode(data, 'UTF-8'), '.jpg') and size = length(data)").count() == 70_000
    assert got.join(archive.directory, ["name", "crc", "size", "offset"]).count() == 70_000


def test_places_beyond_four_gigabytes():
    line = Z.directory_line(b"n", 1, 2, 5 << 30)
    assert struct.unpack("<I", line[42:46])[0] == 0xFFFFFFFF and struct.unpack("<HHQ", line[47:]) == (1, 8, 5 << 30)
    body = Z.entry_header(b"n", 0, 0)
    end = Z.closing_record(1, 5 << 30, 100)
    assert len(end) == 56 + 20 + 22 and len(Z.closing_record(1, len(body), 47)) == 22
    assert struct.unpack("<Q", end[48:56])[0] == 5 << 30 and struct.unpack("<Q", end[64:72])[0] == (5 << 30) + 100


def test_a_failed_image_fails_the_export(spark, tmp_path):
    image = jpeg

    def broken(key):
        if key == "17":
            raise OSError("gone")
        return image(key)

    with pytest.raises(RuntimeError, match=r"receipt 17\) failed: .*gone$"):
        Z.export_archive(X.image_names(receipts(spark)), broken, str(tmp_path / "a.zip"))
    with pytest.raises(RuntimeError, match="is not a JPEG"):
        Z.export_archive(X.image_names(receipts(spark)), lambda i: ("image/png", b""), str(tmp_path / "a.zip"))
    assert not (tmp_path / "a.zip").exists()
