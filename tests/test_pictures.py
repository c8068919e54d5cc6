import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyspark.operators import images as I
from tallyspark.plans.adapter import bitmap, drawn
from tallyspark.sources import pictures as P


def png(rgba):
    height, width = rgba.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + line.tobytes() for line in rgba)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def noise(width, height, alpha=True):
    rgba = np.random.default_rng(1).integers(0, 256, (height, width, 4), np.uint8)
    if not alpha:
        rgba[..., 3] = 255
    return rgba


def test_types_by_content(spark):
    cases = {"image/jpeg": b"\xff\xd8\xff\xe0..", "image/png": png(noise(1, 1)), "image/gif": b"GIF89a..", "image/bmp": b"BM1234", "image/webp": b"RIFF1234WEBPVP8 ", "image/tiff": b"MM\0*", "image/heic": b"\0\0\0\x18ftypheic", "application/pdf": b"%PDF-1.7", None: b"text"}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()] + [(None, bytearray(b"")), (None, None), (None, bytearray(b"GIF88a"))], "kind string, data binary")
    assert rows.where(~P.content_type(F.col("data")).eqNullSafe(F.col("kind"))).count() == 0


def test_files_with_false_names(spark, tmp_path):
    color, plain = noise(7, 5), noise(6, 4, alpha=False)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(png(color))
    (tmp_path / "sub" / "b").write_bytes(bitmap(6, 4, plain.tobytes()))
    (tmp_path / "c.jpg").write_bytes(b"no image at all")
    (tmp_path / "d.png").write_bytes(png(color)[:40])
    name = lambda r: r["path"].rsplit("/", 1)[1]
    got = {name(r): (r["width"], r["height"], r["pixels"] and bytes(r["pixels"]), r["original"] and bytes(r["original"])) for r in P.decode_pictures(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": (7, 5, color.tobytes(), None), "b": (6, 4, plain.tobytes(), None), "c.jpg": (None, None, None, b"no image at all"), "d.png": (None, None, None, png(color)[:40])}
    files = P.read_files(spark, str(tmp_path))
    assert {name(r): r["type"] for r in files.collect()} == {"a.txt": "image/png", "b": "image/bmp", "c.jpg": None, "d.png": "image/png"}
    assert {name(r) for r in P.read_pictures(spark, str(tmp_path), ("image/bmp",)).collect()} == {"b"}
    assert P.check_types(P.read_pictures(spark, str(tmp_path))).count() == 3
    with pytest.raises(PySparkException, match="c.jpg is no known image type"):
        P.check_types(files).collect()


def test_images_beside_receipts(spark, tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "1").write_bytes(png(noise(2, 2)))
    receipts = spark.createDataFrame([("a", "u/1"), ("b", " /u/1 "), ("c", "u/2"), ("d", None), ("e", ""), ("f", "../u/1")], "id string, image_url string")
    got = {r["id"]: r["type"] for r in P.beside(receipts, P.read_files(spark, str(tmp_path)), f"file://{tmp_path}").collect()}
    assert got == {"a": "image/png", "b": "image/png", "c": None, "d": None, "e": None, "f": None}


def test_files_under_their_names(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-02 - Ünï (2).jpg", bytearray(b"1")), ("empty.jpg", None)], "name string, content binary")
    for _ in range(2):  # again: the same files
        assert {(r["name"], r["bytes"]) for r in P.save_files(rows, str(tmp_path / "out")).collect()} == {("2026-01-02 - Ünï (2).jpg", 1), ("empty.jpg", 0)}
    assert {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir()} == {"2026-01-02 - Ünï (2).jpg": b"1", "empty.jpg": b""}
    with pytest.raises(PySparkException, match="can't name a file"):
        P.save_files(rows.withColumn("name", F.lit("../x")), str(tmp_path / "out")).collect()


def averaged(rgba, width, height):
    """The same by adding up each pixel's shares."""
    out = np.zeros((height, width, 4))
    h, w = rgba.shape[:2]
    for y in range(height):
        for x in range(width):
            for j in range(h):
                for i in range(w):
                    share = max(0, min((y + 1) * h / height, j + 1) - max(y * h / height, j)) * max(0, min((x + 1) * w / width, i + 1) - max(x * w / width, i))
                    out[y, x] += share * np.append(rgba[j, i, :3] * (rgba[j, i, 3] / 255), rgba[j, i, 3])
    out /= (h / height) * (w / width)
    out[..., :3] = np.where(out[..., 3:] > 0, out[..., :3] * 255 / np.maximum(out[..., 3:], 1e-9), 0)
    return out


@pytest.mark.parametrize("size", [(7, 5), (3, 2), (1, 1), (10, 3), (9, 9)])
def test_resampling(size):
    for alpha in (True, False):
        rgba = noise(11, 9, alpha)
        assert np.abs(I.resample(rgba, *size).astype(float) - averaged(rgba, *size)).max() <= 0.5 + 1e-6
    assert (I.resample(np.full((300, 400, 4), 77, np.uint8), 123, 45) == 77).all()


def test_export_pixels(spark):
    red, small = np.zeros((1200, 2400, 4), np.uint8), np.array([[[255, 0, 0, 255], [0, 120, 240, 255]]], np.uint8)
    red[..., 0] = red[..., 3] = 255
    rows = spark.createDataFrame([("wide", 2400, 1200, bytearray(red.tobytes()), None), ("gray", 2400, 1200, bytearray(red.tobytes()), True), ("small", 2, 1, bytearray(small.tobytes()), True), ("broken", 9, 9, bytearray(b"x"), True), ("none", None, None, None, None)], "id string, width int, height int, pixels binary, image_grayscale boolean")
    got = {r["id"]: r for r in I.export_pixels(rows).collect()}
    assert {i: (r["width"], r["height"], r["quality"]) for i, r in got.items()} == {"wide": (1000, 500, 0.75), "gray": (1000, 500, 0.65), "small": (2, 1, 0.65), "broken": (9, 9, 0.65), "none": (None, None, 0.75)}
    pixels = lambda i: np.frombuffer(bytes(got[i]["pixels"]), np.uint8).reshape(-1, 4)
    assert (pixels("wide") == [255, 0, 0, 255]).all() and (pixels("gray") == [54, 54, 54, 255]).all() and len(pixels("wide")) == 500_000
    assert pixels("small").tolist() == [[54, 54, 54, 255], [103, 103, 103, 255]] and got["broken"]["pixels"] is None and got["none"]["pixels"] is None


def test_whole_means_and_drawn_images_are_spread(spark):
    rgba = noise(12, 12, alpha=False)
    rgba[0, :2], rgba[1, :2] = [[1, 1, 1, 255]], [[2, 2, 2, 255]]  # a mean of one and a half
    small = I.resample(rgba, 6, 4)
    assert (I.resample(rgba[:2, :2], 1, 1) == [[[2, 2, 2, 255]]]).all()
    assert (small == np.floor(rgba.reshape(4, 3, 6, 2, 4).sum(axis=(1, 3)) / 6 + 0.5)).all()
    images = drawn(spark.range(2500).select(F.col("id").alias("p_partkey"), F.lit(5).alias("p_size")).coalesce(1))
    tasks = images.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == 3 and sum(r["count"] for r in tasks) == 2500 and max(r["count"] for r in tasks) < 1000


def test_broken_files_with_odd_names(spark, tmp_path):
    names = ("no image.txt", "a+b%20c.txt", "ü.jpg", "plain")
    for name in names:
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "an image").write_bytes(png(noise(3, 2)))
    rows = P.decode_pictures(spark, str(tmp_path))
    assert {bytes(r["original"]).decode() for r in rows.where("pixels is null").collect()} == set(names)
    assert [(r["width"], r["height"], r["original"]) for r in rows.where("pixels is not null").collect()] == [(3, 2, None)]


@pytest.mark.parametrize("share", [0.1, 0.4, 0.6, 0.9])
def test_largest_runs(share):
    rng = np.random.default_rng(3)
    for _ in range(30):
        mask = rng.random(rng.integers(1, 20, 2)) < share
        left, best = {tuple(p) for p in np.argwhere(mask).tolist()}, []
        for pixel in np.argwhere(mask).tolist():  # the first pixel of each component comes first
            group, todo = [], [tuple(pixel)]
            while todo:
                y, x = todo.pop()
                if (y, x) in left:
                    left.remove((y, x))
                    group.append((y, x))
                    todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            best = group if len(group) > len(best) else best
        runs = [(y, x) for y, start, end in zip(*(a.tolist() for a in I.largest_runs(mask))) for x in range(start, end)]
        assert runs == sorted(best) and [tuple(p) for p in I.largest_component(mask).tolist()] == runs
