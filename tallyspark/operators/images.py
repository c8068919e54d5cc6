"""Pixel operators: luma, bright-paper detection, crop rectangles, resize dimensions.

An image is (width, height, pixels): RGBA bytes, row by row. Pixels go to numpy in Arrow batches; rectangles are columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let

# Largest side that is analysed, padding of a crop, the margin below which a side counts as cropped, and the width of an exported image.
ANALYSIS_MAX, MARGIN, CROPPED_MARGIN, EXPORT_MAX = 800, 0.04, 0.06, 1000
CORNERS = "struct<tl:struct<x:double,y:double>,tr:struct<x:double,y:double>,br:struct<x:double,y:double>,bl:struct<x:double,y:double>,confidence:double>"


def luma(rgba: np.ndarray) -> np.ndarray:
    """Luma of an (.., 4) array, rounded half up."""
    return np.floor(0.2126 * rgba[..., 0] + 0.7152 * rgba[..., 1] + 0.0722 * rgba[..., 2] + 0.5).astype(np.uint8)


def grayscale(rgba: np.ndarray) -> np.ndarray:
    """The image with its luma in all three colours; alpha stays."""
    out = rgba.copy()
    out[..., :3] = luma(rgba)[..., None]
    return out


def upper_median(histogram: np.ndarray) -> int:
    """The value at which more than half (rounded down) of the histogram is reached."""
    return int(np.searchsorted(np.cumsum(histogram), histogram.sum() // 2, "right"))


def largest_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest 8-connected component as runs in page order (y, start, end, the end not being part of it); of equal ones that whose first pixel comes first.

    Runs of each row are joined to the runs above that they touch: each takes the first of those that it meets, and its first one in turn, until none changes."""
    height, width = mask.shape
    padded = np.zeros((height, width + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    (y, start), end = np.nonzero(step == 1), np.nonzero(step == -1)[1]
    if not len(y):
        return y, start, end
    span = width + 2  # places of a row, more than any end
    low, high = np.searchsorted(y * span + end, (y + 1) * span + start), np.searchsorted(y * span + start, (y + 1) * span + end, "right")  # touching by a corner counts
    many = high - low
    above = np.repeat(np.arange(len(y)), many)
    below = np.arange(len(above)) + np.repeat(low - (np.cumsum(many) - many), many)
    roots = np.arange(len(y))
    while len(above):
        p, q = roots[above], roots[below]
        apart = p != q
        if not apart.any():
            break
        np.minimum.at(roots, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while not np.array_equal(further := roots[roots], roots):
            roots = further
    own = roots == np.argmax(np.bincount(roots, end - start, len(y)))
    return y[own], start[own], end[own]


def largest_component(mask: np.ndarray) -> np.ndarray:
    """(y, x) of the pixels of ``largest_runs``."""
    y, start, end = largest_runs(mask)
    size = end - start
    return np.stack([np.repeat(y, size), np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)], axis=1)


def detect_corners(rgba: np.ndarray) -> dict | None:
    """Corners of bright paper on a darker ground with a confidence, or nothing: for low contrast, a bright border, fragments
    and (nearly) full frames."""
    height, width = rgba.shape[:2]
    if not width or not height:
        return None
    gray = luma(rgba)
    depth = max(1, int(min(width, height) * 0.05 + 0.5))
    border = np.ones((height, width), bool)
    border[depth : height - depth, depth : width - depth] = False
    middle = upper_median(np.bincount(gray[border], minlength=256))
    threshold = min(250, max(180, middle + 25))
    mask = gray >= threshold
    if np.count_nonzero(mask & border) / np.count_nonzero(border) > 0.45:
        return None
    y, start, end = largest_runs(mask)
    if not len(y):
        return None
    top, left, bottom, right = y[0], start.min(), y[-1], end.max() - 1
    box_width, box_height = int(right - left + 1), int(bottom - top + 1)
    fill, area = int((end - start).sum()) / (box_width * box_height), box_width * box_height / (width * height)
    if fill < 0.45 or not 0.02 <= area <= 0.92:
        return None
    confidence = min(1.0, fill * 0.65 + min(1.0, (threshold - middle) / 100) * 0.35)
    points, sure = [], 1.0
    diagonal = max(1.0, float(np.hypot(box_width, box_height)))
    for x, corner, ends in ((left, top, start), (right, top, end - 1), (right, bottom, end - 1), (left, bottom, start)):  # the nearest pixel ends a run
        away = np.hypot(ends - x, y - corner)
        k = int(np.argmin(away))
        points.append({"x": float(ends[k]), "y": float(y[k])})
        sure = min(sure, max(0.0, 1 - float(away[k]) / diagonal))
    if sure < 0.55 or confidence < 0.72:
        return None
    return dict(zip(("tl", "tr", "br", "bl"), points)) | {"confidence": confidence * 0.75 + sure * 0.25}


def _pixels(width: int, height: int, data: bytes) -> np.ndarray | None:
    if not width or not height or data is None or len(data) < width * height * 4:
        return None
    return np.frombuffer(data, np.uint8, width * height * 4).reshape(height, width, 4)


def shrink(rgba: np.ndarray, most: int = ANALYSIS_MAX) -> np.ndarray:
    """The image at no more than ``most`` pixels a side, by the nearest pixel."""
    height, width = rgba.shape[:2]
    scale = min(1.0, most / max(width, height))
    if scale == 1.0:
        return rgba
    w, h = max(1, int(width * scale + 0.5)), max(1, int(height * scale + 0.5))
    return rgba[(np.arange(h) * height // h)[:, None], (np.arange(w) * width // w)[None, :]]


def _averaged(values: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``values`` averaged to ``size`` of them, each over its share of the old ones, parts of a row counting as such."""
    n = len(values)
    sums = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    edges = np.arange(size + 1) * (n / size)
    whole = np.minimum(edges.astype(np.int64), n)
    part = (edges - whole).reshape(-1, *[1] * (values.ndim - 1))
    at = sums[whole] + part * values[np.minimum(whole, n - 1)]
    return (at[1:] - at[:-1]) * (size / n)


def _whole_means(rgba: np.ndarray, down: int, across: int) -> np.ndarray:
    """Means of boxes of ``down`` by ``across`` pixels of an opaque image, in whole numbers, halves upwards."""
    lines = rgba[::down].astype(np.uint32)
    for i in range(1, down):
        lines += rgba[i::down]
    sums = lines[:, ::across].copy()
    for i in range(1, across):
        sums += lines[:, i::across]
    return ((2 * sums + down * across) // (2 * down * across)).astype(np.uint8)


def resample(rgba: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image in a smaller size: each pixel is the mean of the area that it covers, colours weighted by their alpha."""
    if rgba.shape[:2] == (height, width):
        return rgba
    down, across = len(rgba) // height, rgba.shape[1] // width
    if rgba.shape[:2] == (height * down, width * across) and rgba[..., 3].min() == 255:
        return _whole_means(rgba, down, across)
    lines = []
    for i in range(0, len(rgba), 128):  # a stripe at a time across, then all of it down
        stripe = rgba[i : i + 128].astype(np.float64)
        stripe[..., :3] *= stripe[..., 3:] / 255
        lines.append(_averaged(stripe.transpose(1, 0, 2), width).transpose(1, 0, 2))
    out = _averaged(np.concatenate(lines), height)
    alpha = out[..., 3:]
    out[..., :3] = np.where(alpha > 0, out[..., :3] * 255 / np.where(alpha > 0, alpha, 1), 0)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def _resampled(images: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for widths, heights, datas, to_widths, to_heights, grays in images:
        out = []
        for w, h, d, tw, th, gray in zip(widths, heights, datas, to_widths, to_heights, grays):
            found = None if pd.isna(w) or pd.isna(h) else _pixels(int(w), int(h), d)
            small = None if found is None else resample(found, int(tw), int(th))
            out.append(None if small is None else (grayscale(small) if gray else small).tobytes())
        yield pd.Series(out, dtype=object)


def export_pixels(images: DataFrame, most: int = EXPORT_MAX) -> DataFrame:
    """Images (width, height, pixels, and image_grayscale if they have it) at no more than ``most`` pixels wide, in gray where the flag says so, with ``quality``, that of
    the JPEG to be made of them. An image is never enlarged; pixels that can't be read are null, and its size stays."""
    gray = F.coalesce("image_grayscale", F.lit(False)) if "image_grayscale" in images.columns else F.lit(False)
    rows = images.withColumns({"_gray": gray, "_fit": fit_width(F.col("width"), F.col("height"), most)})
    pixels = F.pandas_udf(_resampled, "binary")("width", "height", "pixels", F.coalesce("_fit.width", F.lit(1)), F.coalesce("_fit.height", F.lit(1)), "_gray")
    rows = rows.withColumn("pixels", pixels)
    read = F.col("pixels").isNotNull()
    sizes = {c: F.when(read, F.col(f"_fit.{c}").cast(images.schema[c].dataType)).otherwise(F.col(c)) for c in ("width", "height")}
    return rows.withColumns(sizes | {"quality": jpeg_quality(F.col("_gray"))}).drop("_gray", "_fit")


def _gray(images: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for widths, heights, datas in images:
        found = [_pixels(int(w), int(h), d) for w, h, d in zip(widths, heights, datas)]
        yield pd.Series([None if p is None else grayscale(p).tobytes() for p in found])


def _corners(images: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for widths, heights, datas in images:
        rows = []
        for w, h, d in zip(widths, heights, datas):
            rgba = _pixels(int(w), int(h), d)
            small = None if rgba is None or min(w, h) <= 1 else shrink(rgba)
            found = None if small is None else detect_corners(small)
            if found:
                sy, sx = h / small.shape[0], w / small.shape[1]
                found = {k: v if k == "confidence" else {"x": v["x"] * sx, "y": v["y"] * sy} for k, v in found.items()}
            rows.append(found or dict.fromkeys(("tl", "tr", "br", "bl", "confidence")))
        yield pd.DataFrame(rows, columns=["tl", "tr", "br", "bl", "confidence"])


def gray_pixels(width: Column, height: Column, pixels: Column) -> Column:
    """The pixels in gray; null if there are too few of them."""
    return F.pandas_udf(_gray, "binary")(width, height, pixels)


def corners(width: Column, height: Column, pixels: Column) -> Column:
    """Corners on the original image's scale; null fields where nothing sure is found, or the pixels can't be read."""
    return F.pandas_udf(_corners, CORNERS)(width, height, pixels)


def _outline(corners: Column) -> Column:
    """The corners' bounding box, and the least and largest cross product of neighbouring sides."""
    names = ("tl", "tr", "br", "bl")
    of = lambda f, k: f(*(corners[c][k] for c in names))
    crosses = []
    for i in range(4):
        a, b, c = (corners[names[(i + k) % 4]] for k in range(3))
        crosses.append((b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]))
    return F.struct(of(F.least, "x").alias("l"), of(F.least, "y").alias("t"), of(F.greatest, "x").alias("r"), of(F.greatest, "y").alias("b"), F.least(*crosses).alias("low"), F.greatest(*crosses).alias("high"))


def _rectangle(crop: Column, ok: Column, width: Column, height: Column) -> Column:
    """The rectangle, null unless ``ok`` and it is a part of the image of 2 pixels a side at least."""
    wide, high = crop["right"] - crop["left"], crop["bottom"] - crop["top"]
    return F.when(F.coalesce(ok & ~((wide >= width) & (high >= height)) & (wide >= 2) & (high >= 2), F.lit(False)), crop)


def _sides(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(*(c.cast("long").alias(n) for c, n in ((left, "left"), (top, "top"), (right, "right"), (bottom, "bottom"))))


def _padded(o: Column, width: Column, height: Column) -> Column:
    px, py = (o["r"] - o["l"]) * MARGIN, (o["b"] - o["t"]) * MARGIN
    sure = ((o["high"] <= -1) | (o["low"] >= 1)) & (o["l"] >= 0) & (o["t"] >= 0) & (o["r"] <= width) & (o["b"] <= height) & (o["r"] - o["l"] >= 2) & (o["b"] - o["t"] >= 2) & (width > 1) & (height > 1)
    crop = _sides(F.greatest(F.lit(0), F.floor(o["l"] - px)), F.greatest(F.lit(0), F.floor(o["t"] - py)), F.least(width.cast("long"), F.ceil(o["r"] + px)), F.least(height.cast("long"), F.ceil(o["b"] + py)))
    return let(crop, lambda c: _rectangle(c, sure, width, height))


def crop_rectangle(corners: Column, width: Column, height: Column) -> Column:
    """The padded rectangle around four corners as a struct of left, top, right, bottom; null if the corners aren't convex, lie
    outside, are too close together, or the rectangle is the whole image."""
    return let(_outline(corners), lambda o: _padded(o, width, height))


def guarded_rectangle(corners: Column, width: Column, height: Column) -> Column:
    """``crop_rectangle``, but a side with little ground left outside the paper keeps the image's edge."""

    def guard(o: Column, padded: Column) -> Column:
        edge = lambda margin, size, own, side: F.when(margin / size <= CROPPED_MARGIN, own).otherwise(padded[side])
        zero = F.lit(0).cast("long")
        crop = _sides(edge(o["l"], width, zero, "left"), edge(o["t"], height, zero, "top"), edge(width - o["r"], width, width.cast("long"), "right"), edge(height - o["b"], height, height.cast("long"), "bottom"))
        return let(crop, lambda c: _rectangle(c, padded.isNotNull(), width, height))

    return let(_outline(corners), lambda o: let(_padded(o, width, height), lambda p: guard(o, p)))


def auto_crop(images: DataFrame) -> DataFrame:
    """Images (width, height, pixels) with ``crop``, null where the original stays: other types than images, doubtful or broken ones."""
    looked = images.withColumn("corners", corners(F.col("width"), F.col("height"), F.col("pixels")))
    sure = F.when(F.col("corners.confidence") >= 0.72, guarded_rectangle(F.col("corners"), F.col("width").cast("double"), F.col("height").cast("double")))
    return looked.withColumn("crop", sure).drop("corners")


def fit_width(width: Column, height: Column, most: int) -> Column:
    """Dimensions at no more than ``most`` wide, never larger than they are: struct of width and height."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / width)
    size = lambda c: F.greatest(F.lit(1).cast("long"), F.floor(c * scale + 0.5))
    return F.struct(size(width).alias("width"), size(height).alias("height"))


def jpeg_quality(gray: Column) -> Column:
    return F.when(gray, 0.65).otherwise(0.75)
