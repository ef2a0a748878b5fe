"""Pixels, through the session's image source: brightness, perceptual hashes and crops in Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Side of the raster that a fingerprint is made from.
SMALL = 64


def gray(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """Luminance of a BGR or gray raster; None if it isn't one."""
    if height <= 0 or width <= 0 or channels not in (1, 3, 4):
        return None
    a = np.frombuffer(data, np.uint8)
    if a.size != height * width * channels:
        return None
    a = a.reshape(height, width, channels).astype(np.float64)
    return a[:, :, 0] if channels == 1 else a[:, :, 2] * 0.299 + a[:, :, 1] * 0.587 + a[:, :, 0] * 0.114


def shrunk(a: np.ndarray, size: int) -> np.ndarray:
    """Area mean of the raster on a size × size grid."""
    rows, cols = np.linspace(0, a.shape[0], size + 1), np.linspace(0, a.shape[1], size + 1)
    total = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def at(y, x):
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        y1, x1 = np.minimum(y0 + 1, a.shape[0]), np.minimum(x0 + 1, a.shape[1])
        fy, fx = (y - y0)[:, None], (x - x0)[None, :]
        low = total[np.ix_(y0, x0)] * (1 - fx) + total[np.ix_(y0, x1)] * fx
        return low * (1 - fy) + (total[np.ix_(y1, x0)] * (1 - fx) + total[np.ix_(y1, x1)] * fx) * fy

    s = at(rows, cols)
    return (s[1:, 1:] - s[:-1, 1:] - s[1:, :-1] + s[:-1, :-1]) / (np.diff(rows)[:, None] * np.diff(cols)[None, :])


def perceptual_hash(a: np.ndarray, size: int = 16) -> str:
    """Hex of size² bits: low frequencies of the cosine transform of the shrunk raster, above their median or not."""
    n = size * 4
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * np.arange(size)[:, None] / (2 * n))
    low = basis @ shrunk(a, n) @ basis.T
    bits = (low > np.median(low)).ravel()
    return np.packbits(bits).tobytes().hex()


def orientation(data: bytes) -> int:
    """EXIF orientation, 1 to 8, of a JPEG's bytes; 1 where none is said or it can't be read."""
    if data[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        part = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and part[:6] == b"Exif\0\0" and part[6:8] in (b"II", b"MM"):
            tiff, order = part[6:], "little" if part[6:8] == b"II" else "big"
            number = lambda i, n: int.from_bytes(tiff[i : i + n], order)  # noqa: E731, B023
            first = number(4, 4)
            for entry in range(first + 2, first + 2 + 12 * number(first, 2), 12):
                if number(entry, 2) == 0x0112:
                    return found if 1 <= (found := number(entry + 8, 2)) <= 8 else 1
            return 1
        at += 2 + size
    return 1


def turned(a: np.ndarray, how: int) -> np.ndarray:
    """The raster as its EXIF orientation means it to be seen."""
    if how in (5, 6, 7, 8):
        a = a.swapaxes(0, 1)
    if how in (2, 3, 6, 7):
        a = a[:, ::-1]
    if how in (3, 4, 7, 8):
        a = a[::-1]
    return a


def orientations(spark: SparkSession, root: str) -> DataFrame:
    """(path, orientation) of the photos below root that aren't stored as they are to be seen."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[jJ][pP]*[gG]").load(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "orientation": [orientation(d) for d in b["content"]]})

    return files.select("path", F.substring("content", 1, 65536).alias("content")).mapInPandas(run, "path string, orientation int").where("orientation <> 1")


def _named(path: Column) -> Column:
    """A local path in the one form that both sources are brought to."""
    return F.regexp_replace(path, "^file:/+", "/")


def rasters(spark: SparkSession, root: str) -> DataFrame:
    """(path, height, width, nChannels, data) of all photos below root; a height of -1 where one can't be decoded."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(root)
    return images.select(_named(F.col("image.origin")).alias("path"), F.col("image.origin").alias("origin"), "image.height", "image.width", "image.nChannels", "image.data")


def png(a: np.ndarray, level: int = 6) -> bytes:
    """A BGR or gray raster as PNG, by a fixed compression level and without any metadata, so equal pixels are equal bytes."""
    a = np.ascontiguousarray(a[:, :, 2::-1] if a.ndim == 3 else a)
    part = lambda kind, v: struct.pack(">I", len(v)) + kind + v + struct.pack(">I", zlib.crc32(kind + v))
    lines = np.concatenate([np.zeros((len(a), 1), np.uint8), a.reshape(len(a), -1)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines, level)) + part(b"IEND", b"")


def cut_crops(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """(crop_id, image_file, content, reason): every crop of a manifest as PNG bytes; each photo is decoded once, and its
    raster moved once, to meet its boxes. Photos are turned as their EXIF orientation says before they are cut.

    manifest: crop_id, image_file, source_path (relative to root), crop_x0 .. crop_y1. A crop whose photo is missing or
    can't be decoded has no content and a reason. Boxes are clipped to the photo.
    """
    base = root.rstrip("/").removeprefix("file://")
    boxes = manifest.groupBy(F.concat(F.lit(f"{base}/"), "source_path").alias("path")).agg(F.collect_list(F.struct("crop_id", "image_file", *[f"crop_{c}" for c in ("x0", "y0", "x1", "y1")])).alias("crops"))
    how = orientations(spark, root).select(_named(F.col("path")).alias("path"), "orientation")
    both = boxes.join(how, "path", "left").na.fill(1, ["orientation"]).join(rasters(spark, root), "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for crops, h, w, c, d, o in zip(b["crops"], b["height"], b["width"], b["nChannels"], b["data"], b["orientation"], strict=True):
                there = d is not None and h == h and h > 0 and len(d) == h * w * c and c in (1, 3, 4)
                a = None
                if there:
                    a = np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(c))[:, :, : 3 if c > 1 else 1]
                    a = turned(a[:, :, 0] if c == 1 else a, int(o))
                for r in crops:
                    x0, y0, x1, y1 = (max(0, int(r[f"crop_{k}"])) for k in ("x0", "y0", "x1", "y1"))
                    part = None if a is None else a[y0:y1, x0:x1]
                    out.append((r["crop_id"], r["image_file"], None, "no photo" if a is None else "outside the photo") if part is None or not part.size else (r["crop_id"], r["image_file"], png(part), None))
            yield pd.DataFrame(out, columns=["crop_id", "image_file", "content", "reason"])

    return both.select("crops", "height", "width", "nChannels", "data", "orientation").mapInPandas(run, "crop_id string, image_file string, content binary, reason string")


def save_files(rows: DataFrame, folder: str, name: str = "image_file", content: str = "content") -> None:
    """Writes the contents as files of their own, by the executors, into a folder that they share; null contents are left out."""

    def put(part) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(base, recursive=True)
        for r in part:
            with system.open_output_stream(f"{base}/{r[0]}") as f:
                f.write(bytes(r[1]))

    rows.where(F.col(content).isNotNull()).select(name, content).foreachPartition(put)


def pixel_facts(spark: SparkSession, root: str) -> DataFrame:
    """(path, brightness, fingerprint, reason) of all photos below root; one that can't be decoded has nulls and a reason.

    Photos are first shrunk, which is all a fingerprint needs, so that not their pixels but small rasters meet the EXIF
    orientations they are turned by.
    """

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, origin, h, w, c, d in zip(b["path"], b["origin"], b["height"], b["width"], b["nChannels"], b["data"], strict=True):
                g = gray(h, w, c, d)
                out.append((path, origin, None, None) if g is None else (path, origin, float(g.mean()), shrunk(g, SMALL).ravel()))
            yield pd.DataFrame(out, columns=["path", "origin", "brightness", "small"])

    def fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            prints = [None if x is None else perceptual_hash(turned(np.asarray(x, np.float64).reshape(SMALL, SMALL), int(o))) for x, o in zip(b["small"], b["orientation"], strict=True)]
            yield pd.DataFrame({"path": b["origin"], "brightness": b["brightness"], "fingerprint": prints, "reason": [None if p else "not decoded" for p in prints]})

    small = rasters(spark, root).mapInPandas(shrink, "path string, origin string, brightness double, small array<double>")
    how = orientations(spark, root).select(_named(F.col("path")).alias("path"), "orientation")
    return small.join(how, "path", "left").na.fill(1, ["orientation"]).mapInPandas(fingerprints, "path string, brightness double, fingerprint string, reason string")
