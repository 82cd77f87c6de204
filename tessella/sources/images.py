"""SRC01-SRC03, SNK01, SNK02: images in and out.

Reading goes through Spark's image source (PNG, JPEG, BMP), so any store that Spark reads will
do. Writing encodes one image per group as PNG or JPEG and returns (img, data) rows; ``write_images``
puts them into a folder that all executors reach. There is no WebP.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geometry import max_dimension
from .jpeg import jpeg_bytes

PIXELS = "img string, y int, x int, r int, g int, b int, a int"


def rgba(h: int, w: int, n: int, data: bytes) -> np.ndarray:
    """(h, w, 4) of the image source's bytes, whose order is blue, green, red."""
    p = np.frombuffer(data, np.uint8).reshape(h, w, n)
    alpha = p[..., 3] if n == 4 else np.full((h, w), 255, np.uint8)
    rgb = p[..., 2::-1] if n >= 3 else np.repeat(p[..., :1], 3, axis=2)
    return np.concatenate([rgb, alpha[..., None]], axis=2)


def _lanczos(size: int, out: int) -> np.ndarray:
    """out x size weights of GEO06's filter, each row's sum 1."""
    scale = size / out
    d = np.abs(np.arange(size)[None, :] + 0.5 - (np.arange(out)[:, None] + 0.5) * scale) / max(scale, 1.0)
    w = np.where(d < 3, np.sinc(d) * np.sinc(d / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def shrunk(image: np.ndarray, most: int) -> np.ndarray:
    """GEO06 of one array, so that no side is over `most` (0: any)."""
    size = image.shape[:2]
    out = max_dimension(size, most)
    if out == size:
        return image
    soft = np.einsum("oy,yxc,px->opc", _lanczos(size[0], out[0]), image.astype(float), _lanczos(size[1], out[1]), optimize=True)
    return np.clip(np.floor(soft + 0.5 + 1e-9), 0, 255).astype(np.uint8)


def _batch(img: str, image: np.ndarray) -> pa.RecordBatch:
    h, w = image.shape[:2]
    y, x = np.indices((h, w)).reshape(2, -1).astype(np.int32)
    channels = [image[..., k].ravel().astype(np.int32) for k in range(4)]
    return pa.RecordBatch.from_arrays([pa.array([img] * (h * w)), pa.array(y), pa.array(x), *map(pa.array, channels)], names=["img", "y", "x", "r", "g", "b", "a"])


def _unpacked(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for img, h, w, n, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                yield _batch(img, shrunk(rgba(h, w, n, data), most))

    return run


def read_images(spark: SparkSession, path: str, most: int = 0) -> DataFrame:
    """One row a pixel. Undecodable files are dropped. An image is unpacked by one task, batch by
    batch, and shrunk there if a side is over `most` (SRC03): images differ in size."""
    found = spark.read.format("image").option("dropInvalid", True).load(path)
    return found.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(_unpacked(most), PIXELS)


def read_bytes(spark: SparkSession, data: dict[str, bytes], most: int = 0) -> DataFrame:
    """SRC02: the pixels of files held in memory, by name, in any format of the image source; what
    can't be decoded is left out. For a few images of the caller's; many belong in a folder."""
    schema = getattr(getattr(spark.sparkContext._jvm.org.apache.spark.ml.image, "ImageSchema$"), "MODULE$")
    found = []
    for name, raw in data.items():
        decoded = schema.decode(name, bytearray(raw))
        if decoded.isDefined():
            row = decoded.get().getStruct(0)
            found.append(_batch(name, shrunk(rgba(row.getInt(1), row.getInt(2), row.getInt(3), bytes(row.getAs(5))), most)))
    return spark.createDataFrame(pa.Table.from_batches(found).to_pandas(), PIXELS) if found else spark.createDataFrame([], PIXELS)


def png_bytes(image: np.ndarray) -> bytes:
    """An RGBA array (h, w, 4) of bytes as PNG."""
    h, w = image.shape[:2]
    raw = np.zeros((h, 1 + 4 * w), np.uint8)
    raw[:, 1:] = image.astype(np.uint8).reshape(h, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def encode(pixels: DataFrame, size, scale: int = 1, kind: str = "png", quality: int = 90) -> DataFrame:
    """SNK01: (img, data), each pixel repeated scale x scale times, as "png" or "jpeg" (without alpha)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((*size, 4), np.uint8)
        image[pdf["y"], pdf["x"]] = pdf[["r", "g", "b", "a"]].to_numpy()
        image = image.repeat(scale, axis=0).repeat(scale, axis=1)
        return pd.DataFrame({"img": [pdf["img"].iloc[0]], "data": [png_bytes(image) if kind == "png" else jpeg_bytes(image, quality)]})

    return pixels.select("img", "y", "x", "r", "g", "b", "a").groupBy("img").applyInPandas(run, "img string, data binary")


def write_images(pixels: DataFrame, size, folder: str, scale: int = 1, kind: str = "png", quality: int = 90) -> None:
    """SNK02: writes <folder>/<img>.<kind>; an image that is written twice, after a lost task, is the
    same. The folder is a path that all executors share, or a URI of a store that Arrow writes to."""

    def put(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for r in rows:
            with store.open_output_stream(f"{base}/{r['img'].rsplit('/', 1)[-1]}.{kind}") as f:
                f.write(bytes(r["data"]))

    encode(pixels, size, scale, kind, quality).foreachPartition(put)


def write_png(pixels: DataFrame, size, folder: str, scale: int = 1) -> None:
    write_images(pixels, size, folder, scale)


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """AGG17: the number of channel bytes in which two images differ."""
    other = b.select("img", "y", "x", *[F.col(c).alias(f"{c}_") for c in "rgba"])
    n = sum(((F.col(c) != F.col(f"{c}_")).cast("int") for c in "rgba"), F.lit(0))
    return a.join(other, ["img", "y", "x"]).agg(F.sum(n).alias("n"))
