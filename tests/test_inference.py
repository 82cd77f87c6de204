"""Inference with a model made here: the mean of the channels, written as an ONNX file by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.tensors import PROFILES, Scale, tensor
from tessella.operators import inference
from tessella.sources import fixtures

pytest.importorskip("onnxruntime")


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def number(field, value):
    return varint(field << 3) + varint(value)


def part(field, body):
    body = body.encode() if isinstance(body, str) else body
    return varint(field << 3 | 2) + varint(len(body)) + body


def value(name, *sides):
    shape = b"".join(part(1, number(1, s) if isinstance(s, int) else part(2, s)) for s in sides)
    return part(1, name) + part(2, part(1, number(1, 1) + part(2, shape)))


def mean_model():
    """ReduceMean over axis 1 of a float tensor (1, 3, h, w)."""
    axes = part(1, "axes") + part(8, varint(1)) + number(20, 7)
    keep = part(1, "keepdims") + number(3, 0) + number(20, 2)
    node = part(1, "x") + part(2, "y") + part(4, "ReduceMean") + part(5, axes) + part(5, keep)
    graph = part(1, node) + part(2, "g") + part(11, value("x", 1, 3, "h", "w")) + part(12, value("y", 1, "h", "w"))
    return number(1, 8) + part(8, number(2, 13)) + part(7, graph)


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    path = tmp_path_factory.mktemp("models") / "mean.onnx"
    path.write_bytes(mean_model())
    return str(path)


def grid(df, value, size):
    out = np.full(size, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r[value]
    return out


@pytest.mark.parametrize("profile", ["imagenet", "half", "unit"])
def test_a_model_is_run_over_every_image(spark, model, profile):
    """PRJ12, INF01-INF03, PRJ16: two images in one call; depth inverted, edges between percentiles,
    segmentation clamped."""
    size = (8, 12)
    one = fixtures.busy(spark, 12).where("y < 8")
    px = one.unionByName(one.withColumn("img", F.lit("other")).withColumn("r", 255 - F.col("r")))
    rows = inference.infer(tensor(px, size, profile), model)
    mean, std = PROFILES[profile]
    for img in ("busy", "other"):
        own = {c: grid(px.where(F.col("img") == img), c, size) for c in "rgb"}
        want = sum((own[c] / 255 - m) / s for c, m, s in zip("rgb", mean, std, strict=True)) / 3
        layer = {k: grid(inference.as_layer(rows.where(F.col("img") == img), Scale(size, size), k), "v", size) for k in ("depth", "edge", "seg")}
        assert np.abs(layer["depth"] - (1 - (want - want.min()) / (want.max() - want.min()))).max() < 1e-5
        order = np.sort(want.ravel())
        low, high = (order[int(np.floor((want.size - 1) * p + 0.5))] for p in (0.05, 0.95))
        assert np.abs(layer["edge"] - np.clip((want - low) / (high - low), 0, 1)).max() < 1e-4
        assert np.abs(layer["seg"] - np.clip(want, 0, 1)).max() < 1e-5


def test_a_models_map_is_brought_to_the_originals_size(spark, model):
    """GEO03 after inference on a smaller input: constant in, constant out."""
    px = spark.createDataFrame([("i", y, x, 51, 51, 51, 255) for y in range(4) for x in range(6)], "img string, y int, x int, r int, g int, b int, a int")
    layer = inference.as_layer(inference.infer(tensor(px, (4, 6), "unit"), model), Scale((9, 13), (4, 6)), "seg")
    got = grid(layer, "v", (9, 13))
    assert np.abs(got - 0.2).max() < 1e-6


def test_last_plane():
    a = np.arange(24.0)
    assert inference.last_plane(a.reshape(4, 6)).shape == (4, 6)
    assert (inference.last_plane(a.reshape(2, 3, 4)) == a.reshape(2, 3, 4)[-1]).all() and (inference.last_plane(a.reshape(1, 2, 3, 4)) == a.reshape(2, 3, 4)[-1]).all()
