"""INF01-INF03: ONNX models over images, where onnxruntime and a model file are present. Without
them ``tessella.plans.stylise.analyse`` gives the placeholder layers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tensors import Scale
from . import geometry, stats

#: Input sizes (height, width) of the models and how their output becomes a layer.
DEPTH, EDGE, SEGMENTATION = (518, 518), (512, 512), (1024, 1024)

_sessions: dict[str, object] = {}


def session(path: str):
    """One session per model and Python worker."""
    if path not in _sessions:
        import onnxruntime

        _sessions[path] = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
    return _sessions[path]


def last_plane(out: np.ndarray) -> np.ndarray:
    """The last channel of an output of rank 2, 3 or 4."""
    while out.ndim > 2:
        out = out[-1] if out.ndim == 3 else out[0]
    return out


def infer(tensors: DataFrame, model: str) -> DataFrame:
    """(img, y, vals): the model's map for each tensor (img, shape, data), as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = session(model)
        name = net.get_inputs()[0].name
        for batch in batches:
            for img, shape, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                plane = last_plane(np.asarray(net.run(None, {name: np.array(data, np.float32).reshape(shape)})[-1], float))
                yield pa.RecordBatch.from_arrays([pa.array([img] * len(plane)), pa.array(np.arange(len(plane), dtype=np.int32)), pa.array(list(plane), pa.list_(pa.float64()))], names=["img", "y", "vals"])

    return tensors.select("img", "shape", "data").mapInArrow(run, "img string, y int, vals array<double>")


def as_layer(rows: DataFrame, scale: Scale, kind: str) -> DataFrame:
    """PRJ16, GEO03: the map at the original's size: depth min-max scaled and inverted, edges
    between their 5th and 95th percentile, segmentation clamped."""
    up = geometry.upsample_model(rows, scale.model, scale.original)
    if kind == "depth":
        return stats.min_max(up, "v", ["img"], "n").select("img", "y", "x", (1 - F.col("n")).alias("v"))
    if kind == "edge":
        return stats.percentile_normalised(up, "v", ["img"], 0.05, 0.95).select("img", "y", "x", F.col("n").alias("v"))
    return up.select("img", "y", "x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v"))).alias("v"))


