"""Edge masks: thresholds, hysteresis, thinning, cleanup, classification, outlines.

Masks are sparse cells (img, y, x). Set-like steps are joins; thinning, painting and dithering
are iterated or order-dependent within one (output-sized) image and run as numpy functions on
one image per group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from . import blocks, regions, stats, stencil
from .palette import darkest, lab_palette

LOW_SHARE = 0.4


@dataclass(frozen=True)
class EdgeConfig:
    mode: str = "outlines"  # none, outlines, internal, both
    style: str = "local"  # local, black, contrast
    thickness: int = 1
    darkener: float = 0.3
    anti_alias: bool = False
    threshold: float = 0.3
    min_segment: int = 3
    l_shift: float = 25.0
    hue_shift: float = 0.0


def thresholds(cells: DataFrame, threshold: float, value: str = "v") -> DataFrame:
    """FIL04: cells with label 2 (strong) or 1 (weak); others are left out."""
    label = F.when(F.col(value) >= threshold, 2).when(F.col(value) >= threshold * LOW_SHARE, 1)
    return cells.withColumn("label", label).where("label is not null")


def hysteresis(cells: DataFrame, threshold: float, value: str = "v") -> DataFrame:
    """FIL04 and ITR01: strong cells and the weak ones connected to them."""
    labelled = thresholds(cells, threshold, value)
    return regions.grow(labelled.where("label = 2"), labelled.where("label = 1"))


def edge_mask(edge: DataFrame, size, out, threshold: float) -> DataFrame:
    """CMP03: block maximum, non-maximum suppression, hysteresis; edge is (img, y, x, v)."""
    top = blocks.block_max(edge, "v", size, out).select("img", F.col("oy").alias("y"), F.col("ox").alias("x"), "v")
    return hysteresis(stencil.non_maximum(stencil.rows_of(top)), threshold)


def sobel_mask(pixels: DataFrame, threshold: float) -> DataFrame:
    """The mask without an edge map: Sobel over luma, over its maximum, 5th to 95th percentile,
    strictly above the threshold."""
    luma = pixels.select("img", "y", "x", color.luma(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    grad = stencil.over_max(stencil.sobel(stencil.rows_of(luma), "g", 255.0), "g")
    return stats.percentile_normalised(grad, "g", ["img"], 0.05, 0.95, "zero").where(F.col("n") > threshold).select("img", "y", "x")


def thin_array(mask: np.ndarray) -> np.ndarray:
    """ITR02: Zhang and Suen's thinning of a boolean array to its fixpoint; the border stays."""
    m = mask.astype(np.uint8)
    if min(m.shape) < 3:
        return mask.copy()
    while True:
        changed = False
        for first in (True, False):
            p2, p3, p4, p5 = m[:-2, 1:-1], m[:-2, 2:], m[1:-1, 2:], m[2:, 2:]
            p6, p7, p8, p9 = m[2:, 1:-1], m[2:, :-2], m[1:-1, :-2], m[:-2, :-2]
            ring = [p2, p3, p4, p5, p6, p7, p8, p9]
            n = sum(r.astype(np.int16) for r in ring)
            turns = sum(((a == 0) & (b == 1)).astype(np.int16) for a, b in zip(ring, [*ring[1:], p2], strict=True))
            keep = (p2 * p4 * p6, p4 * p6 * p8) if first else (p2 * p4 * p8, p2 * p6 * p8)
            gone = (m[1:-1, 1:-1] == 1) & (n >= 2) & (n <= 6) & (turns == 1) & (keep[0] == 0) & (keep[1] == 0)
            if gone.any():
                m[1:-1, 1:-1][gone] = 0
                changed = True
        if not changed:
            return m.astype(bool)


def thin(mask: DataFrame, size) -> DataFrame:
    """ITR02 per image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros(size, bool)
        grid[pdf["y"], pdf["x"]] = True
        y, x = np.nonzero(thin_array(grid))
        return pd.DataFrame({"img": pdf["img"].iloc[0] if len(pdf) else "", "y": y.astype(np.int32), "x": x.astype(np.int32)})

    return mask.select("img", "y", "x").groupBy("img").applyInPandas(run, "img string, y int, x int")


def bridge(mask: DataFrame, size) -> DataFrame:
    """ITR04, ITR08: mask and, for each pair of its cells at Chebyshev distance 2, the midpoint
    of the segment from either end: one step along each axis in which they differ."""
    far = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if max(abs(dy), abs(dx)) == 2]
    sign = lambda d: (d > 0) - (d < 0)
    moves = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(sign(dy)).alias("sy"), F.lit(sign(dx)).alias("sx")) for dy, dx in far]))
    there = mask.select("img", "y", "x", moves.alias("m")).select("img", (F.col("y") + F.col("m.dy")).alias("ny"), (F.col("x") + F.col("m.dx")).alias("nx"), (F.col("y") + F.col("m.sy")).alias("my"), (F.col("x") + F.col("m.sx")).alias("mx"))
    ends = mask.select("img", F.col("y").alias("ny"), F.col("x").alias("nx"))
    middle = there.join(ends, ["img", "ny", "nx"], "left_semi").select("img", F.col("my").alias("y"), F.col("mx").alias("x"))
    return mask.select("img", "y", "x").unionByName(middle).distinct()


def cleanup(mask: DataFrame, size, min_segment: int = 3) -> DataFrame:
    """ITR04: bridge gaps, drop isolated cells, drop components under min_segment cells."""
    joined = stencil.with_neighbour(bridge(mask, size))
    if min_segment <= 1:
        return joined
    named = regions.components(joined)
    long = named.groupBy("img", "comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_segment).select("img", "comp")
    return named.join(long, ["img", "comp"], "left_semi").select("img", "y", "x")


def classify(mask: DataFrame, size, mode: str, labels: DataFrame | None = None, seg: DataFrame | None = None, warnings: list[str] | None = None) -> DataFrame:
    """CMP04, FIL09: the cells of mask to paint. seg (img, y, x, v) decides by foreground and
    background nearby, else labels (img, y, x, region) by different regions nearby, else all
    (for internal: those on the border or beside a cell that isn't in mask)."""
    if mode == "none":
        return mask.limit(0)
    if seg is not None:
        binary = seg.select("img", "y", "x", (F.col("v") >= 0.5).cast("double").alias("v"))
        rows = stencil.rows_of(binary)
        outline = stencil.spans(rows, "outline")
        near = stencil.with_rows_around(rows, 1, clamp=False)
        has = stencil.each_cell(near, lambda x: F.greatest(*[stencil.at(dy, x + dx, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]), "fore")
        flags = outline.join(has, ["img", "y", "x"])
        keep = {"outlines": F.col("outline"), "internal": ~F.col("outline") & (F.col("fore") > 0), "both": F.lit(True)}[mode]
        return mask.join(flags, ["img", "y", "x"]).where(keep).select("img", "y", "x")
    if labels is not None:
        flags = stencil.spans(stencil.rows_of(labels.select("img", "y", "x", F.coalesce(F.col("region").cast("double"), F.lit(-1.0)).alias("v"))), "outline")
        keep = {"outlines": F.col("outline"), "internal": ~F.col("outline"), "both": F.lit(True)}[mode]
        return mask.join(flags, ["img", "y", "x"]).where(keep).select("img", "y", "x")
    if mode != "internal":
        return mask.select("img", "y", "x")
    if warnings is not None:
        warnings.append("internal edges without regions or a segmentation: only edges beside a gap or the border are kept")
    full = mask.select("img", "y", "x", F.lit(1).alias("m"))
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    beside = mask.select("img", "y", "x", steps.alias("s")).select("img", "y", "x", (F.col("y") + F.col("s.dy")).alias("ny"), (F.col("x") + F.col("s.dx")).alias("nx"))
    holes = beside.where(F.col("ny").between(0, size[0] - 1) & F.col("nx").between(0, size[1] - 1)).join(full.select("img", F.col("y").alias("ny"), F.col("x").alias("nx")), ["img", "ny", "nx"], "left_anti").select("img", "y", "x")
    border = mask.where((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == size[0] - 1) | (F.col("x") == size[1] - 1)).select("img", "y", "x")
    return holes.unionByName(border).distinct()


# --- numpy: Lab of arrays, and what depends on the order of cells -------------------------


def lab_array(rgb: np.ndarray) -> np.ndarray:
    s = rgb.astype(float) / 255
    light = np.where(s <= 0.04045, s / 12.92, ((s + 0.055) / 1.055) ** 2.4)
    t = light @ np.array(color.TO_XYZ).T / np.array(color.WHITE)
    f = np.where(t > color.EPSILON, np.cbrt(t), (t * color.KAPPA + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def _nearest(lab: np.ndarray, entries: np.ndarray) -> int:
    return int(((entries - lab) ** 2).sum(axis=1).argmin())


def outline_color(image: np.ndarray, y: int, x: int, config: EdgeConfig, colors: np.ndarray, labs: np.ndarray, dark: int) -> np.ndarray:
    """ITR07: from the palette, by the mean Lab of the 3 x 3 neighbourhood as painted so far."""
    if not len(colors):
        return np.zeros(3, np.int64)
    if config.style == "black":
        return colors[dark]
    mean = lab_array(image[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2, :3].reshape(-1, 3)).mean(axis=0)
    if config.style == "contrast":
        far = colors[int(((labs - mean) ** 2).sum(axis=1).argmax())]
        t = min(max(config.darkener, 0.0), 1.0)
        return far if t < 0.001 else np.clip(np.floor(far * (1 - t) + colors[dark] * t + 0.5), 0, 255).astype(np.int64)
    shifted = np.array([min(max(mean[0] - config.l_shift, 0.0), 100.0), mean[1], mean[2]])
    if abs(config.hue_shift) >= 0.001:
        turn, chroma = np.arctan2(mean[2], mean[1]) + np.radians(config.hue_shift), np.hypot(mean[1], mean[2])
        shifted[1:] = chroma * np.cos(turn), chroma * np.sin(turn)
    return colors[_nearest(shifted, labs)]


def paint_array(image: np.ndarray, cells: np.ndarray, config: EdgeConfig, palette) -> None:
    """ITR05 in place: cells in row-major order, each seeing the ones painted before it."""
    colors = np.array(palette, np.int64).reshape(-1, 3)
    labs = np.array(lab_palette(palette)).reshape(-1, 3)
    dark = darkest(palette) if len(palette) else 0
    offsets = stencil.stroke(config.thickness)
    for y, x in np.argwhere(cells):
        now = outline_color(image, y, x, config, colors, labs, dark)
        for dy, dx in offsets:
            if 0 <= y + dy < image.shape[0] and 0 <= x + dx < image.shape[1]:
                image[y + dy, x + dx] = (*now, 255)


def anti_alias_array(image: np.ndarray, skeleton: np.ndarray) -> None:
    """STN14 in place: the cells across a line take 0.35 of its colour over what they were, at
    junctions all four take 0.2; a cell of the line's own colour stays."""
    before = image.copy()
    h, w = skeleton.shape
    padded = np.pad(skeleton, 1)
    for y, x in np.argwhere(skeleton):
        along = int(padded[y + 1, x + 2]) + int(padded[y + 1, x])
        across = int(padded[y + 2, x + 1]) + int(padded[y, x + 1])
        if along >= across and across == 0:
            steps, t = ((-1, 0), (1, 0)), 0.35
        elif across > along and along == 0:
            steps, t = ((0, -1), (0, 1)), 0.35
        else:
            steps, t = ((0, -1), (0, 1), (-1, 0), (1, 0)), 0.2
        ink = image[y, x].copy()
        for dy, dx in steps:
            ny, nx = y + dy, x + dx
            if 0 <= ny < h and 0 <= nx < w and not (image[ny, nx] == ink).all():
                image[ny, nx, :3] = np.floor(before[ny, nx, :3] * (1 - t) + ink[:3] * t + 0.5).astype(np.int64)


PIXELS = "img string, y int, x int, r int, g int, b int, a int"


def to_array(pdf: pd.DataFrame, size) -> np.ndarray:
    image = np.zeros((*size, 4), np.int64)
    image[pdf["y"], pdf["x"]] = pdf[["r", "g", "b", "a"]].to_numpy()
    return image


def to_pixels(image: np.ndarray, img: str) -> pd.DataFrame:
    y, x = np.indices(image.shape[:2]).reshape(2, -1)
    return pd.DataFrame({"img": img, "y": y, "x": x} | {c: image[..., k].ravel() for k, c in enumerate("rgba")}).astype({c: np.int32 for c in ("y", "x", "r", "g", "b", "a")})


def paint(pixels: DataFrame, keep: DataFrame, skeleton: DataFrame, size, config: EdgeConfig, palette) -> DataFrame:
    """ITR05, STN12, STN14: the kept cells painted onto the image, then anti-aliased along the
    skeleton. An image is one group; it has the output's size."""
    flags = keep.select("img", "y", "x", F.lit(True).alias("keep"))
    bones = skeleton.select("img", "y", "x", F.lit(True).alias("bone"))
    marked = pixels.join(flags, ["img", "y", "x"], "left").join(bones, ["img", "y", "x"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = to_array(pdf, size)
        masks = {k: np.zeros(size, bool) for k in ("keep", "bone")}
        for k, m in masks.items():
            hit = pdf[pdf[k].notna()]
            m[hit["y"], hit["x"]] = True
        paint_array(image, masks["keep"], config, palette)
        if config.anti_alias:
            anti_alias_array(image, masks["bone"])
        return to_pixels(image, pdf["img"].iloc[0])

    return marked.select("img", "y", "x", "r", "g", "b", "a", "keep", "bone").groupBy("img").applyInPandas(run, PIXELS)


def dither_array(image: np.ndarray, palette) -> np.ndarray:
    """ITR06: error diffusion in Lab, row by row: 7/16 right, 3/16, 5/16 and 1/16 below."""
    colors = np.array(palette, np.int64).reshape(-1, 3)
    entries = np.array(lab_palette(palette)).reshape(-1, 3)
    lab, out = lab_array(image[..., :3]), image.copy()
    h, w = lab.shape[:2]
    for y in range(h):
        for x in range(w):
            k = _nearest(lab[y, x], entries)
            out[y, x] = (*colors[k], 255)
            error = lab[y, x] - entries[k]
            for dy, dx, share in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                if y + dy < h and 0 <= x + dx < w:
                    lab[y + dy, x + dx] += error * share / 16
    return out


def dither(pixels: DataFrame, size, out, palette) -> DataFrame:
    """ITR06 after AGG03: the image reduced to `out` by area, then dithered."""
    small = blocks.block_area(pixels, size, out).select("img", F.col("oy").alias("y"), F.col("ox").alias("x"), "r", "g", "b", "a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return to_pixels(dither_array(to_array(pdf, out), palette), pdf["img"].iloc[0])

    return small.groupBy("img").applyInPandas(run, PIXELS)


# --- the whole edge stage over one output-sized image ------------------------------------------


def _around(a: np.ndarray, fill) -> list[np.ndarray]:
    """The 8 shifted copies of an array, `fill` outside."""
    p = np.pad(a, 1, constant_values=fill)
    h, w = a.shape
    return [p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in stencil.NEIGHBOURS]


def nms_array(v: np.ndarray) -> np.ndarray:
    """STN08."""
    return np.where(np.max(_around(v, -np.inf), axis=0) > v, 0.0, v)


def grow_array(strong: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """ITR01."""
    mask = strong.copy()
    while True:
        new = mask | (weak & np.any(_around(mask, False), axis=0))
        if (new == mask).all():
            return mask
        mask = new


def components_array(mask: np.ndarray) -> np.ndarray:
    """ITR03: per cell of mask the least flat index of its 8-connected component, else -1."""
    none = mask.size
    lab = np.where(mask, np.arange(mask.size).reshape(mask.shape), none)
    while True:
        new = np.where(mask, np.minimum(lab, np.min(_around(lab, none), axis=0)), none)
        if (new == lab).all():
            return np.where(mask, lab, -1)
        lab = new


def cleanup_array(mask: np.ndarray, min_segment: int) -> np.ndarray:
    """ITR04."""
    h, w = mask.shape
    out, p = mask.copy(), np.pad(mask, 2)
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            if max(abs(dy), abs(dx)) == 2:
                y, x = np.nonzero(mask & p[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w])
                out[y + np.sign(dy), x + np.sign(dx)] = True
    out &= np.any(_around(out, False), axis=0)
    if min_segment > 1:
        lab = components_array(out)
        size = np.bincount(lab[out], minlength=1)
        out[out] = size[lab[out]] >= min_segment
    return out


def classify_array(mask: np.ndarray, mode: str, labels: np.ndarray | None, seg: np.ndarray | None) -> np.ndarray:
    """CMP04."""
    if mode == "none":
        return np.zeros_like(mask)
    if seg is not None:
        fore = seg >= 0.5
        has_fore = fore | np.any(_around(fore, False), axis=0)
        outline = has_fore & (~fore | np.any(_around(~fore, False), axis=0))
        return mask & {"outlines": outline, "internal": ~outline & has_fore, "both": True}[mode]
    if labels is not None:
        low = np.minimum(labels, np.min(_around(labels, np.inf), axis=0))
        high = np.maximum(labels, np.max(_around(labels, -np.inf), axis=0))
        return mask & {"outlines": low != high, "internal": low == high, "both": True}[mode]
    if mode != "internal":
        return mask.copy()
    p = np.pad(mask, 1)  # beyond the border counts as a gap, as border cells are kept anyway
    return mask & ~(p[1:-1, :-2] & p[1:-1, 2:] & p[:-2, 1:-1] & p[2:, 1:-1])


def sobel_mask_array(image: np.ndarray, threshold: float) -> np.ndarray:
    """STN03, NRM03, FIL04."""
    v = np.floor((image[..., 0] * 2126 + image[..., 1] * 7152 + image[..., 2] * 722) / 10000)
    g = np.zeros(v.shape)
    if min(v.shape) >= 3:
        gx = v[:-2, 2:] - v[:-2, :-2] + 2 * (v[1:-1, 2:] - v[1:-1, :-2]) + v[2:, 2:] - v[2:, :-2]
        gy = v[2:, :-2] - v[:-2, :-2] + 2 * (v[2:, 1:-1] - v[:-2, 1:-1]) + v[2:, 2:] - v[:-2, 2:]
        g[1:-1, 1:-1] = np.sqrt(gx * gx + gy * gy) / 255
    g /= g.max() or 1.0
    order = np.sort(g.ravel())
    low, high = (order[int(np.floor((g.size - 1) * p + 0.5))] for p in (0.05, 0.95))
    return np.clip((g - low) / (high - low), 0, 1) > threshold if high - low >= 1e-6 else np.zeros(g.shape, bool)


def draw(pixels: DataFrame, edge: DataFrame | None, labels: DataFrame | None, seg: DataFrame | None, size, config: EdgeConfig, palette) -> DataFrame:
    """The edge stage of output-sized images, a group and one numpy function each: CMP03 from
    the block maximum (img, y, x, v) or the image's own gradients, ITR02, ITR04, CMP04, ITR05.
    The same steps as the operators above, which serve rasters that don't fit a task."""
    rows = pixels.select("img", "y", "x", *"rgba")
    for name, layer, value in (("edge", edge, "v"), ("label", labels, "region"), ("seg", seg, "v")):
        if layer is not None:
            got = F.coalesce(F.col(value).cast("double"), F.lit(-1.0)) if name == "label" else F.col(value).cast("double")
            rows = rows.join(layer.select("img", "y", "x", got.alias(name)), ["img", "y", "x"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = to_array(pdf, size)
        planes = {}
        for name in ("edge", "label", "seg"):
            if name in pdf:
                none = -1.0 if name == "label" else 0.0  # a cell without a row has no region
                planes[name] = np.full(size, none)
                planes[name][pdf["y"], pdf["x"]] = pdf[name].fillna(none)
        if "edge" in planes:
            top = nms_array(planes["edge"])
            mask = grow_array(top >= config.threshold, (top >= config.threshold * LOW_SHARE) & (top < config.threshold))
        else:
            mask = sobel_mask_array(image, config.threshold)
        bones = cleanup_array(thin_array(mask), config.min_segment)
        paint_array(image, classify_array(bones, config.mode, planes.get("label"), planes.get("seg")), config, palette)
        if config.anti_alias:
            anti_alias_array(image, bones)
        return to_pixels(image, pdf["img"].iloc[0])

    return rows.groupBy("img").applyInPandas(run, PIXELS)
