"""Raster steps that depend on the order of cells, against plain pixel-by-pixel Python."""

import math

import numpy as np
import pytest

from tessella.operators import edges
from tessella.operators.edges import EdgeConfig
from tessella.sources.palettes import PALETTES

COLORS = PALETTES["pico8"]
RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def lab(rgb):
    light = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in rgb]
    x = (0.4124564 * light[0] + 0.3575761 * light[1] + 0.1804375 * light[2]) / 0.95047
    y = 0.2126729 * light[0] + 0.7151522 * light[1] + 0.0721750 * light[2]
    z = (0.0193339 * light[0] + 0.1191920 * light[1] + 0.9503041 * light[2]) / 1.08883
    f = [math.cbrt(t) if t > 216 / 24389 else (t * 24389 / 27 + 16) / 116 for t in (x, y, z)]
    return [116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]


def apart(p, q):
    return sum((a - b) ** 2 for a, b in zip(p, q, strict=True))


LABS = [lab(c) for c in COLORS]
DARK = min(range(len(COLORS)), key=lambda i: LABS[i][0])


def plain_thin(mask):
    m = [list(map(int, row)) for row in mask]
    h, w = len(m), len(m[0])
    changed = True
    while changed:
        changed = False
        for first in (True, False):
            gone = []
            for y in range(1, h - 1):
                for x in range(1, w - 1):
                    if not m[y][x]:
                        continue
                    p = [m[y + dy][x + dx] for dy, dx in RING]
                    turns = sum(p[k] == 0 and p[(k + 1) % 8] == 1 for k in range(8))
                    a, b = ((p[0], p[2], p[4]), (p[2], p[4], p[6])) if first else ((p[0], p[2], p[6]), (p[0], p[4], p[6]))
                    if 2 <= sum(p) <= 6 and turns == 1 and 0 in a and 0 in b:
                        gone.append((y, x))
            for y, x in gone:
                m[y][x] = 0
            changed |= bool(gone)
    return np.array(m, bool)


def plain_dither(image):
    h, w = image.shape[:2]
    left = [[lab(image[y, x, :3].tolist()) for x in range(w)] for y in range(h)]
    out = np.zeros((h, w, 4), int)
    for y in range(h):
        for x in range(w):
            k = min(range(len(LABS)), key=lambda i: (apart(left[y][x], LABS[i]), i))
            out[y, x] = (*COLORS[k], 255)
            error = [a - b for a, b in zip(left[y][x], LABS[k], strict=True)]
            for dy, dx, share in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                if y + dy < h and 0 <= x + dx < w:
                    left[y + dy][x + dx] = [a + e * share / 16 for a, e in zip(left[y + dy][x + dx], error, strict=True)]
    return out


def plain_paint(image, cells, thickness, style):
    image = image.copy()
    h, w = image.shape[:2]
    cross = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
    stroke = {1: cross[:1], 2: cross, 3: [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]}[thickness]
    for y in range(h):
        for x in range(w):
            if not cells[y, x]:
                continue
            if style == "black":
                ink = COLORS[DARK]
            else:
                near = [lab(image[a, b, :3].tolist()) for a in range(max(0, y - 1), min(h, y + 2)) for b in range(max(0, x - 1), min(w, x + 2))]
                mean = [sum(v) / len(near) for v in zip(*near, strict=True)]
                ink = COLORS[max(range(len(LABS)), key=lambda i: (apart(mean, LABS[i]), -i))]
            for dy, dx in stroke:
                if 0 <= y + dy < h and 0 <= x + dx < w:
                    image[y + dy, x + dx] = (*ink, 255)
    return image


def plain_smooth(image, bones):
    before, image = image.copy(), image.copy()
    h, w = bones.shape
    at = lambda y, x: 0 <= y < h and 0 <= x < w and bool(bones[y, x])
    for y in range(h):
        for x in range(w):
            if not bones[y, x]:
                continue
            along, across = at(y, x + 1) + at(y, x - 1), at(y + 1, x) + at(y - 1, x)
            if along >= across and not across:
                steps, t = [(-1, 0), (1, 0)], 0.35
            elif across > along and not along:
                steps, t = [(0, -1), (0, 1)], 0.35
            else:
                steps, t = [(0, -1), (0, 1), (-1, 0), (1, 0)], 0.2
            ink = image[y, x].tolist()
            for dy, dx in steps:
                if 0 <= y + dy < h and 0 <= x + dx < w and image[y + dy, x + dx].tolist() != ink:
                    image[y + dy, x + dx, :3] = [math.floor(a * (1 - t) + b * t + 0.5) for a, b in zip(before[y + dy, x + dx, :3].tolist(), ink, strict=False)]
    return image


@pytest.fixture(scope="module")
def image():
    rng = np.random.default_rng(12)
    soft = rng.integers(0, 256, (6, 5, 3)).repeat(4, axis=0).repeat(4, axis=1)
    return np.concatenate([np.clip(soft + rng.integers(-20, 20, soft.shape), 0, 255), np.full((24, 20, 1), 255)], axis=2).astype(np.int64)


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(3)
    blocks = rng.random((6, 5)) < 0.5
    return [blocks.repeat(4, axis=0).repeat(4, axis=1), rng.random((24, 20)) < 0.3, np.ones((24, 20), bool), np.zeros((24, 20), bool)]


def frame(spark, image):
    h, w = image.shape[:2]
    return spark.createDataFrame([("i", y, x, *map(int, image[y, x])) for y in range(h) for x in range(w)], edges.PIXELS)


def mask_frame(spark, mask):
    return spark.createDataFrame([("i", int(y), int(x)) for y, x in np.argwhere(mask)], "img string, y int, x int")


def test_thin_equals_its_twin(spark, masks):
    for mask in masks:
        assert (edges.thin_array(mask) == plain_thin(mask)).all()
    got = edges.thin(mask_frame(spark, masks[0]), (24, 20)).collect()
    assert {(r["y"], r["x"]) for r in got} == {tuple(p) for p in np.argwhere(plain_thin(masks[0])).tolist()} != set()


def test_dither_equals_its_twin(spark, image):
    got = edges.dither(frame(spark, image), (24, 20), (24, 20), COLORS).toPandas()
    assert (edges.to_array(got, (24, 20)) == plain_dither(image)).all()


@pytest.mark.parametrize("style", ["black", "contrast"])
@pytest.mark.parametrize("thickness", [1, 2, 3])
def test_paint_equals_its_twin(spark, image, masks, style, thickness):
    config = EdgeConfig(style=style, thickness=thickness, darkener=0.0, anti_alias=thickness < 3)
    cells, bones = masks[1], plain_thin(masks[1])
    want = plain_paint(image, cells, thickness, style)
    if config.anti_alias:
        want = plain_smooth(want, bones)
    got = edges.paint(frame(spark, image), mask_frame(spark, cells), mask_frame(spark, bones), (24, 20), config, COLORS).toPandas()
    assert (edges.to_array(got, (24, 20)) == want).all()
