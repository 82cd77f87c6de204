"""Rotation of tall images: against a plain inverse map, without a join, from a grid that is dealt."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import edges, geometry

SIZE = (37, 16)


@pytest.fixture(scope="module")
def image():
    px = np.random.default_rng(5).integers(0, 256, (*SIZE, 4))
    px[3, 4] = px[3, 5] = 0  # absent from the table
    return px


def table(spark, image):
    rows = [("a", y, x, *map(int, image[y, x])) for y in range(SIZE[0]) for x in range(SIZE[1]) if (y, x) not in ((3, 4), (3, 5))]
    return spark.createDataFrame(rows, "img string, y int, x int, r int, g int, b int, a int")


def plain(image, degrees, compat):
    h, w = SIZE
    out = geometry.rotated_size(SIZE, degrees)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    if compat:
        c, s = abs(c), abs(s)
    got = np.zeros((*out, 4), np.int64)
    for y in range(out[0]):
        for x in range(out[1]):
            dx, dy = x - out[1] / 2, y - out[0] / 2
            sx, sy = dx * c + dy * s + w / 2, dx * -s + dy * c + h / 2
            if 0 <= sx < w and 0 <= sy < h:
                x0, y0 = math.floor(sx), math.floor(sy)
                x1, y1, fx, fy = min(x0 + 1, w - 1), min(y0 + 1, h - 1), sx - x0, sy - y0
                v = image[y0, x0] * (1 - fx) * (1 - fy) + image[y0, x1] * fx * (1 - fy) + image[y1, x0] * (1 - fx) * fy + image[y1, x1] * fx * fy
                got[y, x] = np.floor(v + 5e-7)
    return got


@pytest.mark.parametrize("degrees", [30.0, 90.0, 135.0, 180.0, 270.0, 301.5])
@pytest.mark.parametrize("compat", [True, False])
def test_rotate_equals_the_plain_inverse_map(spark, image, degrees, compat):
    out = geometry.rotated_size(SIZE, degrees)
    got = geometry.rotate(table(spark, image), SIZE, degrees, compat).toPandas()
    assert len(got) == out[0] * out[1]
    assert (edges.to_array(got, out) == plain(image, degrees, compat)).all()


def test_a_turn_of_a_tall_image_has_no_join_and_no_array_of_a_side(spark, image):
    plans = []
    for height in (1_000, 1_000_000):  # both are shrunk
        state = geometry.ImageState((height, SIZE[1]), most=100).flipped(True).turned(90.0)
        plans.append(state.apply(table(spark, image))[0]._jdf.queryExecution().optimizedPlan().toString())
    assert all("Join" not in p for p in plans)
    assert len(plans[1]) < len(plans[0]) + 5_000


def test_the_grid_of_one_image_is_dealt_and_whole(spark, image):
    size = (5, geometry.BLOCK)
    grid = geometry.pixel_grid(table(spark, image), size).withColumn("task", F.spark_partition_id())
    n, tasks, cells, top, right = grid.agg(F.count("*"), F.countDistinct("task"), F.countDistinct("y", "x"), F.max("y"), F.max("x")).first()
    assert n == cells == size[0] * size[1] and (top, right) == (size[0] - 1, size[1] - 1)
    assert tasks > 1
