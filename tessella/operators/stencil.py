"""Neighbourhood operators over rasters held as rows (img, y, vals array<double>).

A cell's neighbours in its row are in the same array; those above and below come from the
neighbouring rows. Rows are cut into bands of BAND rows, each with a halo of copies, so that
one shuffle by (img, band) serves a stencil, without a join per offset, and a tall image is
spread over tasks. Kernels are array expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAND = 64


def rows_of(cells: DataFrame, value: str = "v", width: bool = False) -> DataFrame:
    """(img, y, vals) from cells (img, y, x, value); missing cells are not allowed."""
    packed = cells.groupBy("img", "y").agg(F.sort_array(F.collect_list(F.struct("x", F.col(value).cast("double").alias("v")))).alias("p"))
    return packed.select("img", "y", F.transform("p", lambda p: p["v"]).alias("vals"))


def with_rows_around(rows: DataFrame, radius: int, clamp: bool, column: str = "vals") -> DataFrame:
    """Adds `around`: the arrays of rows y - radius .. y + radius. Outside the image the nearest
    row is taken (clamp) or null is."""
    band = lambda c: F.floor(c / BAND).cast("int")
    copies = F.array_distinct(F.array(band(F.col("y") - radius), band(F.col("y")), band(F.col("y") + radius)))
    spread = rows.withColumn("band_", F.explode(copies))
    order = Window.partitionBy("img", "band_").orderBy("y")
    shifted = {0: F.col(column)}
    for k in range(1, radius + 1):
        for sign, f in ((-1, F.lag), (1, F.lead)):
            there = f(F.struct("y", F.col(column).alias("a")), k).over(order)
            value = F.when(there["y"] == F.col("y") + sign * k, there["a"])
            shifted[sign * k] = F.coalesce(value, shifted[sign * (k - 1)]) if clamp else value
    out = spread.withColumn("around", F.array(*[shifted[k] for k in range(-radius, radius + 1)]))
    return out.where(F.col("band_") == band(F.col("y"))).drop("band_")


def each_cell(rows: DataFrame, kernel: Callable[[Column], Column], name: str = "v", keep: tuple[str, ...] = ()) -> DataFrame:
    """(img, y, x, name): kernel(x) for every x of a row with `vals`."""
    xs = F.sequence(F.lit(0), F.size("vals") - 1)
    return rows.select("img", "y", *keep, F.posexplode(F.transform(xs, kernel)).alias("x", name))


def at(dy: int, x: Column, radius: int) -> Column:
    """The value dy rows below and at column x; null outside."""
    return F.get(F.get(F.col("around"), F.lit(dy + radius)), x)


def inside(x: Column) -> Column:
    """Not on the image's border."""
    return (x > 0) & (x < F.size("vals") - 1) & F.get(F.col("around"), F.lit(0)).isNotNull() & F.get(F.col("around"), F.lit(2)).isNotNull()


def median5(rows: DataFrame, name: str = "m", keep: tuple[str, ...] = ()) -> DataFrame:
    """STN01: median of the 5 x 5 neighbourhood, the border's cells repeated outwards; `keep` are
    columns of the row that go along."""
    near = with_rows_around(rows, 2, clamp=True)
    last = F.size("vals") - 1

    def kernel(x: Column) -> Column:
        cols = [F.greatest(F.lit(0), F.least(last, x + d)) for d in range(-2, 3)]
        return F.element_at(F.sort_array(F.array(*[at(dy, c, 2) for dy in range(-2, 3) for c in cols])), 13)

    return each_cell(near, kernel, name, keep)


def sobel_at(x: Column, v: Callable[[int, int], Column], scale: float) -> Column:
    """The gradient at column x; v gives the value dy rows below and dx columns on."""
    gx = v(-1, 1) - v(-1, -1) + 2 * (v(0, 1) - v(0, -1)) + v(1, 1) - v(1, -1)
    gy = v(1, -1) - v(-1, -1) + 2 * (v(1, 0) - v(-1, 0)) + v(1, 1) - v(-1, 1)
    return F.when(inside(x), F.sqrt(gx * gx + gy * gy) / scale).otherwise(0.0)


def sobel(rows: DataFrame, name: str = "g", scale: float = 1.0) -> DataFrame:
    """STN02, STN03, STN04: 3 x 3 gradient magnitude over `scale`, 0 on the border. The
    normalisation (by the maximum or by percentiles) is the caller's."""
    near = with_rows_around(rows, 1, clamp=False)
    return each_cell(near, lambda x: sobel_at(x, lambda dy, dx: at(dy, x + dx, 1), scale), name)


def over_max(cells: DataFrame, value: str, floor: float = 0.0) -> DataFrame:
    """AGG10: value over the image's maximum, at least `floor`; unchanged where that is 0."""
    top = cells.groupBy("img").agg(F.greatest(F.max(value), F.lit(floor)).alias("top_"))
    return cells.join(top, "img").withColumn(value, F.when(F.col("top_") > 0, F.col(value) / F.col("top_")).otherwise(F.col(value))).drop("top_")


def forward_gradients(rows: DataFrame) -> DataFrame:
    """STN05: (dx, dy), absolute forward differences, 0 at the far border."""
    near = with_rows_around(rows, 1, clamp=False)
    kernel = lambda x: F.struct(
        F.coalesce(F.abs(at(0, x + 1, 1) - at(0, x, 1)), F.lit(0.0)).alias("dx"), F.coalesce(F.abs(at(1, x, 1) - at(0, x, 1)), F.lit(0.0)).alias("dy")
    )
    return each_cell(near, kernel, "d").select("img", "y", "x", "d.dx", "d.dy")


def central_magnitude(rows: DataFrame, name: str = "g") -> DataFrame:
    """STN07: central differences, magnitude, 0 on the border (normalise with over_max)."""
    near = with_rows_around(rows, 1, clamp=False)

    def kernel(x: Column) -> Column:
        gx, gy = at(0, x + 1, 1) - at(0, x - 1, 1), at(1, x, 1) - at(-1, x, 1)
        return F.when(inside(x), F.sqrt(gx * gx + gy * gy)).otherwise(0.0)

    return each_cell(near, kernel, name)


def depth_importance_at(x: Column, v: Callable[[int, int], Column]) -> Column:
    gx, gy = F.abs(v(0, 1) - v(0, -1)), F.abs(v(1, 0) - v(-1, 0))
    return F.when(inside(x), F.lit(1.0) + (gx + gy) / 2 * 2).otherwise(1.0)


def depth_importance(rows: DataFrame, name: str = "g") -> DataFrame:
    """STN06: 1 + 2 (gx + gy) / 2 with absolute central differences, 1 on the border."""
    near = with_rows_around(rows, 1, clamp=False)
    return each_cell(near, lambda x: depth_importance_at(x, lambda dy, dx: at(dy, x + dx, 1)), name)


def luma_and_depth(rows: DataFrame, scale: float = 255.0) -> DataFrame:
    """(img, y, x, e_, b_): STN02 of field l and STN06 of field d of rows (img, y, vals: structs), in
    one pass."""
    near = with_rows_around(rows, 1, clamp=False)

    def kernel(x: Column) -> Column:
        of = lambda k: lambda dy, dx: at(dy, x + dx, 1)[k]
        return F.struct(sobel_at(x, of("l"), scale).alias("e_"), depth_importance_at(x, of("d")).alias("b_"))

    return each_cell(near, kernel, "g").select("img", "y", "x", "g.e_", "g.b_")


def combined_importance(base: DataFrame, edges: DataFrame) -> DataFrame:
    """STN13: 0.7 base + 0.3 edges (both normalised), over their maximum, at least 1."""
    both = base.select("img", "y", "x", F.col("g").alias("b_")).join(edges.select("img", "y", "x", F.col("g").alias("e_")), ["img", "y", "x"])
    return over_max(both.select("img", "y", "x", (F.col("b_") * 0.7 + F.col("e_") * 0.3).alias("g")), "g", 1.0)


def non_maximum(rows: DataFrame, name: str = "v") -> DataFrame:
    """STN08: 0 where any of the 8 neighbours is strictly greater."""
    near = with_rows_around(rows, 1, clamp=False)

    def kernel(x: Column) -> Column:
        around = [at(dy, x + dx, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
        return F.when(F.greatest(*around) > at(0, x, 1), 0.0).otherwise(at(0, x, 1))

    return each_cell(near, kernel, name)


def spans(rows: DataFrame, name: str = "span") -> DataFrame:
    """STN10: whether the 3 x 3 neighbourhood, the cell included, holds two different values."""
    near = with_rows_around(rows, 1, clamp=False)

    def kernel(x: Column) -> Column:
        around = [at(dy, x + dx, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        return F.greatest(*around) != F.least(*around)

    return each_cell(near, kernel, name)


def mean3(rows: DataFrame, name: str = "m") -> DataFrame:
    """STN09: mean of the 3 x 3 neighbourhood within the image."""
    near = with_rows_around(rows, 1, clamp=False)

    def kernel(x: Column) -> Column:
        around = F.filter(F.array(*[at(dy, x + dx, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]), lambda v: v.isNotNull())
        return F.aggregate(around, F.lit(0.0), lambda s, v: s + v) / F.size(around)

    return each_cell(near, kernel, name)


#: dy, dx of the cells a stroke of each thickness covers; 4 and more: the diamond of radius t / 2.
def stroke(thickness: int) -> list[tuple[int, int]]:
    if thickness <= 1:
        return [(0, 0)]
    if thickness == 2:
        return [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
    if thickness == 3:
        return [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    r = thickness // 2
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dy) + abs(dx) <= r]


def spread_mask(mask: DataFrame, offsets: list[tuple[int, int]], height: int, width: int) -> DataFrame:
    """STN12: the cells (img, y, x) covered when each offset is applied to each cell of mask."""
    moves = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets]))
    moved = mask.select("img", "y", "x", moves.alias("m")).select("img", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"))
    return moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).distinct()


NEIGHBOURS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def with_neighbour(mask: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """STN11 and the step of a flood: the cells of mask with one of the 8 neighbours in `other`
    (mask itself by default). Each cell of `other` is spread to its neighbours, then one
    left semi join on the cell."""
    source = mask if other is None else other
    moves = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in NEIGHBOURS]))
    near = source.select("img", "y", "x", moves.alias("m")).select("img", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x")).distinct()
    return mask.join(near, ["img", "y", "x"], "left_semi")
