"""The stylisation pipeline: depth shading, transforms, palette, downsampling, edges.

One call is one lazy plan over the images of ``pixels``; only palettes (at most 128 colours) and
convergence flags reach the driver. All images of a call have one size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..config import PaletteConfig, ShadingConfig, TransformConfig
from ..functions import color
from ..operators import blocks, edges, geometry, palette, regions, stats, stencil
from ..operators.edges import EdgeConfig


@dataclass(frozen=True)
class Layers:
    """Optional layers of an image: depth, edge, seg (img, y, x, v), region (img, y, x, region)."""

    depth: DataFrame | None = None
    edge: DataFrame | None = None
    seg: DataFrame | None = None
    region: DataFrame | None = None


@dataclass
class Output:
    image: DataFrame
    palette: list[tuple[int, int, int]]
    preprocessed: DataFrame
    flat: DataFrame
    warnings: list[str] = field(default_factory=list)


def wide_rows(pixels: DataFrame, layers: Layers) -> DataFrame:
    """(img, y, p): all layers of a row of cells as one array of structs (x, r, g, b, a, v, region,
    seg), in the order of x. One union and one shuffle, by row, in place of a join a layer; cells
    that pixels, depth or segmentation lack are left out."""
    types = {"r": "int", "g": "int", "b": "int", "a": "int", "v": "double", "region": "long", "seg": "double"}

    def part(df: DataFrame, **given: str) -> DataFrame:
        return df.select("img", "y", "x", *[(F.col(given[c]) if c in given else F.lit(None)).cast(t).alias(c) for c, t in types.items()])

    whole = part(pixels, r="r", g="g", b="b", a="a").unionByName(part(layers.depth, v="v"))
    if layers.region is not None:
        whole = whole.unionByName(part(layers.region, region="region"))
    if layers.seg is not None:
        whole = whole.unionByName(part(layers.seg, seg="v"))
    cells = whole.repartition("img", "y").groupBy("img", "y", "x").agg(*[F.max(c).alias(c) for c in types])
    there = F.col("r").isNotNull() & F.col("v").isNotNull() & (F.col("seg").isNotNull() if layers.seg is not None else F.lit(True))
    return cells.where(there).groupBy("img", "y").agg(F.sort_array(F.collect_list(F.struct("x", *types))).alias("p"))


def filtered_cells(pixels: DataFrame, layers: Layers) -> DataFrame:
    """(img, y, x, r, g, b, a, v, region, seg) with the depth v filtered by STN01."""
    rows = wide_rows(pixels, layers).withColumn("vals", F.transform("p", lambda p: p["v"]))
    med = stencil.median5(rows, "m", keep=("p",))
    return med.select("img", "y", F.get("p", F.col("x")).alias("p"), F.col("m").alias("v")).select("img", "y", "p.x", "p.r", "p.g", "p.b", "p.a", "v", "p.region", "p.seg")


def region_rows(cells: DataFrame, size, config: ShadingConfig) -> DataFrame:
    """(img, region, med, mad, is_bg) of the cells' regions: AGG05 and CMP01's region rule."""
    inside = cells.where("region is not null")
    if stats.is_large(size):
        per = stats.mad_stats(inside, ["img", "region"], "v").drop("n").join(regions.region_stats(cells, size), ["img", "region"])
    else:
        per = stats.gathered_stats(inside, ["img", "region"], "v", regions.on_border(size))
    return regions.with_background(per, size, config.bg_cluster_size_pct).select("img", "region", "med", "mad", "is_bg")


def depth_to_flat(pixels: DataFrame, size, layers: Layers, config: ShadingConfig = ShadingConfig()) -> DataFrame:
    """CMP02: foreground lit by the shading (PRJ08 with AGG05, FIL05, NRM04), background toned down;
    without depth unchanged. Without regions the image is one. The cells are written once; statistics
    are a row a region or image, joined to them."""
    if layers.depth is None:
        return pixels
    cells = cut(filtered_cells(pixels, layers))
    if layers.region is None:
        cells = cells.withColumn("region", F.lit(0).cast("long"))
    ends = stats.nearest_ranks(cells, ["img"], "v", stats.SHADED, stats.is_large(size))
    rows = cells.join(region_rows(cells, size, config), ["img", "region"], "left").join(ends, "img")
    if layers.seg is not None:
        rows = rows.withColumn("is_bg", F.col("seg") < 0.5)
    elif layers.region is not None:
        rows = rows.withColumn("is_bg", F.coalesce("is_bg", F.lit(True)))
    else:
        thr = stats.background_threshold(cells, "v", ["img"], config.use_otsu, config.bg_depth_threshold)
        rows = rows.join(thr, "img").withColumn("is_bg", F.col("v") > F.col("thr"))
    local = stats.shading_from_stats(F.col("v"), F.col("region"), F.col("med"), F.col("mad"), config.mad_threshold)
    even = F.when(F.col("mad") < config.mad_threshold, 0.0).otherwise(1.0)
    weight = min(max(config.global_depth_weight, 0.0), 1.0)
    rows = rows.withColumn("shade", stats.blended_shading(stats.shading_between("v", F.col("p_lo"), F.col("p_hi")), local, even, weight))
    rows = color.with_lab(rows.select("img", "y", "x", "r", "g", "b", "a", "shade", "is_bg"))
    lab = tuple(F.col(k) for k in ("l_", "a_", "b_"))
    back = color.background_lab(*lab, config.bg_desaturation, config.bg_lightness_shift)
    front = (color.foreground_lightness(lab[0], F.col("shade"), config.strength, config.gamma, config.l_shift_scale), lab[1], lab[2])
    rows = rows.withColumns({k: F.when(F.col("is_bg"), b).otherwise(f) for k, b, f in zip(("l_", "a_", "b_"), back, front, strict=True)})
    rows = color.with_rgb(rows, ("nr", "ng", "nb"))
    same = ~F.col("is_bg") & ((F.abs(F.col("shade")) < 0.001) if config.strength >= 0.001 else F.lit(True))
    return rows.select("img", "y", "x", *[F.when(same, F.col(c)).otherwise(F.col(f"n{c}")).alias(c) for c in "rgb"], "a")


def resample_layers(layers: Layers, size, out) -> Layers:
    """GEO13: depth and segmentation bilinear, edges and regions nearest."""
    if size == out:
        return layers
    soft = lambda df: geometry.resample_bilinear(stencil.rows_of(df), size, out) if df is not None else None
    hard = lambda df, v: geometry.resample_nearest(stencil.rows_of(df.withColumn(v, F.coalesce(F.col(v).cast("double"), F.lit(-1.0))), v), size, out) if df is not None else None
    edge, region = hard(layers.edge, "v"), hard(layers.region, "region")
    if region is not None:
        region = region.select("img", "y", "x", F.when(F.col("v") >= 0, F.col("v").cast("long")).alias("region"))
    return Layers(soft(layers.depth), edge, soft(layers.seg), region)


def importance(pixels: DataFrame, layers: Layers, size) -> DataFrame:
    """STN13: (img, y, x, w): depth and luma gradients; without depth the base is 1. Both stencils
    run over one array of structs a row, and are written once, as their maxima are needed first."""
    luma = pixels.select("img", "y", "x", color.luma(F.col("r"), F.col("g"), F.col("b")).cast("double").alias("l"))
    if layers.depth is None:
        cells = luma.withColumn("d", F.lit(1.0))
    else:
        both = luma.withColumn("d", F.lit(None).cast("double")).unionByName(layers.depth.select("img", "y", "x", F.lit(None).cast("double").alias("l"), F.col("v").cast("double").alias("d")))
        cells = both.repartition("img", "y").groupBy("img", "y", "x").agg(F.max("l").alias("l"), F.max("d").alias("d")).where("l is not null and d is not null")
    rows = cells.groupBy("img", "y").agg(F.sort_array(F.collect_list(F.struct("x", "l", "d"))).alias("vals"))
    grads = cut(stencil.luma_and_depth(rows))
    tops = grads.groupBy("img").agg(F.max("e_").alias("e_top"), F.greatest(F.max("b_"), F.lit(1.0)).alias("b_top"))
    edge = F.when(F.col("e_top") > 0, F.col("e_") / F.col("e_top")).otherwise(F.col("e_"))
    base = F.col("b_") / F.col("b_top") if layers.depth is not None else F.lit(1.0)
    mixed = grads.join(tops, "img").select("img", "y", "x", (base * 0.7 + edge * 0.3).alias("w"))
    return stencil.over_max(mixed, "w", 1.0)


def as_prefix(layer: DataFrame, value: str, width: int, out) -> DataFrame:
    """The layer read with the output's width as its stride: cell (y, x) is flat position
    y * out width + x of the layer."""
    flat = F.col("y").cast("long") * width + F.col("x")
    at = layer.withColumn("i_", flat).where(F.col("i_") < out[0] * out[1])
    return at.select("img", F.floor(F.col("i_") / out[1]).cast("int").alias("y"), F.pmod(F.col("i_"), F.lit(out[1])).cast("int").alias("x"), value)


def draw_edges(pixels: DataFrame, out, layers: Layers | None, size, config: EdgeConfig, colors, warnings: list[str], compat: bool = True) -> DataFrame:
    """ITR05 with CMP03, ITR02, ITR04, CMP04. With compat, regions and segmentation are read as
    prefixes with the output's stride; without, they are resampled to the output first."""
    if config.mode == "none":
        return pixels
    edge = None
    if layers is not None and layers.edge is not None:
        edge = blocks.block_max(layers.edge, "v", size, out).select("img", F.col("oy").alias("y"), F.col("ox").alias("x"), "v")
    elif layers is not None:
        warnings.append("no edge map: gradients of the image are used")
    region, seg = (layers.region, layers.seg) if layers is not None else (None, None)
    if compat:
        # a layer smaller than the output doesn't count
        enough = size[0] * size[1] >= out[0] * out[1]
        region = as_prefix(region, "region", size[1], out) if region is not None and enough else None
        seg = as_prefix(seg, "v", size[1], out) if seg is not None and enough else None
    elif region is not None or seg is not None:
        small = resample_layers(Layers(seg=seg, region=region), size, out)
        region, seg = small.region, small.seg
    if config.mode == "internal" and region is None and seg is None:
        warnings.append("internal edges without regions or a segmentation: only edges beside a gap or the border are kept")
    return edges.draw(pixels, edge, region, seg, out, config, colors)


def downsample(pixels: DataFrame, size, out, method: str, colors, weights: DataFrame | None = None) -> DataFrame:
    """The five methods; palette and dither come out quantised, an empty palette makes them nearest."""
    as_pixels = lambda df: df.select("img", F.col("oy").alias("y"), F.col("ox").alias("x"), *"rgba")
    if method in ("palette", "dither") and not colors:
        method = "nearest"
    if method == "palette":
        med = blocks.block_median(pixels, size, out).withColumn("idx", palette.nearest_index((F.col("l"), F.col("a"), F.col("b")), colors))
        return as_pixels(med.select("img", "oy", "ox", *[palette.entry(F.col("idx"), colors, k).alias(c) for k, c in enumerate("rgb")], F.lit(255).alias("a")))
    if method == "dither":
        return edges.dither(pixels, size, out, colors)
    if method == "weighted":
        weighed = pixels.join(weights, ["img", "y", "x"], "left") if weights is not None else pixels.withColumn("w", F.lit(1.0))
        return as_pixels(blocks.block_mean_weighted(weighed, size, out, "w"))
    if method == "bilinear":
        return geometry.downsample_triangle(pixels, size, out)
    return geometry.downsample_nearest(pixels, size, out)


def run(pixels: DataFrame, size, out, layers: Layers | None = None, transform: TransformConfig = TransformConfig(), shade: ShadingConfig = ShadingConfig(), edge: EdgeConfig = EdgeConfig(), colors: PaletteConfig = PaletteConfig(), compat: bool = True) -> Output:
    """CMP07: the whole pipeline; size and out are (height, width)."""
    warnings: list[str] = []
    flat = cut(depth_to_flat(pixels, size, layers, shade)) if layers is not None else pixels
    moved, after = geometry.apply_transforms(flat, size, transform.scale, transform.rotation, transform.offset_x, transform.offset_y, transform.flip_horizontal, transform.flip_vertical)
    moved = cut(moved) if moved is not flat else flat
    near = resample_layers(layers, size, after) if layers is not None else None
    chosen = palette.generate(moved, colors.mode, colors.max_colors, colors.preset, colors.custom)
    if not chosen:
        warnings.append("the palette is empty: palette and dither downsampling take the nearest pixel, edges are black")
    weights = importance(moved, near or Layers(), after) if transform.method == "weighted" else None
    small = downsample(moved, after, out, transform.method, chosen, weights)
    if transform.method not in ("palette", "dither"):
        small = palette.quantise(small, chosen)
    small = cut(small)
    image = draw_edges(small, out, near, after, edge, chosen, warnings, compat)
    return Output(image, chosen, moved, flat, warnings)


def analyse(pixels: DataFrame, size, depth: bool = True, edge: bool = True, segmentation: bool = True) -> Layers:
    """CMP08 with the placeholders for models: radial depth with luma, Sobel edges, all
    foreground."""
    luma = pixels.select("img", "y", "x", color.luma(F.col("r"), F.col("g"), F.col("b")).cast("double").alias("v"))
    found: dict[str, DataFrame] = {}
    if depth:
        found["depth"] = placeholder_depth(luma, size)
    if edge:
        grad = stencil.sobel(stencil.rows_of(luma), "g", 255.0)
        found["edge"] = stats.percentile_normalised(grad, "g", ["img"], 0.05, 0.95, out="v", large=stats.is_large(size)).select("img", "y", "x", "v")
    if segmentation:
        found["seg"] = pixels.select("img", "y", "x", F.lit(1.0).alias("v"))
    return Layers(**found)


def placeholder_depth(luma: DataFrame, size) -> DataFrame:
    """PRJ14: 0.7 (1 - min(1, r / 2 rmax)) + 0.3 (1 - luma), min-max scaled."""
    cy, cx = size[0] / 2, size[1] / 2
    most = max(1.0, (cy * cy + cx * cx) ** 0.5)
    r = F.sqrt((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy))
    near = F.lit(1.0) - F.least(F.lit(1.0), r / most * 0.5)
    raw = luma.select("img", "y", "x", color.clamp(near * 0.7 + (1 - F.col("v") / 255) * 0.3, 0, 1).alias("d"))
    return stats.min_max(raw, "d", ["img"], "v").select("img", "y", "x", "v")
