"""Hand-computed small rasters and invariants."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import config
from tessella.functions import color, tensors, text
from tessella.operators import edges, geometry, palette, regions, stats, stencil
from tessella.plans import stylise
from tessella.sources import fixtures, images, models
from tessella.sources.palettes import PALETTES
from tessella.streaming import incremental


def raster(spark, grid):
    return spark.createDataFrame([("i", y, x, float(v)) for y, row in enumerate(grid) for x, v in enumerate(row)], "img string, y int, x int, v double")


def as_grid(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r[value]
    return out


def cells(spark, points):
    return spark.createDataFrame([("i", y, x) for y, x in points], "img string, y int, x int")


def points(df):
    return sorted((r["y"], r["x"]) for r in df.collect())


def test_median_of_a_constant_and_of_a_spike(spark):
    assert (as_grid(stencil.median5(stencil.rows_of(raster(spark, np.full((3, 4), 2.0)))), "m", (3, 4)) == 2).all()
    spike = np.zeros((5, 5))
    spike[2, 2] = 9
    assert (as_grid(stencil.median5(stencil.rows_of(raster(spark, spike))), "m", (5, 5)) == 0).all()


def test_median_crosses_bands(spark):
    grid = np.arange(stencil.BAND * 2 + 3)[:, None] * np.ones((1, 3))
    got = as_grid(stencil.median5(stencil.rows_of(raster(spark, grid))), "m", grid.shape)
    assert (got[2:-2] == grid[2:-2]).all()


def test_sobel_and_nms(spark):
    step = np.zeros((4, 4))
    step[:, 2:] = 1
    g = as_grid(stencil.sobel(stencil.rows_of(raster(spark, step))), "g", (4, 4))
    assert g[1, 1] == g[1, 2] == 4 and g[0].sum() == 0
    once = stencil.non_maximum(stencil.rows_of(raster(spark, g)))
    twice = stencil.non_maximum(stencil.rows_of(once))
    assert (as_grid(once, "v", (4, 4)) == as_grid(twice, "v", (4, 4))).all()


def test_nearest_rank_and_ties(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 10.0)] + [("b", 5.0)] * 3, "k string, v double")
    got = {r["k"]: r for r in stats.nearest_ranks(df, ["k"], "v", {"p95": 0.95, "p50": 0.5}).collect()}
    assert (got["a"]["p95"], got["a"]["p50"], got["b"]["p95"]) == (10.0, 3.0, 5.0)


def test_median_even_odd_nan_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", None), ("c", float("nan")), ("c", 1.0), ("c", 2.0)], "k string, v double")
    got = {r["k"]: r["med"] for r in stats.medians(df, ["k"], "v").collect()}
    assert got == {"a": 1.5, "b": 3.0, "c": 2.0}


def test_large_and_small_mad_agree(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    a = sorted(map(tuple, stats.mad_stats(df, ["k"], "v").select("k", "n", "med", "mad").collect()))
    assert a == sorted(map(tuple, stats.mad_stats(df, ["k"], "v", large=True).select("k", "n", "med", "mad").collect()))


def test_otsu_of_one_value_and_two(spark):
    one = raster(spark, [[0.5, 0.5]])
    assert stats.otsu(stats.histogram(one, "v", ["img"]), ["img"]).first()["thr"] == 0.6
    two = raster(spark, [[0.0, 1.0]])
    assert stats.otsu(stats.histogram(two, "v", ["img"]), ["img"]).first()["thr"] == 0.0


def test_lab_roundtrip_is_exact(spark):
    df = spark.range(0, 256 * 7, 7).select((F.col("id") % 256).alias("r"), (F.col("id") * 3 % 256).alias("g"), (F.col("id") * 11 % 256).alias("b"))
    back = color.lab_to_rgb(*color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b")))
    assert df.where((back[0] != F.col("r")) | (back[1] != F.col("g")) | (back[2] != F.col("b"))).count() == 0


def test_quantised_colours_are_in_the_palette(spark):
    px = fixtures.busy(spark, 24)
    got = {(r["r"], r["g"], r["b"]) for r in palette.quantise(px, PALETTES["nes"]).select("r", "g", "b").distinct().collect()}
    assert got <= set(PALETTES["nes"])


def test_palette_sizes():
    assert {k: len(v) for k, v in PALETTES.items()} == {"none": 0, "gameboy": 4, "gameboy_color": 8, "pico8": 16, "nes": 54, "dawnbringer32": 32, "aap64": 63}


def test_generated_palette_is_stable_and_from_the_image(spark):
    px = fixtures.bands(spark, 30)
    one, two = (palette.generate(px, "auto", 3) for _ in range(2))
    assert one == two and set(one) == {(80, 120, 200), (255, 220, 180), (200, 60, 60)}
    assert palette.generate(px, "custom", custom=[[1, 2, 3]]) == [(1, 2, 3)] and palette.generate(px, "preset", preset="none") == []


def test_kmeans_edges():
    assert len(palette.kmeans(np.zeros((0, 3)), 4)) == 0
    assert len(palette.kmeans(np.ones((2, 3)), 4)) == 2


def test_components_and_split(spark):
    mask = cells(spark, [(0, 0), (1, 1), (0, 3), (0, 4), (2, 5)])
    assert sorted(r["n"] for r in regions.components(mask).groupBy("comp").agg(F.count("*").alias("n")).collect()) == [1, 2, 2]
    lab = spark.createDataFrame([("i", 0, x, r) for x, r in enumerate([0, 0, 1, 0, None])], "img string, y int, x int, region long")
    got = {r["x"]: r["region"] for r in regions.split_disconnected(lab).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: None}


@pytest.mark.parametrize("band", [64, 3])
def test_components_partition_and_match_a_flood(spark, band, monkeypatch):
    monkeypatch.setattr(regions, "BAND", band)
    rng = np.random.default_rng(3)
    grid = rng.random((23, 31)) < 0.45
    got = {(r["y"], r["x"]): r["comp"] for r in regions.components(cells(spark, np.argwhere(grid).tolist())).collect()}
    assert set(got) == {tuple(p) for p in np.argwhere(grid).tolist()}
    seen = {}
    for p in sorted(got):
        if p in seen:
            continue
        stack, own = [p], []
        seen[p] = p
        while stack:
            y, x = stack.pop()
            own.append((y, x))
            for q in [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
                if q in got and q not in seen:
                    seen[q] = p
                    stack.append(q)
        assert len({got[q] for q in own}) == 1 and got[p] == p[0] * (1 << 32) + p[1]


def test_hysteresis(spark):
    df = raster(spark, [[1.0, 0.5, 0.0, 0.5], [0.0, 0.0, 0.0, 0.0]])
    assert points(edges.hysteresis(df, 1.0)) == [(0, 0), (0, 1)]


def test_thinning():
    bar = np.zeros((7, 9), bool)
    bar[2:5, 1:8] = True
    thin = edges.thin_array(bar)
    assert (thin <= bar).all() and 0 < thin.sum() < bar.sum() and (edges.thin_array(thin) == thin).all()
    assert edges.thin_array(np.ones((2, 5), bool)).all()


def test_bridge_and_cleanup(spark):
    assert points(edges.bridge(cells(spark, [(0, 0), (0, 2), (3, 3), (5, 4)]), (8, 8))) == [(0, 0), (0, 1), (0, 2), (3, 3), (4, 3), (4, 4), (5, 4)]
    assert points(edges.cleanup(cells(spark, [(0, 0), (0, 1), (0, 2), (5, 5), (7, 0), (7, 1)]), (8, 8), 3)) == [(0, 0), (0, 1), (0, 2)]


def test_classification_modes(spark):
    mask = cells(spark, [(1, 1), (1, 3)])
    lab = spark.createDataFrame([("i", y, x, 0 if x < 2 else 1) for y in range(3) for x in range(6)], "img string, y int, x int, region long")
    assert points(edges.classify(mask, (3, 6), "outlines", lab)) == [(1, 1)]
    assert points(edges.classify(mask, (3, 6), "internal", lab)) == [(1, 3)]
    assert points(edges.classify(mask, (3, 6), "none", lab)) == []
    notes = []
    assert points(edges.classify(mask, (3, 6), "internal", warnings=notes)) == [(1, 1), (1, 3)] and notes


def test_arrays_agree_with_joins(spark):
    """The numpy edge stage against the distributed operators."""
    rng = np.random.default_rng(11)
    v = rng.random((14, 17)) ** 2
    size = v.shape
    rows = stencil.rows_of(raster(spark, v))
    top = edges.nms_array(v)
    assert (as_grid(stencil.non_maximum(rows), "v", size) == top).all()
    mask = edges.grow_array(v >= 0.7, (v >= 0.3) & (v < 0.7))
    assert points(edges.hysteresis(raster(spark, v), 0.7).where("true")) == sorted(map(tuple, np.argwhere(edges.grow_array(v >= 0.7, (v >= 0.28) & (v < 0.7))).tolist()))
    own = cells(spark, np.argwhere(mask).tolist())
    assert points(edges.thin(own, size)) == sorted(map(tuple, np.argwhere(edges.thin_array(mask)).tolist()))
    bones = rng.random(size) < 0.12
    thin = cells(spark, np.argwhere(bones).tolist())
    assert points(edges.cleanup(thin, size, 4)) == sorted(map(tuple, np.argwhere(edges.cleanup_array(bones, 4)).tolist()))
    labels = (np.arange(v.size).reshape(size) % 17 > 8).astype(float)
    lab = spark.createDataFrame([("i", y, x, int(labels[y, x])) for y in range(14) for x in range(17)], "img string, y int, x int, region long")
    seg = raster(spark, v)
    for mode in ("none", "outlines", "internal", "both"):
        for got, want in ((edges.classify(own, size, mode, lab), edges.classify_array(mask, mode, labels, None)), (edges.classify(own, size, mode, seg=seg), edges.classify_array(mask, mode, None, v)), (edges.classify(own, size, mode, warnings=[]), edges.classify_array(mask, mode, None, None))):
            assert points(got) == sorted(map(tuple, np.argwhere(want).tolist()))
    px = fixtures.busy(spark, 20)
    assert points(edges.sobel_mask(px, 0.4)) == sorted(map(tuple, np.argwhere(edges.sobel_mask_array(edges.to_array(px.toPandas(), (20, 20)), 0.4)).tolist()))


def test_stroke_shapes():
    assert [len(stencil.stroke(t)) for t in (1, 2, 3, 4, 6)] == [1, 5, 9, 13, 25]


def test_anti_alias_is_across_the_line():
    image = np.full((3, 5, 4), 255, np.int64)
    image[1] = (0, 0, 0, 255)
    bones = np.zeros((3, 5), bool)
    bones[1] = True
    edges.anti_alias_array(image, bones)
    assert image[0, 2, 0] == round(255 * 0.65 + 0.0001) and image[1, 2, 0] == 0


def test_geometry_identities(spark):
    px = fixtures.gradient(spark, 8)
    size = (8, 8)
    for same in (geometry.flip(geometry.flip(px, size, True, True), size, True, True), geometry.offset(px, size, 0.0, 0.0), geometry.downsample_nearest(px, size, size), geometry.downsample_triangle(px, size, size)):
        assert images.differing(px, same).first()["n"] == 0 and same.count() == 64
    turned = geometry.rotate(px, size, 30.0)
    assert images.differing(turned, geometry.rotate(px, size, -30.0)).first()["n"] == 0
    assert images.differing(turned, geometry.rotate(px, size, -30.0, compat=False)).count() == 1


def test_sizes():
    assert geometry.max_dimension((2048, 1024), 1024) == (1024, 512) and geometry.max_dimension((10, 10), 0) == (10, 10)
    assert geometry.output_size((100, 200), 32) == (32, 32) and geometry.output_size((100, 200), 32, "preserve") == (16, 32)
    assert geometry.output_size((1, 1000), 32, "preserve") == (8, 32) and geometry.output_size((1, 1), 0, "custom", (4, 90)) == (8, 90)
    assert tensors.even_bands(4) == [0.0, 0.25, 0.5, 0.75] and tensors.Scale((100, 200), (50, 50)).normalised(25, 10) == (0.5, 0.2)


def test_resample_to_the_same_size(spark):
    r = raster(spark, np.arange(12).reshape(3, 4))
    for f in (geometry.resample_bilinear, geometry.resample_nearest, geometry.upsample_model):
        assert (as_grid(f(stencil.rows_of(r), (3, 4), (3, 4)), "v", (3, 4)) == np.arange(12).reshape(3, 4)).all()


def test_png_roundtrip(spark, tmp_path):
    px = fixtures.busy(spark, 16)
    images.write_png(px, (16, 16), str(tmp_path), 2)
    back = images.read_images(spark, str(tmp_path)).withColumn("img", F.lit("busy"))
    assert back.count() == 32 * 32
    small = back.where("y % 2 = 0 and x % 2 = 0").withColumn("y", (F.col("y") / 2).cast("int")).withColumn("x", (F.col("x") / 2).cast("int"))
    assert images.differing(px, small).first()["n"] == 0


def test_presets_and_config(tmp_path):
    for p in config.PRESETS:
        assert config.from_json(config.to_json(p)) == p
    assert config.from_json('{"name": "x", "unknown": 1, "palette": {"custom": [[1, 2, 3]]}}').palette.custom == ((1, 2, 3),)
    path = tmp_path / "a" / "config.json"
    assert config.load_or_create(str(path)) == config.Preset() and json.loads(path.read_text())["name"] == "Default"
    assert set(config.MENU) == {"minimal", "detailed", "hd", "gameboy"}


def test_model_files(spark, tmp_path):
    (tmp_path / "dexined.onnx").write_bytes(b"x")
    have = models.files(spark, str(tmp_path))
    assert [tuple(r) for r in models.status(models.registry(spark), have).collect()] == [("depth_anything", False), ("edge_detection", True), ("segmentation", False)]


def test_contact_sheet_layout(spark):
    rows = [text.SheetRow("A", (10, 20), "g"), text.SheetRow("B", subtitle="s"), text.SheetRow("C", settings=(("k", "v"),))]
    placed, height, width = text.layout(rows, 40)
    assert width == 64 and [p["h"] for p in placed] == [32, 64, 19] and height == 8 + (22 + 32 + 8) + (22 + 14 + 64 + 8) + (22 + 19 + 8)
    sheet, size = text.contact_sheet(spark, fixtures.gradient(spark, 20).where("y < 10").withColumn("img", F.lit("g")), rows, 40)
    assert size == (height, width) and sheet.count() == height * width


FIXTURES = ("portrait", "bands", "busy", "high_detail", "gradient")


@pytest.mark.parametrize("name", FIXTURES[:2])
def test_pipeline_size_palette_and_determinism(spark, name):
    px = getattr(fixtures, name)(spark, 48)
    depth = fixtures.radial_depth(spark, 48, name)
    found = stylise.analyse(px, (48, 48))
    layers = stylise.Layers(depth=depth, edge=found.edge)
    runs = [stylise.run(px, (48, 48), (16, 16), layers, colors=config.PaletteConfig(max_colors=6)) for _ in range(2)]
    assert runs[0].palette == runs[1].palette and images.differing(runs[0].image, runs[1].image).first()["n"] == 0
    got = {(r["r"], r["g"], r["b"]) for r in runs[0].image.collect()}
    assert runs[0].image.count() == 256 and got <= set(runs[0].palette)


def test_pipeline_without_layers_or_palette(spark):
    px = fixtures.low_detail(spark, 24)
    out = stylise.run(px, (24, 24), (8, 8), edge=edges.EdgeConfig(mode="both"), colors=config.PaletteConfig("preset"))
    assert out.image.count() == 64 and out.palette == [] and out.warnings


def test_streaming_totals(spark, tmp_path):
    rows = [("i", y, [float(y), 1.0], y % 2) for y in range(6)]
    spark.createDataFrame(rows, incremental.ROWS).repartition(3).write.parquet(str(tmp_path / "in"))
    got = incremental.drain(incremental.region_totals(incremental.read_rows(spark, str(tmp_path / "in"), 1)), "totals", spark)
    assert sorted((r["region"], r["n"], r["total"]) for r in got.collect()) == [(0, 6, 9.0), (1, 6, 12.0)]


def test_written_tables_can_be_released(spark):
    from tessella.checkpoint import cut, release

    path = cut(spark.range(3)).inputFiles()[0]
    assert spark.read.parquet(path).count() >= 0
    release(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path.rsplit("/", 1)[0]).count()


def test_running_sum_pick_over_blocks(spark, monkeypatch):
    """CLU03 equals a plain running sum whatever the blocks; 0 picks the first, beyond 1 the last."""
    rng = np.random.default_rng(4)
    q = rng.integers(0, 50, 300).tolist()
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(q)], "k long, q long").repartition(3)
    for block in (1, 7, 1 << 16):
        monkeypatch.setattr(palette, "BLOCK", block)
        for u in (0.0, 0.1, 0.5, 0.99, 1.0, 1.5):
            run = np.cumsum(q)
            want = int(np.argmax(run >= u * run[-1])) if u <= 1 else 299
            assert palette.plus_plus_pick(rows, "q", "k", u).first()["k"] == want
    assert palette.plus_plus_pick(rows.limit(0), "q", "k", 0.5).count() == 0


def test_ranks_are_the_same_either_way(spark):
    rng = np.random.default_rng(9)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 4, 500), np.round(rng.normal(0, 1, 500), 2), strict=True)] + [(1, float("nan")), (2, None), (7, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    both = [sorted(map(str, stats.nearest_ranks(df, ["g"], "v", {"a": 0.0, "b": 0.33, "c": 0.95, "d": 1.0}, large).collect())) for large in (True, False)]
    assert both[0] == both[1] and len(both[0]) == 4


def test_cells_without_a_region_row_have_no_region(spark):
    """An edge between region 0 and cells that the layer lacks is an outline; within either it isn't."""
    from tessella.operators.edges import EdgeConfig, draw

    size = (12, 12)
    px = spark.createDataFrame([("i", y, x, 10, 10, 10, 255) for y in range(12) for x in range(12)], "img string, y int, x int, r int, g int, b int, a int")
    edge = spark.createDataFrame([("i", y, x, 1.0 if y in (3, 6) else 0.0) for y in range(12) for x in range(12)], "img string, y int, x int, v double")
    labels = spark.createDataFrame([("i", y, x, 0) for y in range(6) for x in range(12)], "img string, y int, x int, region long")
    changed = draw(px, edge, labels, None, size, EdgeConfig(mode="outlines", threshold=0.5), [(255, 255, 255), (0, 0, 0)]).where("r <> 10")
    rows = {r["y"] for r in changed.select("y").distinct().collect()}
    assert rows and 3 not in rows


def test_shared_folder_is_refused_off_a_local_master(spark, monkeypatch):
    from tessella import checkpoint

    assert checkpoint.shared_folder(spark)
    monkeypatch.setattr(checkpoint, "_is_local", lambda master: False)
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            checkpoint.shared_folder(spark)


def test_slic_over_many_images(spark):
    """Each image is segmented as it is alone, whatever other images are there; two flat halves apart."""
    size = (16, 16)
    rows = [(img, y, x, *((200, 30, 30) if (x if img == "a" else y) < 8 else (30, 30, 200)), 255, 1.0 if img != "c" else float(x >= 4)) for img in "abc" for y in range(16) for x in range(16)]
    px = spark.createDataFrame(rows, "img string, y int, x int, r int, g int, b int, a int, s double")
    every = regions.slic(px, size, k=6, seg="s")
    got = {(r["img"], r["y"], r["x"]): r["region"] for r in every.collect()}
    assert len(got) == 3 * 256
    for img in "abc":
        alone = {(r["img"], r["y"], r["x"]): r["region"] for r in regions.slic(px.where(px.img == img), size, k=6, seg="s").collect()}
        assert alone == {k: v for k, v in got.items() if k[0] == img}
    sides = {half: {got["a", y, x] for y in range(16) for x in range(16) if (x < 8) == half and got["a", y, x] is not None} for half in (True, False)}
    assert sides[True] and sides[False]


def test_jpeg_is_near_the_image(spark, tmp_path):
    """Read back by Spark's own decoder; nearer with a higher quality, at sizes that are no multiple of 8."""
    px = fixtures.gradient(spark, 21).where("y < 13")
    gaps = []
    for quality in (95, 50, 5):
        folder = tmp_path / str(quality)
        folder.mkdir()
        images.write_images(px, (13, 21), str(folder), 2, "jpeg", quality)
        back = images.read_images(spark, str(folder)).withColumn("img", F.lit("gradient"))
        assert back.count() == 26 * 42 and back.where("a <> 255").isEmpty()
        near = back.join(px.select((F.col("y") * 2).alias("y"), (F.col("x") * 2).alias("x"), *[F.col(c).alias(f"w{c}") for c in "rgb"]), ["y", "x"])
        gaps.append(near.agg(F.avg(sum(F.abs(F.col(c) - F.col(f"w{c}")) for c in "rgb") / 3)).first()[0])
    assert gaps[0] < 3 and gaps[0] < gaps[1] < gaps[2] < 40


def test_images_from_memory_and_shrunk(spark, tmp_path):
    px = fixtures.busy(spark, 40).where("y < 30")
    data = {r["img"]: bytes(r["data"]) for r in images.encode(px, (30, 40)).collect()}
    (name,) = data
    back = images.read_bytes(spark, data | {"broken": b"no image"})
    assert back.count() == 1200 and images.differing(px, back).first()["n"] == 0
    small = images.read_bytes(spark, data, 16)
    want = geometry.resize_lanczos(px, (30, 40), (12, 16))
    assert small.count() == 12 * 16 and images.differing(want, small).first()["n"] == 0
    images.write_png(px, (30, 40), str(tmp_path))
    assert images.differing(small, images.read_images(spark, str(tmp_path), 16).withColumn("img", F.lit(name))).first()["n"] == 0
    assert images.read_bytes(spark, {"broken": b""}).count() == 0
