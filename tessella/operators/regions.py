"""Regions: statistics, background classification, components, superpixels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..functions.color import clamp, with_lab
from . import stats, stencil
from .palette import uniform

#: Rows of an image whose runs of cells are joined by one task.
BAND = 64
#: So many links between bands are contracted by one task an image, more by joins.
FEW_LINKS = 200_000


def on_border(size) -> Column:
    """Whether one of the cells (y, x) is on the image's border."""
    return F.bool_or((F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == size[1] - 1) | (F.col("y") == size[0] - 1)).alias("border")


def region_stats(cells: DataFrame, size, value: str = "v") -> DataFrame:
    """AGG06: (img, region, mean, n, border): mean, number of cells, whether one is on the border."""
    return cells.where("region is not null").groupBy("img", "region").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"), on_border(size))


def with_background(per: DataFrame, size, pct: float = 0.15) -> DataFrame:
    """CMP01, the region rule: rows (img, region, mean, n, border) with is_bg: the mean above the
    70th percentile of the regions' means, and on the border or larger than the given share of the
    image."""
    p70 = stats.nearest_ranks(per, ["img"], "mean", {"p70": 0.7}, stats.is_large(size))
    most = int(size[0] * size[1] * min(max(pct, 0.0), 1.0))
    return per.join(p70, "img").withColumn("is_bg", (F.col("mean") > F.col("p70")) & (F.col("border") | (F.col("n") > most))).drop("p70")


def region_background(cells: DataFrame, size, pct: float = 0.15, value: str = "v") -> DataFrame:
    """CMP01, the region rule: (img, region, is_bg)."""
    return with_background(region_stats(cells, size, value), size, pct).select("img", "region", "is_bg")


def classify_background(cells: DataFrame, size, pct: float = 0.15, use_otsu: bool = True, manual: float = 0.6, value: str = "v", seg: str | None = None) -> DataFrame:
    """CMP01: cells with is_bg: by segmentation where there is one, else by regions (cells
    without a region are background), else by the depth threshold."""
    if seg:
        return cells.withColumn("is_bg", F.col(seg) < 0.5)
    if "region" in cells.columns:
        rule = region_background(cells, size, pct, value)
        return cells.join(rule, ["img", "region"], "left").withColumn("is_bg", F.coalesce("is_bg", F.lit(True)))
    thr = stats.background_threshold(cells, value, ["img"], use_otsu, manual)
    return cells.join(thr, "img").withColumn("is_bg", F.col(value) > F.col("thr")).drop("thr")


def components(mask: DataFrame, key: str | None = None) -> DataFrame:
    """AGG15, ITR03: mask with `comp`, the least cell index (y * 2^32 + x) of its 8-connected
    component; with key, only cells of one value of key are connected.

    Runs of cells in a row are one node. Runs are joined within bands of BAND rows by union-find,
    a band a task; what then links the bands, through their first rows, is contracted by joins,
    which at least halve it in each round. So a component of any size and shape takes few
    rounds, and an image within one band none.
    """
    part = ["img"] + ([key] if key else [])
    gap = F.col("x") - F.row_number().over(_order([*part, "y"], "x"))
    runs = mask.withColumn("run_", gap).groupBy(*part, "y", "run_").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    runs = runs.select("img", (F.col(key) if key else F.lit(0)).cast("long").alias("k_"), F.col("y").cast("long").alias("y"), F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1"))
    runs = runs.withColumn("node", F.col("y") * (1 << 32) + F.col("x0")).withColumn("band_", F.floor(F.col("y") / BAND))
    local = cut(runs.groupBy("img", "band_").applyInPandas(_joined_in_band, "img string, k_ long, y long, x0 long, x1 long, root long"))
    up = local.where(F.col("y") % BAND == BAND - 1).select("img", "k_", (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("root").alias("a"))
    edges = local.where(F.col("y") % BAND == 0).join(up, ["img", "k_", "y"]).where((F.col("u0") <= F.col("x1") + 1) & (F.col("u1") >= F.col("x0") - 1)).select("img", "a", F.col("root").alias("b"))
    edges = cut(edges.where("a <> b").distinct())
    labels = edges.groupBy("img").applyInPandas(_united, "img string, node long, comp long") if edges.count() <= FEW_LINKS else _contracted(edges)
    named = local.join(labels.withColumnRenamed("node", "root"), ["img", "root"], "left").withColumn("comp", F.coalesce("comp", "root"))
    cells = named.select("img", "k_", F.col("y").cast("int").alias("y"), F.explode(F.sequence("x0", "x1")).alias("x"), "comp").withColumn("x", F.col("x").cast("int"))
    if key:
        return mask.join(cells.withColumnRenamed("k_", key), ["img", key, "y", "x"])
    return mask.join(cells.drop("k_"), ["img", "y", "x"])


def _joined_in_band(pdf: pd.DataFrame) -> pd.DataFrame:
    """Adds to the runs of one band the least node of what they touch, row by row, in it."""
    pdf = pdf.sort_values(["k_", "y", "x0"], ignore_index=True)
    k, y, x0, x1 = (pdf[c].tolist() for c in ("k_", "y", "x0", "x1"))
    top = list(range(len(pdf)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    above = 0
    for i in range(len(pdf)):
        # the first run of the row above that may still touch this or a later one
        while (k[above], y[above], x1[above]) < (k[i], y[i] - 1, x0[i] - 1):
            above += 1
        j = above
        while j < i and k[j] == k[i] and y[j] == y[i] - 1 and x0[j] <= x1[i] + 1:
            a, b = root(j), root(i)
            top[max(a, b)] = min(a, b)
            j += 1
    pdf["root"] = pdf["node"].to_numpy()[[root(i) for i in range(len(pdf))]] if len(pdf) else pdf["node"]
    return pdf[["img", "k_", "y", "x0", "x1", "root"]]


def _united(pdf: pd.DataFrame) -> pd.DataFrame:
    """(img, node, comp) for the nodes with an edge (img, a, b): comp is the least node reachable."""
    top: dict[int, int] = {}

    def root(i: int) -> int:
        while top.setdefault(i, i) != i:
            top[i] = top.setdefault(top[i], top[i])
            i = top[i]
        return i

    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    nodes = list(top)
    return pd.DataFrame({"img": pdf["img"].iloc[0] if len(pdf) else "", "node": nodes, "comp": [root(i) for i in nodes]})


def _order(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def _contracted(edges: DataFrame) -> DataFrame:
    """(img, node, comp) for the nodes with an edge (img, a, b)."""
    left, labels = edges, None
    while not left.isEmpty():
        both = left.unionAll(left.select("img", F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut(both.groupBy("img", F.col("a").alias("node")).agg(F.min("b").alias("m")).select("img", "node", F.least("node", "m").alias("p")))
        while True:
            up = to.select("img", F.col("node").alias("p"), F.col("p").alias("pp"))
            jumped = cut(to.join(up, ["img", "p"], "left").select("img", "node", F.coalesce("pp", "p").alias("p"), (F.col("pp") < F.col("p")).alias("moved")))
            to = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = to.withColumnRenamed("p", "comp")
        else:
            labels = cut(labels.join(to.select("img", F.col("node").alias("comp"), "p"), ["img", "comp"], "left").select("img", "node", F.coalesce("p", "comp").alias("comp")))
        a, b = (to.select("img", F.col("node").alias(k), F.col("p").alias(f"r{k}")) for k in ("a", "b"))
        left = cut(left.join(a, ["img", "a"]).join(b, ["img", "b"]).where("ra <> rb").select("img", F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    return labels if labels is not None else edges.select("img", F.col("a").alias("node"), F.col("b").alias("comp"))


def split_disconnected(cells: DataFrame) -> DataFrame:
    """ITR03: regions cut into 8-connected parts. The first part of a region in scan order keeps
    its number; the others get the numbers after the greatest, in scan order."""
    parts = components(cells.where("region is not null").select("img", "y", "x", "region"), "region")
    each = parts.select("img", "region", "comp").distinct()
    each = each.withColumn("place", F.row_number().over(_order(["img", "region"], "comp")))
    top = each.groupBy("img").agg(F.max("region").alias("top"))
    extra = each.where("place > 1").withColumn("nth", F.row_number().over(_order(["img"], "comp"))).join(top, "img")
    new = each.where("place = 1").select("img", "region", "comp", F.col("region").alias("to")).unionByName(extra.select("img", "region", "comp", (F.col("top") + F.col("nth")).alias("to")))
    done = parts.join(new, ["img", "region", "comp"]).select("img", "y", "x", F.col("to").alias("region"))
    return done.unionByName(cells.where("region is null").select("img", "y", "x", "region"))


def grow(strong: DataFrame, weak: DataFrame) -> DataFrame:
    """ITR01: strong cells and the weak ones reachable from them through weak ones. Weak
    components that touch a strong cell are kept, so the number of rounds follows the
    logarithm of a component's size, not its length."""
    both = strong.select("img", "y", "x", F.lit(True).alias("strong")).unionByName(weak.select("img", "y", "x", F.lit(False).alias("strong")))
    named = components(both)
    kept = named.groupBy("img", "comp").agg(F.bool_or("strong").alias("ok")).where("ok").select("img", "comp")
    return named.join(kept, ["img", "comp"], "left_semi").select("img", "y", "x")


def features(cells: DataFrame, size, depth: str | None = None, weight: float = 0.7) -> DataFrame:
    """PRJ11: (img, y, x, f array<double> of 10): Lab, depth, their forward gradients over the
    95th percentile of both directions, and position."""
    base = cut(with_lab(cells, ("l", "a_", "b_")).select("img", "y", "x", "l", "a_", "b_", (F.coalesce(F.col(depth), F.lit(0.5)) if depth else F.lit(0.5)).alias("d")))
    out = base
    for v in ("l", "d"):
        g = cut(stencil.forward_gradients(stencil.rows_of(base, v)))
        union = g.select("img", F.col("dx").alias("v")).unionAll(g.select("img", F.col("dy").alias("v")))
        p = stats.nearest_ranks(union, ["img"], "v", {"p95": 0.95}, stats.is_large((2 * size[0], size[1])))
        p = p.select("img", F.greatest("p95", F.lit(1e-6)).alias("p95"))
        scaled = g.join(p, "img").select("img", "y", "x", *[clamp(F.col(k) / F.col("p95"), -1, 1).alias(f"{v}_{k}") for k in ("dx", "dy")])
        out = out.join(scaled, ["img", "y", "x"])
    most = float(max(size))
    position = [((F.col(k) / most) * 2 - 1) * weight for k in ("x", "y")]
    f = F.array(F.col("l") / 50 - 1, F.col("a_") / 128, F.col("b_") / 128, (F.col("d") - 0.5) * 2, "l_dx", "l_dy", "d_dx", "d_dy", *position)
    return out.select("img", "y", "x", f.alias("f"))


def gap(f: Column, g: Column) -> Column:
    return F.aggregate(F.zip_with(f, g, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def assign(feats: DataFrame, centers: DataFrame, window: int) -> DataFrame:
    """JOI06: the nearest center (img, c, cy, cx, f) whose window of +-`window` cells, or +-`w` where
    the centers have that column, at most `window`, holds the cell, lowest number on ties. The
    range join is an equi-join on tiles of the window's size: a center goes to the tiles its window
    meets, at most nine."""
    tile = lambda c: F.floor(c / window).cast("int")
    spans = [F.sequence(tile(F.col(k) - window), tile(F.col(k) + window)) for k in ("cy", "cx")]
    put = centers.withColumn("ty", F.explode(spans[0])).withColumn("tx", F.explode(spans[1])).withColumnRenamed("f", "cf")
    near = feats.withColumn("ty", tile(F.col("y"))).withColumn("tx", tile(F.col("x"))).join(put, ["img", "ty", "tx"])
    reach = F.col("w") if "w" in centers.columns else F.lit(window)
    near = near.where((F.abs(F.col("y") - F.col("cy")) <= reach) & (F.abs(F.col("x") - F.col("cx")) <= reach))
    return near.groupBy("img", "y", "x").agg(F.min(F.struct(gap(F.col("f"), F.col("cf")).alias("d"), "c"))["c"].alias("c"))


def seeds(own: DataFrame, k: int) -> DataFrame:
    """(img, c, y, x, f): k cells of each image (SMP02), those with the least hash of their key,
    numbered by key. Spark limits the ranks before the shuffle, so an image's rows don't meet."""
    least = own.withColumn("s_", uniform(F.col("key")))
    rank = F.row_number().over(Window.partitionBy("img").orderBy("s_", "key"))
    few = least.withColumn("rank_", rank).where(F.col("rank_") <= k)
    return few.select("img", (F.row_number().over(Window.partitionBy("img").orderBy("key")) - 1).alias("c"), "y", "x", "f")


def slic(cells: DataFrame, size, k: int = 32, weight: float = 0.7, depth: str | None = None, seg: str | None = None, iterations: int = 5) -> DataFrame:
    """CLU01: superpixel regions (img, y, x, region) by windowed k-means on PRJ11's features, for all
    images at once; cells that no window reaches keep the last round's region, or have none. Seeds
    are a hash-ordered sample. Centers are a written table, at most 128 rows an image; a round ends
    the loop when no image's centers moved, which changes nothing for those that stood still."""
    k, weight = min(max(k, 5), 128), min(max(weight, 0.0), 1.0)
    feats = cut(features(cells, size, depth, weight))
    own = feats
    if seg:
        fore = cut(cells.where(F.col(seg) >= 0.5).select("img", "y", "x"))
        some = feats.join(fore.select("img").distinct(), "img", "left_anti")  # images without foreground count whole
        own = feats.join(fore, ["img", "y", "x"], "left_semi").unionByName(some)
    own = own.withColumn("key", F.col("y").cast("long") * size[1] + F.col("x"))
    first = seeds(own, k)
    per = own.groupBy("img").agg(F.count(F.lit(1)).alias("cells_")).join(first.groupBy("img").agg(F.count(F.lit(1)).alias("seeds_")), "img")
    per = per.select("img", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("cells_") / F.col("seeds_")))).cast("int").alias("w"))
    centers = cut(first.select("img", "c", F.col("y").alias("cy"), F.col("x").alias("cx"), "f").join(per, "img"))
    window = centers.agg(F.max("w")).first()[0] or 1
    labels = None
    for turn in range(iterations):
        now = assign(own.drop("key"), centers, window)
        if labels is not None:
            old = labels.select("img", "y", "x", F.col("c").alias("was"))
            now = old.join(now, ["img", "y", "x"], "full").select("img", "y", "x", F.coalesce("c", "was").alias("c"))
        labels = cut(now)
        means = own.join(labels, ["img", "y", "x"]).groupBy("img", "c").agg(F.avg("y").alias("my"), F.avg("x").alias("mx"), F.array(*[F.avg(F.get("f", F.lit(j))) for j in range(10)]).alias("mf"))
        both = centers.join(means, ["img", "c"], "left")
        at = lambda mean, was, most: F.coalesce(F.least(F.lit(most - 1), F.floor(F.col(mean) + 0.5)).cast("int"), F.col(was)).alias(was)
        moved = F.coalesce(F.exists(F.zip_with("f", "mf", lambda p, q: F.abs(p - q)), lambda d: d > 1e-6), F.lit(False)).alias("moved")
        centers = cut(both.select("img", "c", at("my", "cy", size[0]), at("mx", "cx", size[1]), F.coalesce("mf", "f").alias("f"), "w", moved))
        if turn and centers.where("moved").isEmpty():
            break
        centers = centers.drop("moved")
    whole = feats.select("img", "y", "x").join(labels.select("img", "y", "x", F.col("c").cast("long").alias("region")), ["img", "y", "x"], "left")
    return split_disconnected(whole)
