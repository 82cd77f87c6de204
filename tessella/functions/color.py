"""Colour functions over columns: sRGB, CIE Lab (D65), HSL, colormaps. All are plain column
expressions, so they stay in generated code."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sRGB primaries and D65 white, and the CIE constants.
WHITE = (0.95047, 1.0, 1.08883)
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
EPSILON, KAPPA = 216 / 24389, 24389 / 27
#: The inverse of TO_XYZ, so that a colour survives the way there and back.
FROM_XYZ = tuple(tuple(float(v) for v in row) for row in np.linalg.inv(np.array(TO_XYZ)))

# The colormap's polynomial, lowest power first, for r, g and b.
TURBO = (
    (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
)
# Colours of region labels, by label modulo 16, and that of the background.
REGION_COLORS = (
    (230, 25, 75), (60, 180, 75), (255, 225, 25), (0, 130, 200), (245, 130, 48), (145, 30, 180), (70, 240, 240), (240, 50, 230),
    (210, 245, 60), (250, 190, 190), (0, 128, 128), (230, 190, 255), (170, 110, 40), (255, 250, 200), (128, 128, 128), (0, 0, 0),
)
BACKGROUND_GRAY = 30


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def to_byte(c: Column) -> Column:
    """Truncated to 0..255. A value within 5e-7 below an integer counts as that integer, so that
    the last bits of a power or a root don't decide."""
    return F.floor(clamp(c, 0, 255) + 5e-7).cast("int")


def linear(v: Column) -> Column:
    """sRGB 0..255 to linear light 0..1."""
    s = v / 255.0
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """PRJ01."""
    light = [linear(c.cast("double")) for c in (r, g, b)]
    f = []
    for row, white in zip(TO_XYZ, WHITE, strict=True):
        t = (light[0] * row[0] + light[1] * row[1] + light[2] * row[2]) / white
        f.append(F.when(t > EPSILON, F.cbrt(t)).otherwise((t * KAPPA + 16) / 116))
    return f[1] * 116 - 16, (f[0] - f[1]) * 500, (f[1] - f[2]) * 200


def lab_to_rgb(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    """PRJ02: clamped and truncated to 0..255."""
    fy = (l + 16) / 116
    xyz = []
    for f, white in ((fy + a / 500, WHITE[0]), (fy, WHITE[1]), (fy - b / 200, WHITE[2])):
        xyz.append(F.when(f * f * f > EPSILON, f * f * f).otherwise((f * 116 - 16) / KAPPA) * white)
    out = []
    for row in FROM_XYZ:
        c = xyz[0] * row[0] + xyz[1] * row[1] + xyz[2] * row[2]
        s = F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)
        out.append(to_byte(s * 255))
    return out[0], out[1], out[2]


def with_lab(df: DataFrame, out: tuple[str, str, str] = ("l_", "a_", "b_"), rgb: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """PRJ01 as a chain of projections, each value computed once: as one expression the formula
    repeats itself and outgrows the generated code."""
    df = df.withColumns({f"c{k}_": linear(F.col(c).cast("double")) for k, c in enumerate(rgb)})
    df = df.withColumns({f"t{k}_": (F.col("c0_") * row[0] + F.col("c1_") * row[1] + F.col("c2_") * row[2]) / white for k, (row, white) in enumerate(zip(TO_XYZ, WHITE, strict=True))})
    df = df.withColumns({f"f{k}_": F.when(F.col(f"t{k}_") > EPSILON, F.cbrt(f"t{k}_")).otherwise((F.col(f"t{k}_") * KAPPA + 16) / 116) for k in range(3)})
    df = df.withColumns(dict(zip(out, (F.col("f1_") * 116 - 16, (F.col("f0_") - F.col("f1_")) * 500, (F.col("f1_") - F.col("f2_")) * 200), strict=True)))
    return df.drop(*[f"{c}{k}_" for c in "ctf" for k in range(3)])


def with_rgb(df: DataFrame, out: tuple[str, str, str] = ("r", "g", "b"), lab: tuple[str, str, str] = ("l_", "a_", "b_")) -> DataFrame:
    """PRJ02 as a chain of projections."""
    df = df.withColumn("f1_", (F.col(lab[0]) + 16) / 116)
    df = df.withColumns({"f0_": F.col("f1_") + F.col(lab[1]) / 500, "f2_": F.col("f1_") - F.col(lab[2]) / 200})
    df = df.withColumns({f"q{k}_": F.col(f"f{k}_") * F.col(f"f{k}_") * F.col(f"f{k}_") for k in range(3)})
    df = df.withColumns({f"t{k}_": F.when(F.col(f"q{k}_") > EPSILON, F.col(f"q{k}_")).otherwise((F.col(f"f{k}_") * 116 - 16) / KAPPA) * WHITE[k] for k in range(3)})
    df = df.withColumns({f"c{k}_": F.col("t0_") * row[0] + F.col("t1_") * row[1] + F.col("t2_") * row[2] for k, row in enumerate(FROM_XYZ)})
    light = {f"s{k}_": F.when(F.col(f"c{k}_") <= 0.0031308, F.col(f"c{k}_") * 12.92).otherwise(F.pow(F.greatest(F.col(f"c{k}_"), F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055) for k in range(3)}
    df = df.withColumns(light).withColumns({name: to_byte(F.col(f"s{k}_") * 255) for k, name in enumerate(out)})
    return df.drop(*[f"{c}{k}_" for c in "fqtcs" for k in range(3)])


def delta_squared(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """PRJ03, without the root: comparisons don't need it."""
    return sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))


def delta_e(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.sqrt(delta_squared(a, b))


def chroma_weight(a: Column, b: Column) -> Column:
    """PRJ04."""
    return F.lit(1.0) + F.sqrt(a * a + b * b)


def luma(r: Column, g: Column, b: Column) -> Column:
    """PRJ05: Rec. 709 weights in ten-thousandths, truncated to an integer."""
    return F.floor((r.cast("long") * 2126 + g.cast("long") * 7152 + b.cast("long") * 722) / 10000).cast("int")


def foreground_lightness(l: Column, s: Column, strength: float, gamma: float, scale: float) -> Column:  # noqa: E741
    """PRJ06: L shifted by the signed power of the shading."""
    if strength < 0.001:
        return l
    bent = F.signum(s) * F.pow(F.abs(s), F.lit(float(gamma)))
    return F.when(F.abs(s) < 0.001, l).otherwise(clamp(l + bent * (strength * scale), 0, 100))


def background_lab(l: Column, a: Column, b: Column, desaturation: float, shift: float) -> tuple[Column, Column, Column]:  # noqa: E741
    """PRJ07."""
    return clamp(l + shift * 100, 0, 100), a * (1 - desaturation), b * (1 - desaturation)


def shift_lab(l: Column, a: Column, b: Column, dl: float, hue: float) -> tuple[Column, Column, Column]:  # noqa: E741
    """PRJ09: lightness moved, hue turned by degrees."""
    new_l = clamp(l + dl, 0, 100)
    if abs(hue) < 0.001:
        return new_l, a, b
    chroma, turned = F.sqrt(a * a + b * b), F.atan2(b, a) + math.radians(hue)
    return new_l, chroma * F.cos(turned), chroma * F.sin(turned)


def blend(a: Column, b: Column, t: float) -> Column:
    """PRJ10: one channel, rounded."""
    return clamp(F.round(a * (1 - t) + b * t), 0, 255).cast("int")


def rgb_to_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """PRJ13: hue in degrees, saturation and lightness 0..1."""
    x, y, z = (c / 255.0 for c in (r, g, b))
    high, low = F.greatest(x, y, z), F.least(x, y, z)
    d, light = high - low, (high + low) / 2
    sat = F.when(d == 0, 0.0).otherwise(d / F.when(light > 0.5, 2.0 - high - low).otherwise(high + low))
    turn = F.when(high == x, (y - z) / d + F.when(y < z, 6.0).otherwise(0.0)).when(high == y, (z - x) / d + 2.0).otherwise((x - y) / d + 4.0)
    return F.when(d == 0, 0.0).otherwise(turn * 60.0), sat, light


def turbo(t: Column) -> tuple[Column, Column, Column]:
    """SNK05: the colormap as bytes."""
    v, out = clamp(t, 0, 1), []
    for poly in TURBO:
        acc = F.lit(poly[-1])
        for c in reversed(poly[:-1]):
            acc = acc * v + c
        out.append(to_byte(acc * 255))
    return out[0], out[1], out[2]


def gray(t: Column) -> Column:
    return to_byte(clamp(t, 0, 1) * 255)


def region_color(region: Column) -> tuple[Column, Column, Column]:
    """The colour of a label; null is background."""
    at = (F.pmod(region, F.lit(len(REGION_COLORS))) + 1).cast("int")
    pick = lambda k: F.when(region.isNull(), BACKGROUND_GRAY).otherwise(F.element_at(F.array(*[F.lit(c[k]) for c in REGION_COLORS]), at)).cast("int")
    return pick(0), pick(1), pick(2)


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("int")), 2, "0") for c in (r, g, b)])
