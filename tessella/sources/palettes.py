"""Preset palettes as literal tables (idx, r, g, b, a). The index is semantic: ties in a search
go to the lowest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The preset palettes, in order.
PALETTES: dict[str, tuple[tuple[int, int, int], ...]] = {
    "none": (),
    "gameboy": ((15, 56, 15), (48, 98, 48), (139, 172, 15), (155, 188, 15)),
    "gameboy_color": ((15, 56, 15), (48, 98, 48), (139, 172, 15), (155, 188, 15), (139, 80, 80), (80, 100, 140), (200, 150, 100), (255, 200, 150)),
    "pico8": (
        (0, 0, 0), (29, 43, 83), (126, 37, 83), (0, 135, 81), (171, 82, 54), (95, 87, 79), (194, 195, 199), (255, 241, 232),
        (255, 0, 77), (255, 163, 0), (255, 236, 39), (0, 228, 54), (41, 173, 255), (131, 118, 156), (255, 119, 168), (255, 204, 170),
    ),
    "nes": (
        (0, 0, 0), (252, 252, 252), (188, 188, 188), (124, 124, 124), (164, 228, 252), (60, 188, 252), (0, 120, 248), (0, 0, 252),
        (184, 184, 248), (104, 136, 252), (0, 88, 248), (0, 0, 248), (216, 184, 248), (152, 120, 248), (104, 68, 252), (68, 0, 252),
        (248, 184, 248), (248, 120, 248), (216, 0, 204), (148, 0, 132), (248, 164, 192), (248, 88, 152), (228, 0, 88), (168, 0, 32),
        (240, 208, 176), (248, 120, 88), (248, 56, 0), (136, 20, 0), (252, 224, 168), (252, 160, 68), (228, 92, 16), (172, 124, 0),
        (248, 216, 120), (248, 184, 0), (184, 144, 0), (120, 120, 0), (216, 248, 120), (184, 248, 24), (0, 184, 0), (0, 128, 0),
        (184, 248, 184), (88, 216, 84), (0, 168, 0), (0, 136, 0), (184, 248, 216), (88, 248, 152), (0, 184, 104), (0, 136, 88),
        (0, 252, 252), (0, 232, 216), (0, 136, 136), (0, 104, 104), (248, 216, 248), (248, 184, 248),
    ),
    "dawnbringer32": (
        (0, 0, 0), (34, 32, 52), (69, 40, 60), (102, 57, 49), (143, 86, 59), (185, 122, 87), (215, 171, 105), (238, 219, 139),
        (250, 242, 188), (138, 111, 48), (87, 71, 47), (49, 38, 29), (49, 26, 47), (62, 39, 35), (75, 53, 34), (93, 69, 55),
        (107, 84, 55), (122, 96, 59), (130, 109, 64), (153, 133, 85), (189, 166, 115), (217, 204, 164), (251, 246, 212), (91, 120, 143),
        (63, 76, 96), (48, 52, 70), (24, 20, 37), (60, 44, 52), (119, 54, 66), (177, 72, 83), (222, 114, 102), (247, 164, 139),
    ),
    "aap64": (
        (0, 0, 0), (25, 22, 20), (40, 35, 33), (56, 50, 47), (75, 66, 62), (89, 82, 80), (115, 107, 104), (148, 140, 135),
        (181, 172, 165), (201, 192, 186), (223, 215, 208), (245, 238, 231), (63, 40, 32), (89, 57, 45), (117, 77, 60), (149, 100, 76),
        (179, 124, 97), (209, 152, 123), (232, 184, 154), (251, 219, 190), (51, 70, 30), (72, 97, 44), (94, 122, 58), (122, 148, 75),
        (149, 173, 98), (178, 198, 126), (207, 222, 159), (236, 245, 203), (31, 60, 50), (43, 85, 68), (57, 110, 86), (76, 137, 103),
        (98, 163, 122), (126, 189, 146), (160, 214, 176), (199, 236, 210), (21, 51, 67), (34, 77, 96), (52, 103, 123), (77, 131, 151),
        (108, 158, 178), (144, 187, 204), (183, 214, 228), (222, 239, 249), (41, 31, 58), (58, 44, 84), (79, 62, 112), (104, 86, 142),
        (134, 115, 171), (168, 148, 199), (204, 185, 224), (238, 224, 246), (68, 24, 44), (101, 39, 60), (139, 60, 82), (180, 89, 109),
        (214, 126, 141), (240, 173, 181), (252, 219, 221), (255, 245, 245), (90, 50, 10), (138, 82, 23), (188, 119, 39),
    ),
}


def palette(name: str) -> tuple[tuple[int, int, int], ...]:
    return PALETTES[name]


def palette_frame(spark: SparkSession, colors) -> DataFrame:
    return spark.createDataFrame([(i, *map(int, c), 255) for i, c in enumerate(colors)], "idx int, r int, g int, b int, a int")


def palette_values(name: str) -> str:
    """The palette as the rows of a SQL VALUES list (idx, r, g, b)."""
    return ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(PALETTES[name]))
