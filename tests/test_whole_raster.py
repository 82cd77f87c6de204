"""Queries that read every row of the raster, on tables taller than any bound they had."""

import numpy as np
import pytest

from tessella.operators import edges
from tessella.operators.edges import EdgeConfig
from tessella.plans import catalogue
from tessella.sources.palettes import PALETTES
from tessella.sources.tables import rgba_cells

ROWS = 90


@pytest.fixture(scope="module")
def tall(spark, tmp_path_factory):
    """A folder with an embeddings table of ROWS rows."""
    d = tmp_path_factory.mktemp("tall")
    v = np.random.default_rng(3).uniform(-0.7, 0.7, (ROWS, 64)).round(3)
    rows = [(i, [float(x) for x in v[i]], i % 10) for i in range(ROWS)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


def test_paint_edges_paints_every_row(spark, tall):
    px = rgba_cells(spark, tall)
    image = edges.to_array(px.toPandas(), (ROWS, 16))
    mask = np.zeros((ROWS, 16), bool)
    for r in edges.sobel_mask(px, 0.6).collect():
        mask[r["y"], r["x"]] = True
    assert mask[64:].any()
    edges.paint_array(image, mask, EdgeConfig(style="contrast", thickness=2, anti_alias=True), PALETTES["pico8"])
    edges.anti_alias_array(image, mask)
    got = catalogue.queries()["paint_edges"](spark, tall).toPandas()
    assert len(got) == ROWS * 16
    assert (edges.to_array(got, (ROWS, 16)) == image).all()
