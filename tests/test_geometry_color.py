import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import color, geometry, highlight
from furrow.params import ALTERNATIVE_AREA, CENTRE_CELL, DEFAULT_PLOT, FrameParams, WinnowParams
from furrow.plans.frames import area_mask, plot_mask


def test_side_lines_are_positive_inside():
    lines = geometry.side_lines(((1, 1), (9, 2), (0, 8), (10, 9)))
    assert (lines @ [5, 5, 1] > 0).all()
    for outside in ([-3, 5, 1], [14, 5, 1], [5, -3, 1], [5, 14, 1]):
        assert (lines @ outside <= 0).sum() == 1
    assert all((lines @ [*corner, 1] == 0).sum() == 2 for corner in ((1, 1), (9, 2), (0, 8), (10, 9)))


def test_default_masks_have_the_known_sizes(spark):
    params = FrameParams()
    assert int(plot_mask(params).sum()) == 419_120
    assert int(area_mask(params).sum()) == 46_364
    assert geometry.quad_mask(spark, DEFAULT_PLOT, 720, 1280).count() == 419_120
    assert geometry.quad_mask(spark, ALTERNATIVE_AREA, 720, 1280).count() == 223_496
    area = geometry.region_mask(spark, CENTRE_CELL, DEFAULT_PLOT, 720, 1280)
    assert area.count() == 46_364


def test_centre_cell_corners():
    assert geometry.region_cells(CENTRE_CELL, DEFAULT_PLOT) == [((476, 329), (745, 329), (476, 503), (745, 503))]


def test_slanted_plot_agrees_between_rows_and_arrays(spark):
    bounds = ((3, 2), (17, 4), (1, 15), (19, 18))
    mask = geometry.mask_array(lambda x, y: geometry.inside_quad(x, y, bounds, 20, 22), 20, 22)
    rows = {(r["y"], r["x"]) for r in geometry.quad_mask(spark, bounds, 20, 22).collect()}
    assert rows == set(zip(*np.nonzero(mask))) and 100 < len(rows) < 250


def test_mask_is_clipped_to_the_frame():
    mask = geometry.mask_array(
        lambda x, y: geometry.inside_quad(x, y, ((-5, -5), (50, -5), (-5, 50), (50, 50)), 8, 8), 8, 8
    )
    assert mask.all()


def test_no_marked_region_keeps_nothing(spark):
    assert geometry.region_mask(spark, ((0,),), ((0, 0), (8, 0), (0, 8), (8, 8)), 8, 8).count() == 0


def test_union_of_masks(spark):
    one = geometry.quad_mask(spark, ((0, 0), (4, 0), (0, 4), (4, 4)), 8, 8)
    two = geometry.quad_mask(spark, ((1, 1), (5, 1), (1, 5), (5, 5)), 8, 8)
    assert geometry.union_masks(one, two).count() == 9 + 9 - 4


def test_parameter_checks():
    for bad in (
        dict(plot=((0, 0), (1, 1), (2, 2))), dict(regions=()), dict(lower=200, upper=100), dict(highlight="x"),
        dict(highlight_distance=0), dict(best_share=0.0), dict(height=0), dict(highlight_out=1.0),
    ):
        with pytest.raises(ValueError):
            FrameParams(**bad)
    for bad in (dict(centrality="pagerank"), dict(correlation="MIC"), dict(num_to_pull=0), dict(keep_thresh=2)):
        with pytest.raises(ValueError):
            WinnowParams(**bad)


def _pixels(n=400):
    rnd = random.Random(1)
    fixed = [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 255)]
    return fixed + [tuple(rnd.randrange(256) for _ in range(3)) for _ in range(n)]


def test_colour_of_rows_and_arrays_agree(spark):
    pixels = _pixels()
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pixels)], "i int, b int, g int, r int")
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    rows = df.select("i", color.gray(*rgb).alias("gray"), color.lab_b(*rgb).alias("lab"), color.luminance(*rgb).alias("l"))
    rows = rows.orderBy("i").collect()
    bgr = np.array(pixels, dtype=np.uint8)
    assert [r["gray"] for r in rows] == color.gray_array(bgr).tolist()
    assert [r["lab"] for r in rows] == color.lab_b_array(bgr).tolist()
    # Black and white are neutral, blue lies far below, yellow far above.
    assert [rows[i]["lab"] for i in range(4)] == [128, 128, 20, 222]
    assert rows[1]["gray"] == 255 and rows[1]["l"] == pytest.approx(1.0)


@pytest.mark.parametrize("shift", [-30, 0, 7, 120])
def test_highlight_of_rows_and_arrays_agree(spark, shift):
    b = np.arange(256)
    df = spark.range(256).select(F.col("id").cast("int").alias("b"))
    rows = df.select(
        "b",
        highlight.linear(F.col("b"), F.lit(shift), 155).alias("lin"),
        highlight.logistic(F.col("b"), F.lit(shift), 155, 8).alias("log"),
        highlight.in_flower_range(F.col("b"), F.lit(shift), 155, 255).alias("kept"),
    ).orderBy("b").collect()
    assert np.allclose([r["lin"] for r in rows], highlight.linear_array(b, shift, 155), atol=1e-15)
    assert np.allclose([r["log"] for r in rows], highlight.logistic_array(b, shift, 155, 8))
    assert [r["kept"] for r in rows] == [155 + shift <= v <= 255 + shift for v in range(256)]


def test_logistic_anchor_points():
    v = highlight.logistic_array(np.array([155.0, 150.0]), 0, 155, 5, 0.99)
    assert v[0] == pytest.approx(0.99) and v[1] == pytest.approx(0.5)
