import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from furrow.operators import histogram, peaks


def _hump(shift=0):
    h = np.zeros(256, dtype=int)
    h[120:130] = [1, 3, 9, 20, 40, 41, 18, 8, 2, 1]
    return np.roll(h, shift).tolist()


def _packed(spark, hists):
    rows = [(b, i, h) for b, i, h in hists]
    return spark.createDataFrame(rows, "batch string, image_id int, hist array<bigint>")


@pytest.mark.parametrize("by", [[], ["batch"]])
def test_shift_of_rolled_histograms(spark, by):
    moves = [0, -100, -3, 5, 100]
    packed = _packed(spark, [("x", i, _hump(s)) for i, s in enumerate(moves)])
    refs = packed.filter("image_id = 0").select(*by, F.col("hist").alias("ref"), F.lit(0).alias("base"))
    got = {r["image_id"]: r["shift"] for r in histogram.with_shift(packed, refs, by).collect()}
    assert got == dict(enumerate(moves))


def test_shift_ties_take_the_smallest_lag(spark):
    flat, spike = [0] * 256, [0] * 256
    flat[10] = flat[20] = flat[30] = 5
    spike[20] = 1
    packed = _packed(spark, [("x", 1, flat)])
    refs = _packed(spark, [("x", 0, spike)]).select(F.col("hist").alias("ref"), F.lit(0).alias("base"))
    assert histogram.with_shift(packed, refs).first()["shift"] == -10


def test_shift_to_first_adds_the_overall_shift(spark):
    moves = [2, 2, 2, 2, 6]
    packed = _packed(spark, [("x", i, _hump(s)) for i, s in enumerate(moves[::-1])])
    rows = histogram.with_shift_to_first(packed, ["batch"]).collect()
    mean = np.mean([_hump(s) for s in moves], axis=0)
    first = np.array(_hump(6))
    lag = np.correlate(first, mean, "full").argmax() - 255
    want = {i: s - 6 + lag for i, s in enumerate(moves[::-1])}
    assert {r["image_id"]: r["shift"] for r in rows} == want


def test_mean_reference_per_group(spark):
    packed = _packed(spark, [("x", 0, _hump()), ("x", 1, _hump(4)), ("y", 2, _hump(9))])
    refs = {r["batch"]: r["ref"] for r in histogram.mean_references(packed, ["batch"]).collect()}
    assert refs["x"] == (np.array(_hump()) + np.array(_hump(4))).tolist() and refs["y"] == _hump(9)


def test_aligned_mean_undoes_the_shift(spark):
    packed = _packed(spark, [("x", i, _hump(s)) for i, s in enumerate((0, 7, -9))])
    moved = packed.withColumn("shift", F.element_at(F.array(F.lit(0), F.lit(7), F.lit(-9)), F.col("image_id") + 1))
    got = {r["bin"]: r["mean_n"] for r in histogram.aligned_mean(moved).collect()}
    assert [got[b] for b in range(256)] == pytest.approx(_hump())


def test_pack_and_unpack(spark):
    rows = spark.createDataFrame([(1, 3), (1, 3), (1, 255), (2, 0)], "image_id int, bin int")
    packed = histogram.pack(histogram.count_bins(rows, ["image_id"]), ["image_id"])
    back = histogram.unpack(packed).filter("n > 0").collect()
    assert {(r["image_id"], r["bin"], r["n"]) for r in back} == {(1, 3, 2), (1, 255, 1), (2, 0, 1)}
    assert histogram.unpack(packed).count() == 512


@pytest.mark.parametrize("shift,want", [(0, 101), (200, 0), (-300, 0), (-100, 101), (100, 1), (-200, 56), (55, 46)])
def test_range_share_is_clamped(spark, shift, want):
    packed = _packed(spark, [("x", 0, [1] * 256)])
    share = histogram.range_share(F.col("hist"), F.lit(shift), 155, 255, F.lit(256))
    assert packed.select(share.alias("s")).first()["s"] == pytest.approx(want / 256)


def test_bad_frame_threshold(spark):
    packed = _packed(spark, [("x", 0, [20] + [0] * 255), ("x", 1, [19] + [0] * 255)])
    bad = packed.filter(histogram.is_bad_frame(F.col("hist"), F.lit(100))).select("image_id").collect()
    assert [r["image_id"] for r in bad] == [0]


def _brute_peaks(v, threshold):
    found = []
    for y in range(v.shape[0]):
        for x in range(v.shape[1]):
            if v[y, x] <= threshold:
                continue
            near = [
                (v[j, i], -j, -i)
                for j in range(max(0, y - 1), min(v.shape[0], y + 2))
                for i in range(max(0, x - 1), min(v.shape[1], x + 2))
            ]
            if max(near) == (v[y, x], -y, -x):
                found.append((y, x))
    return found


def test_peaks_of_rows_and_arrays_agree_with_brute_force(spark):
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 5, (9, 7)) / 4.0 for _ in range(12)] + [np.ones((4, 4)), np.zeros((3, 3))]
    rows = [(k, y, x, float(v[y, x])) for k, v in enumerate(images) for y in range(v.shape[0]) for x in range(v.shape[1])]
    pixels = spark.createDataFrame(rows, "image_id int, y int, x int, v double")
    found = peaks.local_peaks(pixels, threshold=0.2)
    got = {}
    for r in found.collect():
        got.setdefault(r["image_id"], []).append((r["y"], r["x"]))
    counts = {r["image_id"]: r["n_spots"] for r in peaks.count_per_image(found, peaks.spot_images(pixels)).collect()}
    for k, v in enumerate(images):
        want = _brute_peaks(v, 0.2)
        assert sorted(got.get(k, [])) == want
        assert peaks.peak_count_array(v, 0.2) == counts[k] == len(want)
    assert counts[13] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=5, max_size=5), min_size=1, max_size=6))
def test_array_peaks_property(rows):
    v = np.array(rows, dtype=float)
    assert peaks.peak_count_array(v, 0.0) == len(_brute_peaks(v, 0.0))


@settings(max_examples=60, deadline=None)
@given(st.integers(-110, 110))
def test_lag_of_a_rolled_hump_is_its_roll(shift):
    import pandas as pd

    lag = histogram._peak_lag(pd.Series([np.array(_hump(shift))]), pd.Series([np.array(_hump())]))
    assert lag.tolist() == [shift]


def test_bins_outside_count_in_the_nearest(spark):
    rows = spark.createDataFrame([(1, -4, 2), (1, 0, 1), (1, 255, 3), (1, 300, 6), (2, 7, 5)], "image_id int, bin int, n long")
    packed = {r["image_id"]: r["hist"] for r in histogram.pack(rows, ["image_id"]).collect()}
    assert packed[1][0] == 3 and packed[1][255] == 9 and sum(packed[1]) == 12 and sum(packed[2]) == 5
    means = {r["bin"]: r["mean_n"] for r in histogram.mean_of_bins(rows, ["image_id"]).collect()}
    assert len(means) == 256 and means[0] == 1.5 and means[255] == 4.5 and means[7] == 2.5 and means[9] == 0


def test_ties_stay_exact_in_large_references():
    """2**53 and 2**53 + 1 differ, though not as floating-point numbers."""
    import numpy as np
    import pandas as pd

    image = [0] * 256
    image[10] = 1
    ref = [0] * 256
    ref[10], ref[7] = 2**53, 2**53 + 1
    assert histogram._peak_lag(pd.Series([np.array(image)]), pd.Series([np.array(ref)])).tolist() == [3]
    ref[7] = 2**53
    assert histogram._peak_lag(pd.Series([np.array(image)]), pd.Series([np.array(ref)])).tolist() == [0]
    image = [400_000] * 256
    ref = [3 * 10**12] * 256
    assert histogram._peak_lag(pd.Series([np.array(image)]), pd.Series([np.array(ref)])).tolist() == [0]


def test_first_reference_goes_by_number(spark):
    rows = [(name, [int(b == at) for b in range(256)]) for name, at in (("10", 50), ("2", 20), ("11", 90))]
    packed = spark.createDataFrame(rows, "image_id string, hist array<long>")
    assert histogram.first_references(packed).first()["ref"][20] == 1


def test_lags_of_a_long_batch_take_bounded_arrays(monkeypatch):
    """A batch is correlated in parts, with the lags of one piece."""
    rng = np.random.default_rng(5)
    hists = pd.Series(list(rng.integers(0, 50, (25, 256))))
    refs = pd.Series([hists[0], hists[1]] * 12 + [hists[0]])
    whole = histogram._peak_lag(hists, refs)
    seen, largest = [], histogram._largest
    monkeypatch.setattr(histogram, "LAG_IMAGES", 4, raising=False)
    monkeypatch.setattr(histogram, "_largest", lambda limbs: seen.append(len(limbs[0])) or largest(limbs))
    assert histogram._peak_lag(hists, refs).tolist() == whole.tolist()
    assert max(seen) <= 4 and sum(seen) == 25
    assert not len(histogram._peak_lag(hists[:0], refs[:0]))
