import math
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions.clock import period_starts, utc_clock
from furrow.operators import periods, series


def _ts(minutes, day=5):
    return dt.datetime(2016, 7, day) + dt.timedelta(minutes=minutes)


def _frames(spark, rows):
    return spark.createDataFrame(rows, "batch string, image_id int, ts timestamp_ntz, v double, known boolean")


@pytest.mark.parametrize("block_rows", [1, 2, 1000])
def test_interpolation_of_known_series(spark, block_rows):
    values = [None, 0.0, None, None, 3.0, None]
    rows = [("a", i, _ts(i), v, v is not None) for i, v in enumerate(values)]
    numbered = series.number_frames(_frames(spark, rows), ["batch"])
    out = series.interpolate(numbered, ["batch"], F.col("v"), "e", block_rows).orderBy("image_id").collect()
    assert [r["e"] for r in out] == pytest.approx([0, 0, 1, 2, 3, 3])


def test_interpolation_without_any_known_value(spark):
    rows = [("a", i, _ts(i), None, False) for i in range(3)]
    numbered = series.number_frames(_frames(spark, rows), ["batch"])
    assert [r["e"] for r in series.interpolate(numbered, ["batch"], F.col("v"), "e").collect()] == [None] * 3


def test_estimate_equals_the_step_by_step_rule(spark):
    rnd = random.Random(4)
    known = {i: rnd.random() for i in range(150) if rnd.random() < 0.1}
    rows = [("a", i, _ts(i), known.get(i), i in known) for i in range(150)]
    # One value after the other: known, or between the previous estimate and the next known value.
    est = []
    for i in range(150):
        later = [j for j in known if j > i]
        if i in known:
            est.append(known[i])
        elif not later:
            est.append(est[-1])
        else:
            j = min(later)
            prev = est[-1] if est else known[min(known)]
            est.append((prev * (j - i) + known[j]) / (j - i + 1))
    want = [np.mean(est[max(0, i - 30) : i + 30]) for i in range(150)]
    numbered = series.number_frames(_frames(spark, rows), ["batch"])
    for block_rows in (13, 1000):
        out = series.estimate(numbered, ["batch"], F.col("v"), "e", block_rows=block_rows).orderBy("image_id").collect()
        assert [r["e"] for r in out] == pytest.approx(want)


def test_fill_timestamps_chains_minutes_and_keeps_a_leading_gap(spark):
    known = {1: _ts(10), 5: _ts(60)}
    df = spark.createDataFrame([(i, known.get(i)) for i in range(8)], "image_id int, ts timestamp_ntz")
    got = {r["image_id"]: r["ts"] for r in series.fill_timestamps(df, block_rows=3).collect()}
    assert got == {
        0: None, 1: _ts(10), 2: _ts(11), 3: _ts(12), 4: _ts(13), 5: _ts(60), 6: _ts(61), 7: _ts(62),
    }


def test_file_number(spark):
    names = [("/a/b/0012.jpg",), ("7.jpg",), ("/x/readme.txt",), ("/a/frame12.jpg",), ("2016-07-05_1207.jpg",), ("/9.d/x.jpg",)]
    paths = spark.createDataFrame(names, "p string")
    assert [r[0] for r in paths.select(series.file_number(F.col("p"))).collect()] == [12, 7, None, None, None, None]


def test_images_go_by_number(spark):
    """2, 10, 11: not the order of the names."""
    frames = spark.createDataFrame([(i, t) for i, t in [("10", None), ("2", _ts(0)), ("11", _ts(9)), ("x", None)]], "image_id string, ts timestamp_ntz")
    got = {r["image_id"]: r["ts"] for r in series.fill_timestamps(frames).collect()}
    assert got == {"2": _ts(0), "10": _ts(1), "11": _ts(9), "x": _ts(10)}
    assert series.first_frame(frames, [], ["image_id"]).first()[0] == "2"
    assert {r["image_id"] for r in series.parity_split(frames).filter("is_train").collect()} == {"2", "11"}


def test_batches_without_metric_keep_their_frames(spark):
    rows = [("a", i, float(v)) for i, v in enumerate([1, 2, 9, 10])] + [("b", i, None) for i in range(2)]
    df = spark.createDataFrame(rows, "batch string, image_id int, share double")
    got = series.cluster_frames(df, ["batch"], "share").collect()
    assert len(got) == 6 and all((r["cluster"] is None) == (r["batch"] == "b") for r in got)


def test_unsettled_fit_raises(spark):
    df = spark.createDataFrame([("a", float(i * i)) for i in range(60)], "batch string, v double")
    with pytest.raises(RuntimeError, match="settle"):
        series.fit_centroids_by(df, ["batch"], "v", 3, max_iter=1, tol=0)


def test_best_frames(spark):
    rows = [(b, i, _ts(i), float((i * 7) % 30), i % 2 == 0) for b, n in (("a", 30), ("b", 9)) for i in range(n)]
    df = _frames(spark, rows).withColumn("cluster", F.when(F.col("v") == 1, 2).otherwise(0))
    best = series.best_frames(df, ["batch"], "v", 0.10, cluster="cluster").collect()
    # floor(30 * 0.1) = 3 lowest of a (0, 1, 2), one of them in another cluster; floor(0.9) = 0 of b.
    assert sorted((r["batch"], r["v"]) for r in best) == [("a", 0.0), ("a", 2.0)]


@pytest.mark.parametrize("ranks", [10_000, 40, 3])
def test_best_frames_equal_a_full_sort(spark, monkeypatch, ranks):
    rnd = random.Random(ranks)
    rows = [("big", f"{i}", rnd.gauss(0, 1)) for i in range(4000)]
    rows += [("ties", f"{i}", float(rnd.randrange(3))) for i in range(500)]
    rows += [("odd", f"{i}", rnd.choice([None, float("nan"), -math.inf, math.inf, 0.0, -0.0, 1.5])) for i in range(300)]
    rows += [("null", f"{i}", None) for i in range(25)] + [("one", "1", 1.0), (None, "2", 2.0), (None, "3", 1.0)]
    df = spark.createDataFrame(rows, "batch string, image_id string, v double")
    monkeypatch.setattr(series, "SKETCH_RANKS", ranks)
    sorted_rows, number = [], series.number_rows
    monkeypatch.setattr(series, "number_rows", lambda d, *a: sorted_rows.append(d.groupBy("batch").count().collect()) or number(d, *a))

    def place(row):
        v = row[2]
        return (v is not None, v is not None and v != v, 0.0 if v is None or v != v else v, int(row[1]))

    for share in (0.1, 0.5, 1.0):
        want = set()
        for batch in {r[0] for r in rows}:
            group = sorted((r for r in rows if r[0] == batch), key=place)
            want |= {r[:2] for r in group[: math.floor(len(group) * share)]}
        got = [(r["batch"], r["image_id"]) for r in series.best_frames(df, ["batch"], "v", share).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    if ranks == 10_000:
        assert {r["batch"]: r["count"] for r in sorted_rows[0]}["big"] <= 5  # of 4,000
    monkeypatch.setattr(series, "number_rows", number)
    assert series.best_frames(df.drop("batch"), [], "v", 0.1).count() == math.floor(len(rows) * 0.1)
    assert series.best_frames(df.limit(0), ["batch"], "v").count() == 0


@pytest.mark.parametrize("n", [1, 4, 7, 10, 25])
def test_systematic_sample(spark, n):
    rows = [("a", i, _ts(i), 0.0, True) for i in range(10)]
    numbered = series.number_frames(_frames(spark, rows), ["batch"])
    got = sorted(r["image_id"] for r in series.systematic_sample(numbered, ["batch"], n).collect())
    want = list(range(10)) if n >= 10 else [round(i * (10 / n)) for i in range(n)]
    assert got == want


def test_labels(spark):
    df = spark.createDataFrame([(0.0,), (35.0,), (36.0,), (200.0,), (14.9,), (15.1,)], "v double")
    got = [tuple(r) for r in df.select(
        series.nearest_label(F.col("v"), [150.0, 10.0, 60.0]),
        series.two_level_label(F.col("v"), [10.0, 60.0, 150.0], [5.0, 25.0]),
    ).collect()]
    assert got == [(0, 0), (0, 1), (1, 2), (2, 3), (0, 0), (0, 1)]


def _lloyd(values, k, rounds):
    lo, hi = min(values), max(values)
    cs = [lo + (hi - lo) * ((j + 0.5) / k) for j in range(k)]
    for _ in range(rounds):
        label = [int(np.argmin([abs(v - c) for c in cs])) for v in values]
        cs = [np.mean([v for v, l in zip(values, label) if l == j]) if j in label else cs[j] for j in range(k)]
    return cs


def test_centroids_per_group(spark):
    rnd = random.Random(9)
    data = {"a": [rnd.gauss(m, 1) for m in (0, 10, 30) for _ in range(20)], "b": [5.0, 5.0, 5.0, 9.0], "c": [1.0]}
    rows = [(b, i, _ts(i), v, True) for b, vs in data.items() for i, v in enumerate(vs)]
    out = series.fit_centroids_by(_frames(spark, rows), ["batch"], "v", 3).collect()
    assert {r["batch"] for r in out} == set(data)
    for r in out:
        assert r["centroids"] == pytest.approx(_lloyd(data[r["batch"]], 3, 20))


def test_cluster_frames_orders_labels_by_value(spark):
    rows = [("a", i, _ts(i), v, True) for i, v in enumerate([0, 0, 1, 5, 6, 30, 31, 90, 91])]
    df = _frames(spark, [(b, i, t, float(v), k) for b, i, t, v, k in rows])
    got = [r["cluster"] for r in series.cluster_frames(df, ["batch"], "v").orderBy("image_id").collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2, 3, 3]


def test_spark_ml_centroids(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 50, 51, 90, 92)], "v double")
    assert series.fit_centroids(df, "v", 3) == pytest.approx([4 / 3, 50.5, 91.0])
    with pytest.raises(ValueError):
        series.fit_centroids(df, "v", 1)


def test_between_counted_and_anti_join(spark):
    rows = [("a", i, _ts(i), 0.0, i in (2, 5)) for i in range(8)] + [("b", 9, _ts(1), 0.0, False)]
    df = _frames(spark, rows)
    kept = series.between_counted(df, ["batch"], F.col("known"))
    assert sorted(r["image_id"] for r in kept.collect()) == [2, 3, 4, 5]
    assert series.drop_bad(df, df.filter("known")).count() == 7


def test_flowers_present(spark):
    df = spark.createDataFrame([(0.00005,)], "share double")
    assert series.flowers_present(df, "share", 0.0001).first()["present"] is True
    assert series.flowers_present(df, "share", 0.0001, check=True).first()["present"] is False
    assert series.flowers_present(df.limit(0), "share", 0.0001, check=True).first()["present"] is False


def test_first_frame_gives_the_size(spark):
    df = spark.createDataFrame([(3, 10, 20), (1, 7, 8)], "image_id int, height int, width int")
    assert tuple(series.first_frame(df, (), ["height", "width"]).first()) == (7, 8)


def test_period_limits():
    assert period_starts(["06:00", "12:30"]) == [0, 21600, 45000]
    for bad in ([], ["25:00"], ["12:00", "06:00"]):
        with pytest.raises(ValueError):
            period_starts(bad)


def test_periods_are_half_open_local_and_of_one_date(spark):
    # Regina is UTC-6: local day 5 July runs from 06:00 UTC to 06:00 UTC.
    rows = [
        ("a", 1, _ts(6 * 60), 1.0, True),          # 00:00 local, first frame
        ("a", 2, _ts(12 * 60 - 1), 3.0, True),     # 05:59 local
        ("a", 3, _ts(12 * 60), 10.0, True),        # 06:00 local, next period
        ("a", 4, _ts(5 * 60 + 59, day=6), 20.0, True),   # 23:59 local
        ("a", 5, _ts(6 * 60, day=6), 99.0, True),  # next local date
        ("a", 6, None, 77.0, True),
    ]
    out = periods.mean_by_period(_frames(spark, rows), ["batch"], "v", ["06:00", "12:00"], "America/Regina")
    assert {r["period"]: r["mean_share"] for r in out.collect()} == {0: 2.0, 1: 10.0, 2: 20.0}
    utc = periods.mean_by_period(_frames(spark, rows[:1]), ["batch"], "v", ["06:00", "12:00"], "UTC")
    assert {r["period"]: r["mean_share"] for r in utc.collect()} == {0: -1.0, 1: 1.0, 2: -1.0}


@pytest.mark.parametrize(
    "values,want",
    [([3, 9, 10, 15], 12.5), ([7, 7], 7.5), ([10], 12.5), ([10, 10, 10], 12.5), ([0, 5, 9, 14, 14], 7.5), ([0, 0], 2.5),
     ([1, 6, 11], 2.5), ([20, 15], 17.5)],
)
def test_modal_bin(spark, values, want):
    df = spark.createDataFrame([("a", float(v)) for v in values], "batch string, v double")
    assert periods.modal_value(df, ["batch"], "v", 5).first()["typical"] == want


def test_modal_bin_equals_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {f"g{i}": rng.integers(0, 60, rng.integers(1, 40)) for i in range(25)}
    df = spark.createDataFrame([(g, int(v)) for g, vs in groups.items() for v in vs], "batch string, v int")
    bins = {}
    for r in periods.count_histogram(df, ["batch"], "v", 4).collect():
        bins.setdefault(r["batch"], {})[r["bin_left"]] = r["n"]
    typical = {r["batch"]: r["typical"] for r in periods.modal_value(df, ["batch"], "v", 4).collect()}
    for g, vs in groups.items():
        hi, lo = int(np.ceil(vs.max() / 4) * 4), int(vs.min() / 4) * 4
        n_bins = max(1, (hi - lo) // 4)
        if hi == lo:
            assert bins[g] == {float(lo): len(vs)}
            continue
        counts, edges = np.histogram(vs, n_bins, [lo, hi])
        assert bins[g] == {float(e): int(c) for e, c in zip(edges, counts) if c}
        assert typical[g] == edges[counts.argmax()] + 2


def test_modal_by_period_marks_empty_periods(spark):
    rows = [("a", 1, _ts(10), 4.0, True), ("a", 2, _ts(700), 9.0, False)]
    out = periods.modal_by_period(
        _frames(spark, rows), ["batch"], "v", ["06:00"], "UTC", counted=F.col("known")
    )
    assert {r["period"]: r["typical"] for r in out.collect()} == {0: 2.5, 1: -1.0}
    day = periods.modal_by_period(_frames(spark, rows), ["batch"], "v", None)
    assert day.first()["typical"] == 2.5


def test_utc_clock_of_instants(spark):
    df = spark.sql("SELECT timestamp'2016-07-05 03:00:00.123456-06:00' AS ts")
    assert utc_clock(df).first()["ts"] == dt.datetime(2016, 7, 5, 9, 0, 0, 123456)
    assert utc_clock(utc_clock(df)).schema["ts"].dataType.simpleString() == "timestamp_ntz"


def test_parity_and_cluster_filters(spark):
    df = spark.createDataFrame([(k,) for k in (9, 4, 7, 1)], "image_id int")
    got = {r["image_id"]: r["is_train"] for r in series.parity_split(df).collect()}
    assert got == {1: True, 4: False, 7: True, 9: False}
    flat = series.reset_clusters(df)
    assert series.in_clusters(flat, 0).count() == 4 and series.in_clusters(flat, (1, 2)).count() == 0
    assert series.known_images(df, df.limit(2)).count() == 2
