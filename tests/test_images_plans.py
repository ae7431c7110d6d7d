import datetime as dt
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import color, geometry, highlight
from furrow.operators import histogram, peaks
from furrow.params import FrameParams
from furrow.plans import frames as plans
from furrow.sources import images as src

PARAMS = FrameParams(
    height=12, width=16, plot=((1, 1), (14, 1), (1, 10), (14, 10)), regions=((1, 0), (0, 1)), lower=120, upper=200
)


def _png(bgr):
    """Bytes of an 8-bit colour PNG."""
    height, width, _ = bgr.shape
    raw = b"".join(b"\0" + bgr[y, :, ::-1].tobytes() for y in range(height))

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", header) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def _picture(i):
    rng = np.random.default_rng(i)
    base = rng.integers(60, 200, (12, 16, 3))
    return np.clip(base + [i % 5 * 6, 0, 0], 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("plots")
    for day in ("day1", "day2"):
        (root / day).mkdir()
        for i in range(30):
            (root / day / f"{i}.png").write_bytes(_png(_picture(i + (100 if day == "day2" else 0))))
    (root / "day1" / "40.png").write_bytes(b"not an image")
    (root / "day1" / "41.png").write_bytes(_png(_picture(1)[:8, :8]))
    # Nearly uniform: one gray level fills the frame.
    (root / "day1" / "42.png").write_bytes(_png(np.full((12, 16, 3), 90, dtype=np.uint8)))
    (root / "day1" / "notes.txt").write_text("skip me")
    return str(root)


def test_scan_and_rejects(spark, folder):
    scan = src.scan_images(spark, folder, "*.png")
    assert scan.count() == 63
    assert [r["image_id"] for r in src.rejected_images(scan).collect()] == ["40.png"]
    assert src.good_images(scan).count() == 62
    with pytest.raises(Exception, match="cannot decode"):
        src.require_all_good(scan).collect()
    assert len(src.require_all_good(src.scan_images(spark, f"{folder}/day2", "*.png")).collect()) == 30
    row = scan.filter("image_id = '7.png' AND batch = 'day1'").first()
    assert row["number"] == 7 and bytes(row["image"]["data"]) == _picture(7).tobytes()


def test_listing(spark, folder):
    names = src.list_files(spark, f"{folder}/day1", "*.png")
    assert names.count() == 33 and src.list_files(spark, f"{folder}/day1", "*").count() == 34
    assert sorted(r["batch"] for r in src.list_folders(spark, folder).collect()) == ["day1", "day2"]
    assert src.scan_images(spark, [f"{folder}/day1", f"{folder}/day2"], "*.png").count() == 63
    assert src.scan_raw(spark, folder, "*.txt").first()["length"] == 7


def test_frame_path_equals_pixel_path(spark, folder):
    scan = src.scan_images(spark, f"{folder}/day2", "*.png")
    features = plans.frame_features(scan, PARAMS)
    assert features.filter("ok").count() == 30
    pixels = src.pixel_rows(scan).withColumn("lab", color.lab_b(F.col("r"), F.col("g"), F.col("b")))
    pixels = pixels.withColumn("gray", color.gray(F.col("r"), F.col("g"), F.col("b")))
    x, y = F.col("x"), F.col("y")
    plot = pixels.filter(geometry.inside_quad(x, y, PARAMS.plot, 12, 16)).cache()
    for channel, column in (("lab", "hist"), ("gray", "hist_gray")):
        rows = histogram.pack(histogram.count_bins(plot, ["image_id"], channel), ["image_id"])
        want = {r["image_id"]: r["hist"] for r in rows.collect()}
        got = {r["image_id"]: r[column] for r in features.select("image_id", column).collect()}
        assert got == want and sum(got["3.png"]) == int(plans.plot_mask(PARAMS).sum())
    analysed = plans.analyze(features, PARAMS).cache()
    shifts = analysed.select("image_id", "shift")
    area = pixels.filter(geometry.inside_regions(x, y, PARAMS.regions, PARAMS.plot, 12, 16)).join(shifts, "image_id")
    lit = area.withColumn("v", highlight.linear(F.col("lab"), F.col("shift"), PARAMS.lower))
    rows = peaks.count_per_image(peaks.local_peaks(lit), peaks.spot_images(pixels)).collect()
    assert {r["image_id"]: r["n_spots"] for r in rows} == {r["image_id"]: r["n_spots"] for r in analysed.collect()}
    by_mean = plans.analyze(features, PARAMS, reference="mean").collect()
    assert len(by_mean) == 30 and all(0 <= r["share"] <= 1 for r in by_mean)


def test_rejects_of_features(spark, folder):
    features = plans.frame_features(src.scan_images(spark, folder, "*.png"), PARAMS)
    assert sorted(r["image_id"] for r in plans.rejects(features).collect()) == ["40.png", "41.png"]


@pytest.fixture(scope="module")
def batch(spark, folder, tmp_path_factory):
    cache = str(tmp_path_factory.mktemp("cache"))
    return cache, plans.run_batch(spark, folder, PARAMS, cache, "*.png")


def test_run_batch(spark, folder, batch):
    cache, out = batch
    frames = out["frames"].toPandas()
    assert [r["image_id"] for r in out["bad"].collect()] == ["42.png"]
    assert out["rejects"].count() == 2
    assert len(frames) == 60 and "42.png" not in set(frames["image_id"])
    assert set(frames["cluster"]) <= {0, 1, 2, 3}
    # day1 counts its bad frame too: floor(31 * 0.1) = 3 candidates, floor(30 * 0.1) = 3.
    best = frames[frames["is_best"]]
    assert 1 <= len(best) <= 6 and set(best["cluster"]) == {0} and best["n_spots"].notna().all()
    assert frames[~frames["is_best"]]["n_spots"].isna().all()
    lowest = frames.sort_values(["batch", "share", "image_id"]).groupby("batch").head(3)
    assert set(best["image_id"]) <= set(lowest["image_id"]) | {"42.png"}


def test_areas_of_best_frames_only_are_counted_where_they_are_read(spark, folder, batch, monkeypatch):
    scan = plans.frame_features(src.scan_images(spark, folder, "*.png"), PARAMS).filter("ok")
    usable = plans.cut(scan)
    means = plans.cut(histogram.mean_references(usable, ["batch"]))
    best = batch[1]["frames"].filter("is_best").select("batch", "image_id", "n_spots")
    asked, parted = [], plans.parted
    monkeypatch.setattr(plans, "parted", lambda *a: asked.append(parted(*a)) or asked[-1])
    area = plans.frame_masks(PARAMS)[1]
    found = plans.count_spots(usable, means, best.select("batch", "image_id"), PARAMS, area, ["batch"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, best.collect()))
    assert asked[0][0].count() == best.count()
    # Between the scan of the areas and their count, the plan moves nothing.
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "area" in line)
    depth, above = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for line in reversed(lines[:at]):
        indent = len(line) - len(line.lstrip(" :+-"))
        if indent < depth:
            depth = indent
            above.append(line)
    counted = next(i for i, line in enumerate(above) if "ArrowEvalPython" in line and "count(area" in line)
    assert not any("Exchange" in line for line in above[:counted])


def test_run_batch_reuses_stored_tables(spark, folder, batch, monkeypatch):
    cache, out = batch
    want = sorted(map(str, out["frames"].collect()))
    monkeypatch.setattr(plans, "frame_features", lambda *a: pytest.fail("decoded again"))
    again = plans.run_batch(spark, folder, PARAMS, cache, "*.png")
    assert sorted(map(str, again["frames"].collect())) == want


def test_report(spark, batch):
    start = dt.datetime(2016, 7, 5, 6)
    frames = batch[1]["frames"].withColumn(
        "ts", F.timestamp_add("MINUTE", F.col("number") * 30, F.lit(start).cast("timestamp_ntz"))
    )
    out = plans.report(frames, ["06:00", "12:00"], "America/Regina").collect()
    assert {(r["batch"], r["period"]) for r in out} == {(d, p) for d in ("day1", "day2") for p in range(3)}
    share = {(r["batch"], r["period"]): r["mean_share"] for r in out}
    assert all(v >= 0 for k, v in share.items() if k[1] < 2)
    assert all(v >= 0 for k, v in share.items() if k[1] == 2)
    skipped = plans.report(frames, None, skip_share=True, skip_count=True).collect()
    assert {(r["mean_share"], r["typical_count"]) for r in skipped} == {(-1.0, -1.0)} and len(skipped) == 2


def test_absent_flowers_count_zero(spark, folder):
    params = FrameParams(
        height=12, width=16, plot=PARAMS.plot, regions=PARAMS.regions, lower=120, upper=200,
        check_present=True, present_threshold=1.0,
    )
    frames = plans.run_batch(spark, folder, params, None, "*.png")["frames"].toPandas()
    assert set(frames[frames["is_best"]]["n_spots"]) == {0}


def test_given_masks(spark, folder):
    scan = src.scan_images(spark, f"{folder}/day2", "*.png")
    own = plans.frame_masks(PARAMS)
    by_mask = plans.analyze(plans.frame_features(scan, PARAMS, own), PARAMS, masks=own).orderBy("image_id").collect()
    assert by_mask == plans.analyze(plans.frame_features(scan, PARAMS), PARAMS).orderBy("image_id").collect()
    full = np.full((12, 16), 255)
    features = plans.frame_features(scan, PARAMS, (full, full))
    assert features.select(F.aggregate("hist", F.lit(0).cast("long"), lambda a, n: a + n)).first()[0] == 12 * 16
    with pytest.raises(ValueError):
        plans.frame_features(scan, PARAMS, (full, full[:5]))
    with pytest.raises(ValueError):
        plans.analyze(features, PARAMS, reference="last")


def test_logistic_mode(spark, folder):
    params = FrameParams(
        height=12, width=16, plot=PARAMS.plot, regions=PARAMS.regions, lower=120, upper=200,
        highlight="logistic", min_peak=0.5,
    )
    features = plans.frame_features(src.scan_images(spark, f"{folder}/day2", "*.png"), params)
    assert plans.analyze(features, params).filter("n_spots > 0").count() > 0


def test_new_files_are_seen_and_masks_and_times_used(spark, folder, tmp_path):
    import shutil

    shutil.copytree(folder, tmp_path / "plots")
    path, store = str(tmp_path / "plots"), str(tmp_path / "store")
    first = plans.run_batch(spark, path, PARAMS, store, "*.png")
    n = first["frames"].count() + first["bad"].count() + first["rejects"].count()
    held = next((tmp_path / "plots" / "day2").glob("*.png"))
    shutil.copy(held, held.with_name("977.png"))
    again = plans.run_batch(spark, path, PARAMS, store, "*.png")
    assert again["frames"].count() + again["bad"].count() + again["rejects"].count() == n + 1
    masks = plans.frame_masks(PARAMS)
    drawn = plans.run_batch(spark, path, PARAMS, None, "*.png", masks=masks)["frames"]
    assert drawn.count() == again["frames"].count()
    name = drawn.select("image_id").first()[0]
    times = spark.createDataFrame([(name, __import__("datetime").datetime(2016, 7, 5, 12))], "image_id string, ts timestamp_ntz")
    timed = plans.run_batch(spark, path, PARAMS, None, "*.png", timestamps=times)["frames"]
    assert timed.count() == drawn.count() and timed.filter("ts is not null").count() >= 1


def _decoded(monkeypatch):
    """Names of the files of every scan that is decoded."""
    calls, scan = [], plans.scan_images
    monkeypatch.setattr(plans, "scan_images", lambda spark, paths, glob: calls.append(paths) or scan(spark, paths, glob))
    return calls


def test_one_new_file_is_one_decode(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "plots" / "day 1", str(tmp_path / "store")
    root.mkdir(parents=True)
    for i in range(6):
        (root / f"{i}.png").write_bytes(_png(_picture(i)))
    path, calls = str(tmp_path / "plots"), _decoded(monkeypatch)

    def features():
        generations = plans.generations
        return generations.load_or_extend(
            spark, store, "s", src.file_versions(spark, path, "*.png"),
            lambda new: plans.frame_features(plans.scan_images(spark, [src.exactly(p) for p in new] or path, "*.png"), PARAMS),
        )

    def plain():
        return sorted(map(str, plans.frame_features(src.scan_images(spark, path, "*.png"), PARAMS).collect()))

    def same():
        return sorted(map(str, features().collect())) == plain()

    assert same() and len(calls) == 1 and len(calls[0]) == 6
    assert same() and len(calls) == 1
    (root / "odd [a]{b},+%20.png").write_bytes(_png(_picture(9)))
    assert same() and len(calls) == 2 and len(calls[1]) == 1  # one file added: one file decoded
    (root / "3.png").write_bytes(_png(_picture(77)) + b"tail")  # changed
    assert same() and len(calls) == 3 and len(calls[2]) == 1 and "3.png" in calls[2][0]
    (root / "2.png").rename(tmp_path / "2.png")  # gone
    assert same() and len(calls) == 3
    (tmp_path / "2.png").rename(root / "2.png")  # back as it was: its stored rows hold again
    assert same() and len(calls) == 3
    monkeypatch.setattr(plans.generations, "MANY", 2)
    assert same() and len(calls) == 3
    monkeypatch.setattr(plans.generations, "MANY", 64)
    monkeypatch.setattr(plans.generations, "FILES", 2)
    for i in range(20, 25):
        (root / f"{i}.png").write_bytes(_png(_picture(i)))
    assert same() and sum(map(len, calls[3:])) == 5 and len(calls) > 4


def test_a_generation_counts_once_it_is_published(spark, tmp_path, monkeypatch):
    root, store = tmp_path / "plots", str(tmp_path / "store")
    root.mkdir()
    (root / "1.png").write_bytes(_png(_picture(1)))
    listed = src.file_versions(spark, str(root), "*.png")
    rows = plans.frame_features(src.scan_images(spark, str(root), "*.png"), PARAMS)

    def lost(*_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        plans.generations.load_or_extend(spark, store, "s", listed, lost)
    base = plans.generations._folder(store, "s")
    rows.withColumn("generation", F.lit("half")).write.parquet(f"{base}/half/rows")  # its files were never listed
    for _ in range(2):  # two jobs at once add the same file: it is read once
        plans.generations._publish(rows, listed, base)
    assert plans.generations.load_or_extend(spark, store, "s", listed, lost).count() == 1


def test_empty_folder_has_empty_features(spark, tmp_path):
    (tmp_path / "plots").mkdir()
    out = plans.run_batch(spark, str(tmp_path / "plots"), PARAMS, str(tmp_path / "store"), "*.png")
    assert out["frames"].count() == out["rejects"].count() == 0


def test_stored_masks(spark, folder, tmp_path, monkeypatch):
    first = plans.stored_masks(spark, str(tmp_path), PARAMS)
    monkeypatch.setattr(plans, "quad_mask", lambda *a: pytest.fail("drawn again"))
    monkeypatch.setattr(plans, "region_mask", lambda *a: pytest.fail("drawn again"))
    tables = plans.stored_masks(spark, str(tmp_path), PARAMS)
    for table, again, array in zip(first, tables, plans.frame_masks(PARAMS)):
        assert table.schema == again.schema and np.array_equal(plans.frame_masks(PARAMS, (again, again))[0], array)
    beyond = tables[0].unionByName(tables[0]).union(spark.createDataFrame([(50, 2), (-1, 3), (None, 1)], "y int, x int"))
    want = plans.run_batch(spark, f"{folder}/day2", PARAMS, None, "*.png")["frames"].orderBy("image_id").collect()
    got = plans.run_batch(spark, f"{folder}/day2", PARAMS, str(tmp_path), "*.png", masks=(beyond, tables[1]))["frames"]
    assert got.orderBy("image_id").collect() == want


def test_report_without_flowers(spark):
    rows = [("a", i, 0.5, True, 40) for i in range(4)] + [("b", i, 0.00001, True, 40) for i in range(4)]
    frames = spark.createDataFrame(rows, "batch string, image_id int, share double, is_best boolean, n_spots int")
    frames = frames.withColumn("ts", F.timestamp_add("MINUTE", F.col("image_id"), F.lit("2016-07-05 10:00:00").cast("timestamp_ntz")))
    out = {r["batch"]: (r["mean_share"], r["typical_count"]) for r in plans.report(frames, None, "UTC", present_threshold=0.0001).collect()}
    assert out["a"][0] == 0.5 and out["b"][0] == 0.0 and out["b"][1] < out["a"][1]
    counted = plans.count_series(frames.withColumn("n_spots", F.when(F.col("image_id") != 1, F.col("n_spots"))))
    assert {r["count_estimate"] for r in counted.collect()} == {40.0}
