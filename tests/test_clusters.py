import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.operators import clusters
from furrow.plans.grouping import group_images, group_with_centres


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(8)
    return [(int(i % 7), i, rng.normal(size=5).round(3).tolist()) for i in range(140)]


@pytest.fixture(scope="module")
def descriptors(spark, points):
    return spark.createDataFrame(points, "image_id int, pos int, vec array<double>")


CENTRES = [[0.0] * 5, [1.0] * 5, [-1.0] * 5, [9.0] * 5]


def _brute(points, pooling):
    pooled = {}
    for image, _, vec in points:
        d = [float(np.linalg.norm(np.array(vec) - c)) for c in np.array(CENTRES)]
        k = int(np.argmin(d))
        row = pooled.setdefault(image, [0.0] * len(CENTRES))
        row[k] = max(row[k], d[k]) if pooling == "max" else row[k] + d[k]
    return pooled


@pytest.mark.parametrize("pooling", ["max", "sum"])
def test_pooling_and_groups(descriptors, points, pooling):
    want = _brute(points, pooling)
    words = clusters.assign_words(descriptors, CENTRES)
    pooled = clusters.pooled_vectors(words, len(CENTRES), pooling)
    got = {r["image_id"]: r["pooled"] for r in pooled.collect()}
    assert got.keys() == want.keys()
    for image, row in want.items():
        assert got[image] == pytest.approx(row)
    groups = {r["image_id"]: r["group"] for r in group_with_centres(descriptors, CENTRES, pooling).collect()}
    # The far centre is used by no descriptor, so a zero wins everywhere.
    assert groups == {image: row.index(0.0) + 1 for image, row in want.items()}
    used = {r["image_id"]: r["group"] for r in group_with_centres(descriptors, CENTRES, pooling, "ignore").collect()}
    assert used == {i: row.index(min(v for v in row if v > 0)) + 1 for i, row in want.items()}


def test_nearest_takes_the_first_of_equal_centres(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0])], "image_id int, pos int, vec array<double>")
    row = clusters.assign_words(df, [[0.0, 2.0], [2.0, 0.0]]).first()
    assert (row["word"], row["dist"]) == (0, 2.0)


def test_bad_options(descriptors):
    words = clusters.assign_words(descriptors, CENTRES)
    with pytest.raises(ValueError):
        clusters.pooled_vectors(words, 4, "mean")
    with pytest.raises(ValueError):
        clusters.group_of(clusters.pooled_vectors(words, 4), empty="x")


def test_records(spark):
    records = spark.createDataFrame(
        [("a", [[1.0, 2.0], [3.0, 4.0]]), ("b", []), ("c", None)], "image_id string, features array<array<double>>"
    )
    rows = [tuple(r) for r in clusters.explode_descriptors(records).orderBy("pos").collect()]
    assert rows == [("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0])]
    assert [tuple(r) for r in clusters.first_descriptors(records).collect()] == [("a", [1.0, 2.0])]


def test_user_extractor_skips_unreadable_images(spark):
    def extract(batches):
        for batch in batches:
            ok = batch[batch["data"].map(len) > 0]
            if len(ok):
                yield pd.DataFrame({"image_id": ok["image_id"], "features": [[[float(len(d))]] for d in ok["data"]]})

    images = spark.createDataFrame([("a", b"xyz"), ("b", b"")], "image_id string, data binary")
    out = clusters.extract_descriptors(images, extract, "image_id string, features array<array<double>>")
    assert [tuple(r) for r in out.collect()] == [("a", [[3.0]])]


def test_tile_descriptors(spark):
    v = np.add.outer(np.arange(8) * 2.0, np.arange(8) * -3.0)
    rows = [(1, y, x, float(v[y, x])) for y in range(8) for x in range(8)]
    tile = clusters.tile_descriptors(spark.createDataFrame(rows, "image_id int, y int, x int, v double")).first()
    assert tile["vec"] == pytest.approx([v.mean(), v.var(), -3.0, 2.0])


def test_kmeans_fit_finds_separated_words(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, (rng.normal(size=2) * 0.1 + [10 * (i % 3), 0]).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "image_id int, pos int, vec array<double>")
    labels = {r["image_id"]: r["group"] for r in clusters.kmeans_labels(clusters.first_vectors(df), 3).collect()}
    assert len({labels[i] for i in range(60)}) == 3 and set(labels.values()) == {1, 2, 3}
    assert all(labels[i] == labels[i % 3] for i in range(60))
    groups = group_images(df, k=3, max_iter=10).collect()
    assert len(groups) == 60 and {r["group"] for r in groups} <= {1, 2, 3}


def test_kmeans_is_repeatable(descriptors):
    once, again = (clusters.fit_centres(descriptors, 3, 5, "random", 11) for _ in range(2))
    assert np.allclose(once, again) and len(once) == 3


def test_group_members_keep_name_order(spark):
    groups = spark.createDataFrame([("b", 1), ("a", 1), ("d", 2), ("c", 1)], "image_id string, group int")
    rows = sorted(tuple(r) for r in clusters.group_members(groups).select("group", "position", "image_id").collect())
    assert rows == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "d")]


def test_mean_centres(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0]), (0, [3.0, 5.0]), (1, [7.0, 7.0])], "label int, vec array<double>")
    assert clusters.mean_centres(df, "label") == [[2.0, 4.0], [7.0, 7.0]]
    assert df.select(F.size("vec")).first()[0] == 2


def test_settled_centres(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([0, 1, 2, 10, 11, 12, 30])]
    df = spark.createDataFrame(rows, "pos int, vec array<double>")
    start = clusters.first_centres(df, 3)
    assert start == [[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]]
    done = clusters.settle_centres(df, start, 50)
    again = clusters.settle_centres(df, done, 1)
    assert done == again and clusters.settle_centres(df, [[0.0, 0.0], [99.0, 0.0], [999.0, 0.0]], 1)[2] == [999.0, 0.0]
