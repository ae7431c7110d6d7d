"""Stand-in inputs: the library's data model laid onto the shared tables.

Every input covers its whole table. ``events`` gives histograms and frame
series, ``embeddings`` small images and descriptors, ``lineitem`` joined with
``part`` count matrices.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import utc_clock

# The 8x8 stand-in frames: plot bounds leave the pixels 2..6.
SIDE = 8
SMALL_PLOT = ((1, 1), (7, 1), (1, 7), (7, 7))
WHOLE_FRAME = ((0, 0), (8, 0), (0, 8), (8, 8))
LIMITS = ("06:00", "12:00", "18:00")
# Line items a task sums, and the parts a sample's lines are dealt to where its taxa have no order.
TASK_LINES = 250_000
NEAR = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column, places: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(value, places) + F.lit(0.0)


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def settled(value: Column, places: int = 9) -> Column:
    """Rounded after a tiny step, for values that often end in an exact half."""
    return rounded(value + F.lit(1e-11), places)


def hist_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pixel of an image per user; the user shifts the exposure."""
    events = table(spark, sf_dir, "events")
    level = F.floor(F.col("value") / 2) + F.col("user_id") % 8
    return events.select(
        F.col("user_id").alias("image_id"), F.col("event_type").alias("batch"),
        F.least(F.lit(255), level).cast("int").alias("bin"),
    )


def coarse_hist_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    level = F.least(F.lit(255), F.floor(F.col("value") / 8))
    return events.select(F.col("user_id").alias("image_id"), level.cast("int").alias("bin"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames ``(batch, image_id, ts, metric, counted, kind)``: a batch per day."""
    events = utc_clock(table(spark, sf_dir, "events"))
    return events.select(
        F.to_date("ts").cast("string").alias("batch"),
        F.col("event_id").alias("image_id"),
        "ts",
        F.col("value").alias("metric"),
        (F.col("event_type") == "error").alias("counted"),
        F.col("event_type").alias("kind"),
    )


def frames_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of one series in which every seventh time is unknown."""
    ts = F.when(F.col("image_id") % 7 == 3, F.lit(None)).otherwise(F.col("ts"))
    return frames(spark, sf_dir).select("image_id", ts.alias("ts"))


def pixels_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 one-channel images ``(image_id, y, x, v)``."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return rows.select(
        F.col("vec_id").alias("image_id"),
        F.floor(F.col("i") / SIDE).cast("int").alias("y"),
        (F.col("i") % SIDE).cast("int").alias("x"),
        F.col("v").cast("double").alias("v"),
    )


def _byte(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.lit(128.0) + 300.0 * v.cast("double") + 0.5))).cast("int")


def pixels_bgr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 colour images: three vectors each; a channel without a vector is 0."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))

    def channel(c: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("vec_id") % 3 == c, _byte(F.col("v")))), F.lit(0))

    grouped = rows.groupBy(F.floor(F.col("vec_id") / 3).alias("image_id"), "i")
    colour = grouped.agg(channel(0).alias("b"), channel(1).alias("g"), channel(2).alias("r"))
    return colour.select(
        "image_id", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).cast("int").alias("x"), "b", "g", "r"
    )


def bgr_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same colour images as decoded image rows, in two batches by image parity."""
    rows = table(spark, sf_dir, "embeddings")
    levels = F.transform(F.col("embedding"), _byte)
    blank = F.array_repeat(F.lit(0), SIDE * SIDE)

    def channel(c: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("vec_id") % 3 == c, levels)), blank)

    images = rows.groupBy(F.floor(F.col("vec_id") / 3).alias("n")).agg(
        channel(0).alias("b"), channel(1).alias("g"), channel(2).alias("r")
    )
    inter = F.flatten(F.transform(F.arrays_zip("b", "g", "r"), lambda p: F.array(p["b"], p["g"], p["r"])))
    data = F.unhex(F.array_join(F.transform(inter, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    name = F.col("n").cast("string")
    return images.select(
        F.concat(name, F.lit(".png")).alias("path"),
        name.alias("image_id"),
        (F.col("n") % 2).cast("string").alias("batch"),
        F.col("n").cast("bigint").alias("number"),
        F.struct(
            F.concat(name, F.lit(".png")).alias("origin"),
            F.lit(SIDE).alias("height"),
            F.lit(SIDE).alias("width"),
            F.lit(3).alias("nChannels"),
            F.lit(16).alias("mode"),
            data.alias("data"),
        ).alias("image"),
    )


def descriptor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per vector: its 64 values as eight descriptors of eight."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), parts.alias("features"))


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of 50 images ``(image_id, pos, vec, label)``."""
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 50).alias("image_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"), "label"
    )


def _lines(spark: SparkSession, sf_dir: str, taxon: Column, near: Column) -> DataFrame:
    """Line items ``(condition, sample_id, near, taxon, quantity)``, those of one sample and ``near`` in one partition.

    Samples are many and meet a taxon seldom, so summing before the shuffle would hold a cell for nearly every line a task
    reads. Lines are dealt first, to as many partitions as their number asks for; a sample of many lines is dealt by ``near``.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", near.alias("near"), taxon.alias("taxon"))
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_linestatus").alias("condition"), F.col("l_suppkey").alias("sample_id"), "near", "taxon", "l_quantity"
    )
    return rows.repartition(max(1, math.ceil(lines.count() / TASK_LINES)), "condition", "sample_id", "near")


def _quantities(spark: SparkSession, sf_dir: str, taxon: Column) -> DataFrame:
    lines = _lines(spark, sf_dir, taxon, F.hash(taxon) % NEAR)
    cells = lines.groupBy("condition", "sample_id", "near", "taxon").agg(F.sum("l_quantity").alias("n"))
    return cells.drop("near")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of 25 taxa: ``(condition, sample_id, taxon, n)``."""
    return _quantities(spark, sf_dir, F.col("p_brand"))


def fine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse matrix of some 1,250 taxa."""
    return _quantities(spark, sf_dir, F.concat_ws("/", "p_brand", F.col("p_size").cast("string")))


def _linked(spark: SparkSession, sf_dir: str, base: Column, number: Column, groups: tuple[int, ...], few: bool) -> DataFrame:
    """Counts in which every line counts for its taxon and for groups of neighbouring taxa.

    A taxon and a group of g hold the same lines in part, so they correlate
    with about 1 / sqrt(g) at any number of samples: a fixed threshold keeps
    these pairs. ``few`` taxa are summed before the groups are: of many, a sample has hardly a line more than it has cells.
    """
    # Taxa of one group lie near: every group is summed where its taxa are.
    near = F.floor(number / math.lcm(*groups))
    cell = ["condition", "sample_id", "near"]
    lines = _lines(spark, sf_dir, F.struct(base.alias("base"), number.alias("number")), near)
    cells = lines.withColumnRenamed("l_quantity", "n")
    if few:
        cells = cells.groupBy(*cell, "taxon").agg(F.sum("n").alias("n"))
    place = F.col("taxon.number")
    names = [F.col("taxon.base"), *[F.concat(F.lit(f"group of {g}/"), F.floor(place / g).cast("string")) for g in groups]]
    named = cells.select(*cell, F.explode(F.array(*names)).alias("taxon"), "n")
    return named.groupBy(*cell, "taxon").agg(F.sum("n").alias("n")).drop("near")


def _brand() -> Column:
    return F.substring("p_brand", 7, 9).cast("int")


def linked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 taxa with groups of two and three neighbours."""
    return _linked(spark, sf_dir, F.col("p_brand"), _brand(), (2, 3), few=True)


def linked_fine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some 1,250 taxa with groups of two neighbours: most cells are absent."""
    taxon = F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))
    return _linked(spark, sf_dir, taxon, _brand() * 100 + F.col("p_size"), (2,), few=False)


def with_sample(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sample", F.concat_ws("|", "condition", F.col("sample_id").cast("string")))
