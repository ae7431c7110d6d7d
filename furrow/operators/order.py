"""Exact ordering work on groups too large for one task.

A window partitioned by batch would put a whole batch into one task. Here the
rows are sorted across the cluster into balanced ranges, each range keeps its
local positions, and only one small row per range and group is combined to
turn them into global ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..joins import match_measured
from ..lineage import cut

# Rows per window task once rows are numbered.
BLOCK_ROWS = 1 << 18


def _ranges(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Sort by group and order; store each row's range and place within it.

    ``order`` must be total within a group. The table is written once because
    the range limits may differ between two runs of the same plan.
    """
    placed = df.orderBy(*[F.col(b) for b in by], *order).withColumn("_at", F.monotonically_increasing_id())
    return cut(
        placed.select(
            *df.columns,
            F.shiftright("_at", 33).alias("_range"),
            F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
        )
    )


def _earlier(by: Sequence[str]):
    """Window over the ranges of a group that come before the current one."""
    return Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    """Add the exact 1-based row number within each group."""
    placed = _ranges(df, by, order)
    starts = (
        placed.groupBy(*by, "_range")
        .agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_base", F.coalesce(F.sum("_rows").over(_earlier(by)), F.lit(0)) - F.col("_first") + 1)
        .drop("_first", "_rows")
    )
    numbered = match_measured(placed, starts, [*by, "_range"])
    return numbered.withColumn(name, F.col("_place") + F.col("_base")).drop("_range", "_place", "_base")


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], totals: dict[str, Column], inclusive: bool = True
) -> DataFrame:
    """Add cumulative sums in order within each group, one per entry of ``totals``."""
    inputs = {f"_in_{name}": expr.cast("double") for name, expr in totals.items()}
    placed = _ranges(df.withColumns(inputs), by, order)
    local = Window.partitionBy(*by, "_range").orderBy("_place").rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    carried = placed.groupBy(*by, "_range").agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in totals])
    carried = carried.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_sum_{n}").over(_earlier(by)), F.lit(0.0)).alias(f"_carry_{n}") for n in totals],
    )
    summed = placed.withColumns(
        {f"_local_{n}": F.coalesce(F.sum(f"_in_{n}").over(local), F.lit(0.0)) for n in totals}
    )
    joined = match_measured(summed, carried, [*by, "_range"])
    return joined.select(*df.columns, *[(F.col(f"_local_{n}") + F.col(f"_carry_{n}")).alias(n) for n in totals])


def block_of(rn: str, block_rows: int) -> Column:
    return F.floor((F.col(rn) - 1) / block_rows).cast("long")


def nearest_known(
    df: DataFrame, by: Sequence[str], value: Column, rn: str = "rn", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``_prev`` and ``_next``: the closest known ``(rn, value)`` at or around each numbered row.

    Both directions use windows that grow from the start, which Spark evaluates
    in one pass; looking ahead is looking back in reverse order.
    """
    known = F.when(F.col("_value").isNotNull(), F.struct(F.col(rn).alias("rn"), F.col("_value").alias("value")))
    rows = df.withColumn("_value", value).withColumn("_block", block_of(rn, block_rows))
    keys = [*by, "_block"]

    def latest(column: Column | str, part: Sequence[str], order: Column, to: int) -> Column:
        window = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, to)
        return F.last(column, ignorenulls=True).over(window)

    ends = rows.groupBy(*keys).agg(F.min(known).alias("_lo"), F.max(known).alias("_hi"))
    carry = ends.select(
        *keys,
        latest("_hi", by, F.col("_block").asc(), -1).alias("_before"),
        latest("_lo", by, F.col("_block").desc(), -1).alias("_after"),
    )
    local = rows.withColumn("_known", known).select(
        *df.columns,
        "_block",
        latest("_known", keys, F.col(rn).asc(), 0).alias("_prev"),
        latest("_known", keys, F.col(rn).desc(), 0).alias("_next"),
    )
    return match_measured(local, carry, keys).select(
        *df.columns,
        F.coalesce("_prev", "_before").alias("_prev"),
        F.coalesce("_next", "_after").alias("_next"),
    )


def centred_mean(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    name: str,
    before: int,
    after: int,
    rn: str = "rn",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean of ``value`` over rows ``rn-before .. rn+after`` of the group.

    Blocks of consecutive rows are averaged apart; rows near a block's edge are
    also given to the neighbour as context and dropped again afterwards.
    """
    reach = max(before, after)
    # A row serves every block that holds a row whose window includes it.
    first = F.floor((F.greatest(F.col(rn) - reach, F.lit(1)) - 1) / block_rows)
    last = F.floor((F.col(rn) + reach - 1) / block_rows)
    copies = df.withColumn("_home", block_of(rn, block_rows)).withColumn(
        "_block", F.explode(F.sequence(first, last))
    )
    window = Window.partitionBy(*by, "_block").orderBy(rn).rowsBetween(-before, after)
    return (
        copies.withColumn(name, F.avg(value).over(window))
        .filter(F.col("_block") == F.col("_home"))
        .drop("_home", "_block")
    )
