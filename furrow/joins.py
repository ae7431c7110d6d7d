"""Join helpers that keep null keys and leave no hot key to one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

SPREAD = 32


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` in which null equals null; right keys are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{k}" for k in keys])


def attach(
    big: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str], ways: int = SPREAD
) -> DataFrame:
    """Add the columns of ``small`` (one row per key) to every matching row of ``big``.

    Rows of one hot key go to ``ways`` tasks: the small side is repeated that
    many times and the big side picks a copy by a hash of ``spread_by``. With
    no keys, ``small`` is a global aggregate of one row and is read as a scalar
    subquery, so nothing is joined.
    """
    extra = [c for c in small.columns if c not in keys]
    if not keys:
        row = small.select(F.struct(*extra).alias("_row")).scalar()
        return big.withColumn("_row", row).select(*big.columns, *[F.col(f"_row.{c}").alias(c) for c in extra])
    if ways == 1:
        return match(big, small, keys)
    copies = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    spread = big.withColumn("_copy", F.pmod(F.xxhash64(*spread_by), F.lit(ways)).cast("int"))
    return match(spread, copies, [*keys, "_copy"]).drop("_copy")


def match_measured(big: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi join with a small side that is stored first.

    The stored table tells Spark its size in bytes: it is broadcast below ``spark.sql.autoBroadcastJoinThreshold``,
    and beyond it both sides are shuffled and partitions of hot keys are split at run time.
    """
    return match(big, cut(small), keys)


def attach_measured(
    big: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str], stored: bool = False, how: str = "inner"
) -> DataFrame:
    """Like ``attach``, but leaves the way to Spark, which knows the stored small side's size in bytes."""
    if not keys:
        return attach(big, small, keys, spread_by)
    return match(big, small if stored else cut(small), keys, how)


def parted(df: DataFrame, key: str, keys: DataFrame, bits: int = 1 << 24) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may be in ``keys`` (one column of that name), and those whose key surely is not.

    A Bloom filter of ``bits`` bits with one hash decides, so a join with ``keys`` need move only the first. Its words are
    broadcast: at most ``bits / 64`` rows, however many keys there are. With more keys it lets more rows by, never fewer.
    """
    word, place, mask = (f"_{name}_{uuid4().hex}" for name in ("word", "place", "mask"))
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    at = {word: F.shiftright(slot, 6), place: (slot % 64).cast("int")}
    words = keys.select(key).withColumns(at).groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, {place})")).alias(mask))
    marked = df.withColumns(at).join(F.broadcast(words), word, "left")
    hit = F.coalesce(F.expr(f"shiftrightunsigned({mask}, {place}) & 1L") == 1, F.lit(False))
    return marked.where(hit).select(*df.columns), marked.where(~hit).select(*df.columns)
