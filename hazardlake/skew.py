"""Joins, ranks and running values that hold when one key owns a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(big: DataFrame, per_key: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``per_key`` (one row per key) to ``big``.

    A plain join on purpose: the optimizer broadcasts ``per_key`` where its size allows, and
    adaptive execution splits the partitions of hot keys of a sort-merge join. Nothing but
    this join may need the rows of a key together, or the split is not taken.
    """
    if how not in ("left", "inner"):
        raise ValueError(how)
    values = [c for c in per_key.columns if c not in keys]
    return big.join(per_key, keys, how).select(*big.columns, *values)


def rows_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key; partial aggregation keeps one row per key and task."""
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[F.col(c) for c in order])
    return (df.groupBy(*keys).agg(F.max_by(row, rank).alias("__row"))
            .select("__row.*"))


def first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Earliest row per key."""
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[F.col(c) for c in order])
    return (df.groupBy(*keys).agg(F.min_by(row, rank).alias("__row"))
            .select("__row.*"))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int,
                rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; the group limit runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def rank_in_segments(df: DataFrame, keys: list[str], segments: list[str], order: list[str],
                     rank: str = "rank") -> DataFrame:
    """Position of every row in its key's whole order, without one task per key.

    ``segments`` are columns that cut the order into coarse consecutive pieces (a date,
    then a range of ids); ``order`` sorts inside a piece. Rows are numbered inside their
    piece, and the running size of the earlier pieces of the key is added.
    """
    piece = [*keys, *segments]
    numbered = df.withColumn("__pos", F.row_number().over(Window.partitionBy(*piece).orderBy(*order)))
    counts = rows_per_key(df, piece)
    before = (Window.partitionBy(*keys).orderBy(*segments)
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("__off", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    joined = lookup(numbered, offsets, piece, "inner")
    return (joined.withColumn(rank, F.col("__pos") + F.col("__off"))
            .drop("__pos", "__off"))


def best_before(df: DataFrame, keys: list[str], at: str, value: str, out: str = "best") -> DataFrame:
    """Smallest ``value`` of the key at strictly earlier ``at``, for every row.

    Rows of one key and date are folded to one before the running minimum, so a task
    holds at most the distinct dates of a key, however many rows the key has.
    """
    spot = df.groupBy(*keys, at).agg(F.min(value).alias("__low"))
    earlier = (Window.partitionBy(*keys).orderBy(at)
               .rowsBetween(Window.unboundedPreceding, -1))
    low = spot.withColumn(out, F.min("__low").over(earlier)).drop("__low")
    return lookup(df, low, [*keys, at], "inner")


def global_rank(df: DataFrame, order: str, out: str = "rank", ties: tuple[str, ...] = ()) -> DataFrame:
    """1-based position in the whole order of a 64-bit integer column, then of ``ties``.

    The top 32 bits cut the order into ranges, the top 16 bits these into groups. Rows are
    numbered inside a range, ranges summed up inside a group and the at most 65,536 groups
    after that, so a task holds one range's rows or 65,536 sums.
    """
    ranged = df.withColumn("__seg", F.shiftright(order, 32)).withColumn("__top", F.shiftright(order, 48))
    sizes = ranged.groupBy("__top", "__seg").agg(F.count(F.lit(1)).alias("__n"))

    def running(w) -> Column:
        return F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    tops = sizes.groupBy("__top").agg(F.sum("__n").alias("__n")).select("__top", running(Window.orderBy("__top")).alias("__base"))
    offsets = (sizes.select("__top", "__seg", running(Window.partitionBy("__top").orderBy("__seg")).alias("__off"))
               .join(tops, "__top").select("__seg", (F.col("__off") + F.col("__base")).alias("__off")))
    inside = Window.partitionBy("__seg").orderBy(order, *ties)
    return (ranged.withColumn("__pos", F.row_number().over(inside)).join(offsets, "__seg")
            .withColumn(out, F.col("__pos") + F.col("__off")).drop("__seg", "__top", "__pos", "__off"))
