"""Ranks that do not pull a large group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialoom.functions.columns import bounded_broadcast

BUCKETS = 256


def top_n(df: DataFrame, group: Sequence[str], order: Sequence, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group.

    The rank filter lets Spark prune every partition to ``n`` rows per group before the shuffle, so a hot
    group costs its task at most ``n`` rows from each input partition.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order``; aggregates before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    chosen = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(chosen).select(*key, "_row.*").select(*df.columns)


def dense_position(
    df: DataFrame, group: Sequence[str], score: str, key: str, rank: str = "rank"
) -> DataFrame:
    """Position of each row in its group by ``score`` descending, then numeric ``key`` ascending.

    ``score`` must be rounded (a bounded number of distinct values). Rows are counted per (group, score,
    key range); cumulative sums run over those counts only, and the row numbers inside one such cell. No
    task ever holds a whole group, even when all of its scores are equal.
    """
    bounds = bounded_broadcast(df.groupBy(*group).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi")))
    width = (F.col("_hi") - F.col("_lo") + 1).cast("double")
    cell = df.join(bounds, list(group)).withColumn(
        "_cell", F.floor((F.col(key) - F.col("_lo")) * F.lit(BUCKETS) / width).cast("int")
    )
    counts = cell.groupBy(*group, score, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(F.col(score).desc(), "_cell").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, score, "_cell").orderBy(key)
    return (
        cell.join(offsets, [*group, score, "_cell"])
        .withColumn(rank, (F.col("_before") + F.row_number().over(inside)).cast("bigint"))
        .drop("_lo", "_hi", "_cell", "_before")
    )
