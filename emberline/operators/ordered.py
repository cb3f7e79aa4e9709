"""Operators that look back or forth along an order inside a group (a game, a player): as-of, first, previous, running.

Groups are games or players of a game, so a group is bounded by what one game logs; windows over one group spec share one
shuffle and sort. Every order is total (it ends in a key), so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_before(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """As-of: the last non-null ``value`` of the group strictly before each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def first_after(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """The first non-null ``value`` of the group strictly after each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(out, F.first(value, ignorenulls=True).over(w))


def seen_before(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Whether the group had a row before; with the target among the keys: a repeated choice."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def prior_count(df: DataFrame, keys: list[str], order: list[str], predicate: Column, out: str) -> DataFrame:
    """Earlier rows of the group that satisfy the predicate; rows with the same ``order`` aren't earlier."""
    w = Window.partitionBy(*keys).orderBy(*order)
    hit = F.coalesce(predicate.cast("int"), F.lit(0))
    upto = F.sum(hit).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum(hit).over(Window.partitionBy(*keys, *order))
    return df.withColumn(out, upto - same)


def sticky(df: DataFrame, keys: list[str], order: list[str], condition: Column, out: str) -> DataFrame:
    """True from the first row of the group on which the condition holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.max(F.coalesce(condition, F.lit(False))).over(w))


def last_wins(df: DataFrame, keys: list[str], order: Column, *values: str) -> DataFrame:
    """One row per group: the values of its last row by ``order``. No window: partial aggregation before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("__v")).select(*keys, "__v.*")


def first_wins(df: DataFrame, keys: list[str], order: Column, *values: str) -> DataFrame:
    """One row per group: the values of its first row by ``order``."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("__v")).select(*keys, "__v.*")


def pre_post(df: DataFrame, keys: list[str], order: Column, is_pre: Column, is_post: Column, value: str) -> DataFrame:
    """Per group the last value before and the first after, in one pass; groups without both are left out."""
    out = df.groupBy(*keys).agg(
        F.max_by(F.when(is_pre, F.col(value)), F.when(is_pre, order)).alias("pre"), F.min_by(F.when(is_post, F.col(value)), F.when(is_post, order)).alias("post")
    )
    return out.filter("pre IS NOT NULL AND post IS NOT NULL")
