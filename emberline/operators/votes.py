"""Counts of choices and what they decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def tally(df: DataFrame, keys: list[str], choice: str, out: str = "votes") -> DataFrame:
    return df.filter(F.col(choice).isNotNull()).groupBy(*keys, choice).agg(F.count(F.lit(1)).alias(out))


def plurality(counts: DataFrame, keys: list[str], choice: str, votes: str = "votes") -> DataFrame:
    """(keys..., top_votes, tied, winner): the choice with most votes; null where several share the top.

    Works on tallies, a row per group and choice: choices with equally many votes are counted, then the largest count wins.
    Both steps aggregate partially before the shuffle; nothing is collected, whatever the number of choices.
    """
    level = counts.groupBy(*keys, votes).agg(F.count(F.lit(1)).cast("int").alias("tied"), F.max(choice).alias("c"))
    best = level.groupBy(*keys).agg(F.max(F.struct(F.col(votes).alias("v"), "tied", "c")).alias("b"))
    return best.select(*keys, F.col("b.v").alias("top_votes"), F.col("b.tied").alias("tied"), F.when(F.col("b.tied") == 1, F.col("b.c")).alias("winner"))


def consistent(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """One value per group where all non-null ones agree, else null. Max and min say so without a distinct count."""
    return df.groupBy(*keys).agg(F.when(F.max(value) == F.min(value), F.max(value)).alias(out), F.count(value).alias("observations"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))


def share_of_group(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(value) / F.sum(value).over(Window.partitionBy(*keys)))
