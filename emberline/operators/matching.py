"""Joins with a rule about which match counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def best_match(left: DataFrame, key: str, candidates: list[tuple[DataFrame, list[str], int]], value: str, order: str) -> DataFrame:
    """``left`` with (match, strategy): each candidate set is joined on its own columns; the smallest strategy number wins, then the first by ``order``."""
    found = None
    for right, on, rank in candidates:
        r = right.select(*on, F.col(value).alias("__value"), F.col(order).alias("__order")).groupBy(*on).agg(F.min_by("__value", "__order").alias("__value"), F.min("__order").alias("__order"))
        hit = left.select(key, *on).join(r, on).select(key, F.lit(rank).alias("__rank"), "__value", "__order")
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(key).agg(F.min_by(F.struct("__value", "__rank"), F.struct("__rank", "__order")).alias("__b"))
    return left.join(best, key, "left").withColumn("match", F.col("__b.__value")).withColumn("strategy", F.col("__b.__rank")).drop("__b")


def cached_or_new(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that the cache answers, rows to compute): a lookup and its anti-join."""
    return requests.join(cache, key), requests.join(cache, key, "left_anti")


def exact_or_unique(left: DataFrame, keys: list[str], name: str, number: str, right: DataFrame, r_name: str, r_number: str, value: str) -> DataFrame:
    """Within a group: match by exact name, else by number where exactly one row of the group has it."""
    exact = right.groupBy(*keys, F.col(r_name).alias(name)).agg(F.max(value).alias("__exact"))
    unique = right.groupBy(*keys, F.col(r_number).alias(number)).agg(F.count(F.lit(1)).alias("__n"), F.max(value).alias("__unique")).filter("__n = 1").drop("__n")
    return left.join(exact, [*keys, name], "left").join(unique, [*keys, number], "left").withColumn("match", F.coalesce("__exact", "__unique")).drop("__exact", "__unique")


def small_side(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A control table marked for broadcast after its rows were counted; beyond ``most`` it is joined as any other table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def other_rows(left: DataFrame, right: DataFrame, on: list[str], differs: Column) -> DataFrame:
    """Equi-join on the group with a condition that leaves the row itself out. Groups are games: bounded."""
    return left.join(right, on).filter(differs)


def union_filling(frames: list[DataFrame], fill: str = "") -> DataFrame:
    """All columns of all frames; missing and null texts become ``fill``."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.fillna(fill)


def union_common(frames: list[DataFrame]) -> DataFrame:
    """Only the columns that all frames have."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    out = frames[0].select(*common)
    for f in frames[1:]:
        out = out.unionAll(f.select(*common))
    return out


def combine_labels(low: Column, outcome: Column) -> Column:
    """Three-valued: a low-level False wins, True needs one of both, nothing where the outcome is unknown."""
    return F.when(outcome.isNull(), F.lit(None)).when(low == F.lit(False), F.lit(False)).when((low == F.lit(True)) | (outcome == F.lit(True)), F.lit(True))
