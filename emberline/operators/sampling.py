"""Samples that are the same on every run: order and chance come from a seeded digest of a stable key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberline.operators.ranking import distributed_rank


def digest_order(seed: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), key.cast("string")))


def unit(seed: str, key: Column) -> Column:
    """A number in [0, 1) from 32 bits of the digest."""
    return F.conv(F.substring(digest_order(seed, key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def keep_or_copy(df: DataFrame, seed: str, key: str, keep: Column, extra: Column) -> DataFrame:
    """A row per copy: kept with probability ``keep``, then floor(extra) more and one with probability of the rest."""
    more = F.floor(extra) + (unit(seed + "+", F.col(key)) < extra - F.floor(extra)).cast("bigint")
    n = F.when(unit(seed, F.col(key)) < keep, 1 + more).otherwise(0)
    return df.withColumn("__n", n.cast("int")).filter("__n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")


def largest_remainder(buckets: DataFrame, total: Column, weight: str, order: str) -> DataFrame:
    """Whole quotas that sum to ``total``: floors of the shares, the rest by largest remainder, then weight, then ``order``.

    A row per bucket of a control table.
    """
    w = Window.partitionBy()
    share = F.col(weight) / F.sum(weight).over(w) * total
    rows = buckets.withColumn("__share", share).withColumn("__floor", F.floor("__share").cast("bigint"))
    rows = rows.withColumn("__rest", F.round(F.col("__share") - F.col("__floor"), 9))
    place = F.row_number().over(Window.orderBy(F.desc("__rest"), F.desc(weight), F.col(order)))
    rows = rows.withColumn("__place", place).withColumn("__left", total.cast("bigint") - F.sum("__floor").over(w))
    return rows.withColumn("quota", F.col("__floor") + (F.col("__place") <= F.col("__left")).cast("bigint")).drop("__share", "__floor", "__rest", "__place", "__left")


def quota_sample(df: DataFrame, quotas: DataFrame, keys: list[str], key: str, seed: str) -> DataFrame:
    """The first ``quota`` rows of each bucket in digest order. Ranks are distributed: a bucket may hold most of the rows."""
    ranked = distributed_rank(df.withColumn("__h", digest_order(seed, F.col(key))), keys, [F.col("__h"), F.col(key)], "place")
    return ranked.join(quotas, keys).filter("place <= quota").drop("__h")


def round_robin_fill(have: DataFrame, quotas: DataFrame, keys: list[str], key: str, seed: str, total: int) -> DataFrame:
    """Quota sample, then the shortage filled from what buckets have beyond their quotas, one row of each bucket in turn."""
    ranked = distributed_rank(have.withColumn("__h", digest_order(seed, F.col(key))), keys, [F.col("__h"), F.col(key)], "place").drop("__h")
    rows = ranked.join(quotas, keys, "left").withColumn("quota", F.coalesce("quota", F.lit(0).cast("bigint")))
    rows = rows.withColumn("__late", (F.col("place") > F.col("quota")).cast("int"))
    rows = rows.withColumn("__turn", F.when(F.col("__late") == 1, F.col("place") - F.col("quota")).otherwise(0))
    seated = distributed_rank(rows, [], [F.col("__late"), F.col("__turn"), *[F.col(k) for k in keys], F.col("place")], "__seat") if keys else rows
    return seated.filter(F.col("__seat") <= total).withColumn("filled", F.col("__late") == 1).drop("__late", "__turn", "__seat")


def split_by_digest(df: DataFrame, key: str, seed: str, ratio: float) -> DataFrame:
    """``part`` train for the first floor(n * ratio) rows in digest order, else test."""
    ranked = distributed_rank(df.withColumn("__h", digest_order(seed, F.col(key))), [], [F.col("__h"), F.col(key)], "__place")
    n = df.agg(F.floor(F.count(F.lit(1)) * F.lit(ratio))).scalar()
    return ranked.withColumn("part", F.when(F.col("__place") <= n, "train").otherwise("test")).drop("__h", "__place")


def flatten_weights(labels: DataFrame, details: DataFrame, roles: DataFrame) -> DataFrame:
    """(label, detail, role, weight): the label's weight times the detail's share times the role's share, both within the label.

    Control tables (label, w), (label, detail, w), (label, role, w); a label without roles keeps one bucket per detail.
    """
    share = lambda df: df.filter("w > 0").withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("label")))
    out = labels.filter("w > 0").withColumnRenamed("w", "__l").join(share(details).withColumnRenamed("w", "__d"), "label")
    out = out.join(share(roles).withColumnRenamed("w", "__r"), "label", "left")
    return out.select("label", "detail", "role", (F.col("__l") * F.col("__d") * F.coalesce("__r", F.lit(1.0))).alias("weight"))


def with_replacement(df: DataFrame, quotas: DataFrame, keys: list[str], key: str, seed: str) -> DataFrame:
    """``quota`` rows of each bucket in digest order; a bucket with fewer rows gives them again in turns: ``copy_no`` tells the copies apart.

    ``quotas``: (keys..., available, quota). How often a row comes follows from its rank, so no task holds a bucket.
    """
    ranked = distributed_rank(df.withColumn("__h", digest_order(seed, F.col(key))), keys, [F.col("__h"), F.col(key)], "place").drop("__h")
    rows = ranked.join(quotas, keys).filter("place <= quota")
    times = F.expr("(quota - place + available) DIV available")
    return rows.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("bigint"), times)))


def sample_report(selected: DataFrame, quotas: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., requested, available, selected, missing) of each bucket."""
    got = selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("selected"))
    out = quotas.join(got, keys, "left").withColumn("selected", F.coalesce("selected", F.lit(0)))
    return out.select(*keys, F.col("quota").alias("requested"), "available", "selected", (F.col("quota") - F.col("selected")).alias("missing"))
