"""Exact ranks inside groups of any size, without collecting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberline.session import staged

_ROW_BITS = 33  # monotonically_increasing_id keeps the row's place in the low 33 bits


def distributed_rank(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """Add ``out``: the row's place from 1 among the rows that agree on ``keys``, by ``order``.

    A window would bring each group into one task. Here rows are sorted by range over (keys, order), every sorted
    slice numbers its own rows, and the number of rows that a group has in earlier slices is added. What is joined
    back is one row per slice and group it holds, not data; a group that fills many slices (a hot key) stays spread.

    ``order`` must make the order total, or tied rows get an arbitrary order among themselves. Null keys form a group
    of their own. An empty input gives an empty result. The sorted rows are kept in the shared folder so that both
    passes see the same slices; pass narrow rows.
    """
    part, place, first, before = "__dr_slice", "__dr_place", "__dr_first", "__dr_before"
    cols = [F.col(k) for k in keys]
    by = [*cols, *order]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    numbered = ranged.sortWithinPartitions(*by).withColumn("__dr_mid", F.monotonically_increasing_id())
    numbered = numbered.withColumn(part, F.shiftright("__dr_mid", _ROW_BITS).cast("int")).withColumn(
        place, F.col("__dr_mid").bitwiseAND((1 << _ROW_BITS) - 1)
    )
    kept = staged(numbered.drop("__dr_mid"), "rank")
    from pyspark.sql import Window

    slices = kept.groupBy(part, *keys).agg(F.min(place).alias(first), F.count(F.lit(1)).alias("__dr_n"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn(before, F.coalesce(F.sum("__dr_n").over(earlier), F.lit(0)))
    renamed = slices.select(F.col(part).alias("__dr_s"), *[F.col(k).alias(f"__dr_k{i}") for i, k in enumerate(keys)], first, before)
    match = F.col(part) == F.col("__dr_s")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__dr_k{i}"))
    joined = kept.join(renamed, match, "left")
    rank = F.col(place) - F.col(first) + F.col(before) + 1
    return joined.withColumn(out, rank.cast("long")).drop("__dr_s", *[f"__dr_k{i}" for i in range(len(keys))], first, before, part, place)
