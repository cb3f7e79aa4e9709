"""Samples that follow target shares of categories (problem 2).

Divisor method: the rows of a category get a random rank, row r of a category with target t has the priority
(r - 0.5) / t, and a draw of S rows takes the S rows with the smallest priorities, those within a category's floor
before all others. A category that runs out of rows simply has no more priorities, so its seats go to the others.

Defined cases: samples without id, category or label aren't usable; a row delivered several times counts once;
phases are compared without case and outer white space; a target of 0 gets only its floor; floors that together exceed
S compete by priority; a category without any row is reported with 0; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberline.operators.matching import small_side
from emberline.operators.ranking import distributed_rank


def folded(col: Column) -> Column:
    """A category's name without case and outer white space; null where nothing is left."""
    name = F.lower(F.regexp_replace(col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(name != "", name)


def usable_samples(kto: DataFrame) -> DataFrame:
    """(sample_id, category, label) of every distinct usable sample: only these three narrow columns are shuffled."""
    rows = kto.select(F.col("sample_id"), folded(F.col("phase")).alias("category"), F.col("label"))
    return rows.filter("sample_id IS NOT NULL AND category IS NOT NULL AND label IS NOT NULL").distinct()


def draw_sizes(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """(draw_id, size): how many samples each draw takes."""
    total = samples.agg(F.count(F.lit(1))).scalar()
    draws = targets.groupBy("draw_id").agg(F.max("draw_permille").alias("draw_permille"))
    return draws.withColumn("total", total).select("draw_id", F.expr("(draw_permille * total) DIV 1000").alias("size"))


def rank_samples(samples: DataFrame, seed: str = "draw-1") -> DataFrame:
    """The samples with ``place``: their random rank in their category. The ranking is distributed: one category may hold most of the rows."""
    order = F.md5(F.concat(F.lit(seed + "|"), F.col("sample_id").cast("string")))
    return distributed_rank(samples.withColumn("__h", order), ["category", "label"], [F.col("__h"), F.col("sample_id")], "place").drop("__h")


def draw(samples: DataFrame, targets: DataFrame, seed: str = "draw-1", ranked: DataFrame | None = None) -> DataFrame:
    """(draw_id, sample_id, category, label, place): the rows of every draw.

    ``ranked``: the samples by ``rank_samples``, where they were ranked before. ``targets`` is a control table of one row per
    draw and category.
    """
    ranked = rank_samples(samples, seed) if ranked is None else ranked
    wanted = targets.select("draw_id", folded(F.col("phase")).alias("category"), "label", "target_permille", "min_rows")
    wanted = wanted.distinct().join(draw_sizes(samples, targets), "draw_id")
    candidates = ranked.join(small_side(wanted), ["category", "label"]).filter((F.col("target_permille") > 0) | (F.col("place") <= F.col("min_rows")))
    priority = F.when(F.col("target_permille") > 0, (F.col("place") - 0.5) / F.col("target_permille")).otherwise(F.lit(float("inf")))
    candidates = candidates.select(
        "draw_id", "size", "sample_id", "category", "label", "place", F.when(F.col("place") <= F.col("min_rows"), 0).otherwise(1).alias("__late"), priority.alias("__priority")
    )
    by = [F.col(c) for c in ("__late", "__priority", "category", "label", "place")]
    seated = distributed_rank(candidates, ["draw_id"], by, "__seat")
    return seated.filter("__seat <= size").select("draw_id", "sample_id", "category", "label", "place")


def draw_report(samples: DataFrame, targets: DataFrame, drawn: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """One row per target row: what was asked, what exists, what was drawn, and whether the target can't be met.

    A target can't be met if the draw gave fewer rows than it asks for and the ranking of the category ends before the rank
    that would meet it: no further priority stood against those that were drawn.
    """
    ranked = rank_samples(samples) if ranked is None else ranked
    have = ranked.groupBy("category", "label").agg(F.max("place").alias("available"))
    took = drawn.groupBy("draw_id", "category", "label").agg(F.count(F.lit(1)).alias("drawn"))
    asked = targets.distinct().withColumn("category", folded(F.col("phase"))).join(draw_sizes(samples, targets), "draw_id")
    out = asked.join(have, ["category", "label"], "left").join(took, ["draw_id", "category", "label"], "left")
    out = out.withColumn("available", F.coalesce("available", F.lit(0))).withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    lacks = lambda c: (F.col(c) * 1000 < F.col("target_permille") * F.col("size")) | (F.col(c) < F.col("min_rows"))
    unmet = lacks("drawn") & lacks("available")
    return out.select(
        "draw_id", "phase", F.col("label").cast("int").alias("label"), "target_permille", "min_rows", "size", "available", "drawn",
        F.coalesce(F.expr("try_divide(drawn * 1000.0D, CAST(size AS DOUBLE))"), F.lit(0.0)).alias("actual_permille"), unmet.alias("unmet"),
    )
