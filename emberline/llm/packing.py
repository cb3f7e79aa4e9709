"""Filling containers of fixed capacity with items of varying length (problem 6).

Bulk-synchronous best fit. Items longer than the capacity are cut into full pieces and a rest; whole items and rests are
never cut. Lengths are whole numbers up to the capacity, so items of one length are interchangeable and all items form at
most ``capacity`` size classes, however many rows there are. One round matches every open gap with at most one item at
the same time: gap and size classes are sorted, a sweep in ascending order gives each gap the longest item not above it
that no smaller gap took (its predecessor in the sorted order; the matching of a sequence of brackets), and conflicts
inside a class are resolved by rank: the gap of rank k gets the item of rank k. The gaps are updated and the next round
follows, until nothing fits; then further containers are opened for what is left.

What the rounds work on is the table of size classes, a row per length that occurs: at most ``capacity`` rows of each
spec, a bound that doesn't depend on the data. The items themselves are ranked inside their length by a distributed sort
(no window, no group in one task) and meet the matches by (spec, length) and an interval of ranks.

Defined cases: null contents and null arrays count 0 code points; items of length 0 take a place in the container of the
same rank rules (they fit everywhere); equal lengths are ordered by id; a sample delivered several times is one item;
specs with a null or non-positive capacity are left out; empty tables give empty results.
"""

from __future__ import annotations

import functools
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from emberline.operators.ranking import distributed_rank
from emberline.session import staged

#: Rows of the match table up to which it is broadcast; beyond it the join shuffles. A row takes under 64 bytes.
BROADCAST_MATCHES = 200_000
#: Specs whose items are made in one pass; further specs take further passes. A spec is a setting, not data.
SPECS_AT_ONCE = 1000


def content_length(*sides: str) -> Column:
    """Code points of all contents of the message arrays together; nulls count 0."""
    total = F.lit(0)
    for side in sides:
        total = total + F.coalesce(
            F.aggregate(F.col(side), F.lit(0), lambda a, m: a + F.coalesce(F.length(m["content"]), F.lit(0))), F.lit(0)
        )
    return total


def kto_items(kto: DataFrame) -> DataFrame:
    """(item_id, length) of each distinct sample; texts stay in the scan's stage."""
    rows = kto.filter("sample_id IS NOT NULL").select(F.col("sample_id").alias("item_id"), content_length("prompt", "completion").alias("length"))
    return rows.distinct()


def pieces(items: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity, item_id, length, piece_no, piece_length): items cut only where they exceed the capacity."""
    settings = specs.filter("capacity_chars > 0").select("spec_id", F.col("capacity_chars").cast("int").alias("capacity")).distinct().orderBy("spec_id", "capacity").collect()
    blocks = []
    for first in range(0, max(1, len(settings)), SPECS_AT_ONCE):
        each = F.array(*[F.struct(F.lit(r.spec_id).alias("spec_id"), F.lit(r.capacity).alias("capacity")) for r in settings[first : first + SPECS_AT_ONCE]])
        if not settings:
            each = F.expr("CAST(array() AS array<struct<spec_id: int, capacity: int>>)")
        blocks.append(items.select("item_id", "length", F.inline(each)))
    rows = functools.reduce(DataFrame.unionByName, blocks)
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / F.col("capacity"))).cast("int")
    rows = rows.select("spec_id", "capacity", "item_id", "length", F.explode(F.sequence(F.lit(1), n)).alias("piece_no"))
    return rows.withColumn("piece_length", F.least(F.col("capacity"), F.col("length") - (F.col("piece_no") - 1) * F.col("capacity")).cast("int"))


def best_fit_rounds(capacity: int, counts: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Matches (length, first_rank, first_bin, n, wrap): the n items of that length from first_rank go to bins first_bin, +1, ...,
    beginning again at first_bin after ``wrap`` bins.

    ``counts`` has the number of items of each length in 0..capacity. Ranks and bins count from 1. Runs of bins with the
    same gap are kept as intervals, so the work depends on the number of classes, not on the number of items.
    """
    left = {length: n for length, n in counts.items() if n > 0 and 0 < length <= capacity}
    next_rank = {length: 1 for length in counts}
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first bin, number of bins)
    bins = 0
    while left:
        total = sum(length * n for length, n in left.items())
        opened = max(1, -(-total // capacity))
        gaps.setdefault(capacity, []).append((bins + 1, opened))
        bins += opened
        while left:
            sizes = sorted(left)
            stack, seen, moved = [], 0, []  # classes below the sweep that are not used up, longest on top
            for gap in sorted(gaps):
                upto = bisect_right(sizes, gap)
                stack.extend(sizes[seen:upto])
                seen = upto
                runs, rest = gaps[gap], []
                for first, n in runs:
                    while n and stack:
                        length = stack[-1]
                        take = min(n, left[length])
                        out.append((length, next_rank[length], first, take, take))
                        next_rank[length] += take
                        left[length] -= take
                        moved.append((gap - length, first, take))
                        if not left[length]:
                            del left[length]
                            stack.pop()
                        first, n = first + take, n - take
                    if n:
                        rest.append((first, n))
                gaps[gap] = rest
            gaps = {gap: runs for gap, runs in gaps.items() if runs}
            if not moved:
                break
            for gap, first, n in moved:
                if gap > 0:
                    gaps.setdefault(gap, []).append((first, n))
    if counts.get(0):  # items without length fit everywhere: spread over the containers there are
        out.append((0, 1, 1, counts[0], max(bins, 1)))
    return out


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    counts = {int(a): int(b) for a, b in zip(pdf["piece_length"], pdf["n"])}
    rows = best_fit_rounds(int(pdf["capacity"].iloc[0]), counts)
    out = pd.DataFrame(rows, columns=["piece_length", "first_rank", "first_bin", "n", "wrap"])
    out.insert(0, "spec_id", int(pdf["spec_id"].iloc[0]))
    return out


def pack(items: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, item_id, piece_no, piece_length, container): every piece's container."""
    cut = pieces(items, specs)
    ranked = distributed_rank(cut, ["spec_id", "piece_length"], [F.col("item_id"), F.col("piece_no")], "rank")
    classes = ranked.groupBy("spec_id", "capacity", "piece_length").agg(F.count(F.lit(1)).alias("n"))
    schema = "spec_id int, piece_length int, first_rank bigint, first_bin bigint, n bigint, wrap bigint"
    matches = classes.groupBy("spec_id").applyInPandas(_match, schema)
    matches = staged(matches, "matches")
    if matches.count() <= BROADCAST_MATCHES:
        matches = F.broadcast(matches)
    m = matches.withColumnRenamed("spec_id", "__spec").withColumnRenamed("piece_length", "__length")
    inside = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    joined = ranked.join(m, (F.col("spec_id") == F.col("__spec")) & (F.col("piece_length") == F.col("__length")) & inside)
    container = F.col("first_bin") + (F.col("rank") - F.col("first_rank")) % F.col("wrap")
    return joined.select("spec_id", "capacity", "item_id", "length", "piece_no", "piece_length", container.alias("container"))


def oversized(packed: DataFrame) -> DataFrame:
    """(spec_id, item_id) of the items that had to be cut."""
    return packed.filter("length > capacity").select("spec_id", "item_id").distinct()


def fill_report(packed: DataFrame) -> DataFrame:
    """(spec_id, capacity, pieces, containers, fill): how full the containers are."""
    per = packed.groupBy("spec_id", "capacity", "container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("piece_length").alias("used"))
    return per.groupBy("spec_id", "capacity").agg(
        F.sum("pieces").alias("pieces"), F.count(F.lit(1)).alias("containers"), F.max("used").alias("most_used"),
        (F.sum("used") / (F.count(F.lit(1)) * F.first("capacity"))).alias("fill"),
    )
