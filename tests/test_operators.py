import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.functions import phases, roles, text
from emberline.operators import matching, ordered, sampling, votes
from emberline.operators.ranking import distributed_rank


def test_rank_equals_a_window_on_skewed_keys(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o int, id int").repartition(7)
    got = {r.id: r.rank for r in distributed_rank(df, ["k"], [F.col("o"), F.col("id")], partitions=9).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            want[r[2]] = n
    assert got == want


def test_rank_of_nothing_and_without_keys(spark):
    empty = spark.createDataFrame([], "k string, id int")
    assert distributed_rank(empty, ["k"], [F.col("id")]).count() == 0
    df = spark.range(100)
    assert sorted(r.rank for r in distributed_rank(df, [], [F.desc("id")]).collect()) == list(range(1, 101))


def test_latest_before_is_strict(spark):
    df = spark.createDataFrame([("g", 1, "a"), ("g", 2, None), ("g", 3, "b"), ("h", 1, None)], "g string, t int, v string")
    got = {(r.g, r.t): r.b for r in ordered.latest_before(df, ["g"], ["t"], F.col("v"), "b").collect()}
    assert got == {("g", 1): None, ("g", 2): "a", ("g", 3): "a", ("h", 1): None}


def test_prior_count_leaves_peers_out(spark):
    df = spark.createDataFrame([("g", 1, True), ("g", 1, True), ("g", 2, None), ("g", 2, True), ("g", 3, False)], "g string, t int, p boolean")
    got = sorted((r.t, r.n) for r in ordered.prior_count(df, ["g"], ["t"], F.col("p"), "n").collect())
    assert got == [(1, 0), (1, 0), (2, 2), (2, 2), (3, 3)]


def test_plurality_and_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", None)], "k string, c int")
    got = {r.k: (r.top_votes, r.tied, r.winner) for r in votes.plurality(votes.tally(df, ["k"], "c"), ["k"], "c").collect()}
    assert got == {"a": (2, 1, 1), "b": (1, 2, None)}


def test_consistent_is_null_on_conflict(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("a", "x"), ("b", "x"), ("b", "y"), ("c", None)], "k string, v string")
    assert {r.k: r.o for r in votes.consistent(df, ["k"], "v", "o").collect()} == {"a": "x", "b": None, "c": None}


def test_combine_labels_table(spark):
    df = spark.createDataFrame([(a, b) for a in (True, False, None) for b in (True, False, None)], "low boolean, out boolean")
    got = {(r.low, r.out): r.x for r in df.withColumn("x", matching.combine_labels(F.col("low"), F.col("out"))).collect()}
    assert got == {(True, True): True, (True, False): True, (True, None): None, (False, True): False, (False, False): False, (False, None): None, (None, True): True, (None, False): None, (None, None): None}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(weights=st.lists(st.integers(1, 50), min_size=1, max_size=7), total=st.integers(0, 200))
def test_largest_remainder_sums_to_the_total(spark, weights, total):
    df = spark.createDataFrame([(f"b{i}", float(w)) for i, w in enumerate(weights)], "name string, w double")
    rows = sampling.largest_remainder(df, F.lit(total), "w", "name").collect()
    assert sum(r.quota for r in rows) == total
    assert all(abs(r.quota - r.w / sum(weights) * total) < 1 + 1e-6 for r in rows)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("b", (F.col("id") % 3).cast("string"))
    q = spark.createDataFrame([("0", 5), ("1", 500), ("2", 0)], "b string, quota bigint")
    one = sorted(r.id for r in sampling.quota_sample(df.repartition(1), q, ["b"], "id", "s").collect())
    many = sorted(r.id for r in sampling.quota_sample(df.repartition(13), q, ["b"], "id", "s").collect())
    assert one == many and len(one) == 5 + 167


def test_copies(spark):
    df = spark.range(300)
    rows = sampling.keep_or_copy(df, "s", "id", F.lit(1.0), F.lit(2.0)).groupBy("id").count().collect()
    assert len(rows) == 300 and all(r["count"] == 3 for r in rows)
    assert sampling.keep_or_copy(df, "s", "id", F.lit(0.0), F.lit(2.0)).count() == 0


@pytest.mark.parametrize("said,want", [("村民", "Villager"), (" SEER ", "Seer"), ("the werewolf?", "Werewolf"), ("Unknown role", "Unknown"), ("", None), (None, None), ("xyz", None)])
def test_roles(spark, said, want):
    assert spark.createDataFrame([(said,)], "r string").select(roles.role(F.col("r")).alias("x")).first().x == want


@pytest.mark.parametrize(
    "said,first,digits,target,zero",
    [("3", 3, 3, 3, 3), ("Player 12", 12, 12, 12, 12), ("1 and 2", 1, 12, 1, 1), ("0", 0, 0, None, 0), ("none", None, None, None, 0), (None, None, None, None, None), ("-1", 1, 1, None, 0)],
)
def test_targets(spark, said, first, digits, target, zero):
    c = F.col("t")
    row = spark.createDataFrame([(said,)], "t string").select(text.first_number(c).alias("a"), text.all_digits(c).alias("b"), text.target_number(c).alias("c"), text.target_or_zero(c).alias("d")).first()
    assert tuple(row) == (first, digits, target, zero)


def test_literals_and_balanced_objects(spark):
    df = spark.createDataFrame([("{'vote': '3'}",), ('{"vote": "4"}',), ("{'it''s': \"o'k\"}",), ("no",), (None,)], "t string")
    got = [r.x for r in df.select(F.try_variant_get(text.object_of(F.col("t")), "$.vote", "string").alias("x")).collect()]
    assert got == ["3", "4", None, None, None]
    df = spark.createDataFrame([('a {"x": "}"} b',), ("{bad {\"y\": 1}",), ("none",), ("```json\n{\"z\": 2}\n```",)], "t string")
    assert [r.x for r in df.select(text.balanced_object("t").alias("x")).collect()] == ['{"x": "}"}', '{"y": 1}', None, '{"z": 2}']


def test_phase_parts(spark):
    p = F.col("p")
    df = spark.createDataFrame([("2_day_vote_pk",), ("0_night_skill_wolf",), ("x",), (None,)], "p string")
    got = [tuple(r) for r in df.select(phases.phase_day(p), phases.phase_time(p), phases.sample_type(p), phases.is_pk(p)).collect()]
    assert got == [(2, "day", "vote", True), (0, "night", "action", False), (None, None, None, False), (None, None, None, None)]


def test_unions(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, p string"), spark.createDataFrame([(2, None, "y")], "i int, p string, q string")
    assert sorted(map(tuple, matching.union_filling([a, b]).collect())) == [(1, "x", ""), (2, "", "y")]
    assert matching.union_common([a, b]).columns == ["i", "p"]


def test_best_match_prefers_the_first_strategy(spark):
    left = spark.createDataFrame([("k1", 1, "x"), ("k2", 1, "z"), ("k3", 9, "z")], "key string, a int, b string")
    right = spark.createDataFrame([(1, "y", 10), (1, "x", 20), (1, "y", 5)], "a int, b string, v int")
    out = matching.best_match(left, "key", [(right, ["b"], 1), (right, ["a"], 2)], "v", "v")
    assert {r.key: (r.match, r.strategy) for r in out.collect()} == {"k1": (20, 1), "k2": (5, 2), "k3": (None, None)}
