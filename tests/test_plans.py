"""What the plans must and mustn't contain."""

import re

import pytest

from conftest import SMALL
from emberline.plans import registry

#: Queries whose plan has to bring every row to every other one: none.
PRODUCTS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if not n.startswith("st_")))
def test_no_products(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, SMALL))
    assert not any(x in plan.split("== Physical Plan ==")[-1] for x in PRODUCTS)


@pytest.mark.parametrize(
    "name,without",
    [("s_summary", ["prompt", "completion"]), ("t_entry_roles", ["prompt", "response"]), ("t_phase_map", ["prompt", "response"]), ("s_orders_by_nation", ["o_comment", "c_name", "c_acctbal"]), ("s_line_tally", ["l_shipdate", "l_quantity"]), ("fn_keys", ["response", "action"])],
)
def test_scans_read_only_what_is_needed(spark, name, without):
    schemas = re.findall(r"ReadSchema: (\S+)", plan_of(registry.QUERIES[name](spark, SMALL)))
    assert schemas
    for column in without:
        assert not any(re.search(rf"[<,]{column}:", s) for s in schemas)


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(o_custkey)]" in plan_of(registry.QUERIES["s_orders_by_nation"](spark, SMALL))


def test_windows_over_one_group_share_their_sort(spark):
    plan = plan_of(registry.QUERIES["e_prior_calls"](spark, SMALL)).split("== Physical Plan ==")[-1]
    assert plan.count("hashpartitioning(log_path") <= 1


def test_tallies_aggregate_before_the_shuffle(spark):
    plan = plan_of(registry.QUERIES["s_line_tally"](spark, SMALL)).split("== Physical Plan ==")[-1]
    assert "partial_count" in plan and "collect_list" not in plan


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if n.startswith("g_") or n in ("x_wolf_accusations", "x_role_claims", "x_half_majority", "t_ranked_match")))
def test_logs_are_read_once_and_payloads_stay_where_they_are(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, SMALL)).split("== Physical Plan ==")[-1]
    assert plan.count("game_log.parquet") <= 1
    assert "first(payload" not in plan and "first(events" not in plan


def test_staged_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from emberline.session import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None, set=None), sparkContext=SimpleNamespace(master="spark://driver:7077"))
    with pytest.raises(ValueError):
        shared_dir(cluster)


def test_small_tables_are_dealt_out_and_large_ones_stay(spark):
    from emberline.sources.tables import spread

    few, many = spark.range(100).coalesce(1), spark.range(100).repartition(64)
    assert spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert "REPARTITION_BY_NUM" in plan_of(spread(few, "id")) and spread(many, "id") is many
    assert sorted(r.id for r in spread(few, "id").collect()) == list(range(100))
