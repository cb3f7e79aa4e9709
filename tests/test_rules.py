"""Rules whose order or edge decides, on rows that tell the orders apart."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from emberline.functions import roles
from emberline.operators import matching
from emberline.plans.games import _ROLE_SQL

NAMES = {
    "Seer (formerly villager)": "Seer", "Villager-turned-Witch": "Witch", "狼人玩家": "Werewolf", "预言家9号": "Seer", "good person": "Villager", "Ordinary Villager": "Villager", "GoodPerson!": "Villager",
    " Guardian ": "Guard", "unknown role": "Unknown", "Werewolf or Seer": "Werewolf", "村民": "Villager", "w.o.l.f": "Werewolf", "prophet": None, "": None, "12": None, "Alpha wolf": None,
}


def test_role_names(spark):
    df = spark.createDataFrame([(k,) for k in NAMES], "n string")
    assert {r.n: r.r for r in df.select("n", roles.role(F.col("n")).alias("r")).collect()} == NAMES
    for name, want in NAMES.items():
        assert duckdb.execute("SELECT " + _ROLE_SQL.format("?::VARCHAR"), [name] * _ROLE_SQL.count("{0}")).fetchone()[0] == want


def test_numbers_match_within_their_own_game(spark):
    left = spark.createDataFrame([(1, "g1", "Player 2: plum", 2), (2, "g1", "Player 3", 3), (3, "g2", "Player 3", 3), (4, "g3", "x", None)], "id int, game string, name string, number int")
    right = spark.createDataFrame([("g1", "Player 2: plum", 2), ("g1", "Player 3: teal", 3), ("g2", "Player 3: ochre", 3), ("g2", "Player 3: coral", 3)], "game string, r string, n int")
    out = {r.id: r.match for r in matching.exact_or_unique(left, ["game"], "name", "number", right, "r", "n", "r").collect()}
    assert out == {1: "Player 2: plum", 2: "Player 3: teal", 3: None, 4: None}


def _tables(spark, folder, lines):
    rows = [(i, "log", "Game 1", json.dumps(x)) for i, x in enumerate(lines, 1)]
    spark.createDataFrame(rows, "line_id bigint, log_path string, game_index string, record string").withColumn("landed_at", F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00"))).write.parquet(f"{folder}/agent_log.parquet")


def _entry(step, roster, info="", identity="Impostor", system=""):
    return {
        "step": step, "timestamp": "t", "player": {"name": "Player 1: teal", "identity": identity},
        "interaction": {"system_prompt": system, "prompt": {"All Info": info, "Player Roster": [f"Player {i}: c" for i in roster]}, "response": "x"},
    }


def test_rule_fold(spark, tmp_path):
    from emberline.plans.entries import e_rule_fold

    kill = "Timestep 3: [task] Player 2: blue KILL Player 5: red\nTimestep 4: [task] Player 4 VENT"
    lines = [_entry(1, [1, 2, 3], system="Known Impostors: [Player 1: teal, Player 3: plum]"), _entry(2, [1, 2, 3], kill), _entry(3, [1, 3]), _entry(4, [1, 2, 3, 4], identity="Crewmate")]
    _tables(spark, str(tmp_path), lines)
    got = {}
    for r in e_rule_fold(spark, str(tmp_path)).collect():
        got.setdefault(r.line_id, {})[r.member] = r.role
    assert got == {
        1: {1: "Impostor", 2: "unknown", 3: "Impostor"}, 2: {1: "Impostor", 2: "Impostor", 3: "Impostor"}, 3: {1: "Impostor", 3: "Impostor"},
        4: {1: "Crewmate", 2: "unknown", 3: "Impostor", 4: "unknown"},
    }


def test_unchanged_players_count_with_zero(spark, tmp_path):
    from emberline.plans.entries import e_belief_shift

    def entry(step, name, belief):
        return {"step": step, "timestamp": "t", "player": {"name": name, "identity": "Crewmate"}, "interaction": {"prompt": {}, "response": {"Relational Belief": belief}}}

    lines = [
        entry(1, "Player 1: a", "- Player 2: Role=Impostor"), entry(2, "Player 1: a", "- Player 2: Role=Crewmate"),
        entry(1, "Player 2: b", "- Player 1: Role=Crewmate"), entry(2, "Player 2: b", "- Player 1: Role=Crewmate"),
    ]
    _tables(spark, str(tmp_path), lines)
    row = e_belief_shift(spark, str(tmp_path)).collect()
    assert [(r.mean_shift, r.better, r.worse, r.players) for r in row] == [(pytest.approx(0.5), 1, 0, 2)]
