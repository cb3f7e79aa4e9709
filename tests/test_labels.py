"""Speeches in prompts, facts, run-offs and chances on small rows."""

import json
import re

from pyspark.sql import functions as F

from conftest import SMALL
from emberline.functions import notes
from emberline.operators import sampling
from emberline.plans import labels


def test_speeches_by_wording(spark):
    texts = {
        1: "Board\n**Player 3**: I am the seer.\nSecond line\n**Player 12**：Player 3 is a wolf.\n\nYou are currently voting",
        2: "2 said at day 1: trust me 5 said at day 1: no\nPlease analyze",
        3: "- 5号玩家：先听一圈。\n* Player 2: Wait.\n- el jugador 7: Nada.\nYou are Player 1: teal",
        4: "", 5: None, 6: "**Player 3**:  \n\nYou are currently",
    }
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    got = {r.id: r.s for r in df.select("id", notes.speeches(F.col("t")).alias("s")).collect()}
    assert got[1] == {3: "I am the seer.\nSecond line", 12: "Player 3 is a wolf."}
    assert got[2] == {2: "trust me", 5: "no"}
    assert got[3] == {5: "先听一圈。", 2: "Wait.", 7: "Nada."}
    assert got[4] == {} and not got[5] and got[6] == {3: "You are currently"}  # blanks before a speech belong to none, so the closing words are taken for it


def test_speeches_of_whole_prompts(spark):
    """Listed speeches of the smallest table, against the same rule in Python."""
    rows = {r.trace_id: r.prompt for r in spark.read.parquet(f"{SMALL}/player_trace.parquet").select("trace_id", "prompt").collect()}
    want = set()
    for key, prompt in rows.items():
        if prompt and "said at" not in prompt and "**Player" not in prompt:
            said = {}
            for m in re.finditer(r"^[-*•]\s+[^\d\n:：]{0,20}(\d{1,4})[^\d\n:：]{0,6}[:：]\s*(\S.*)$", prompt, re.M):
                said[int(m.group(1))] = m.group(2).strip()
            want |= {(key, k) for k in said}
    assert {(r.trace_id, r.player) for r in labels.t_prompt_speeches(spark, SMALL).collect()} == want and want


def test_facts(spark):
    info = "Current Location: Galley\nPlayers in Galley: Player 1: teal, Player 2: ochre (dead)\n\nObservation history:\n1. Quiet.\n\nYour Assigned Tasks:\n1. Tune Antenna \nPath: a\n2. Sort Cargo [completed]\nPath: b\n\nAvailable actions:\n1. KILL x"
    said = {
        "I'm in the Cold Store right now.": "location", "I am at Galley right now.": "", "I finished Tune Antenna early.": "task", "I finished Sort Cargo early.": "", "Nobody died today.": "death",
        "I saw Player 3 vent.": "witness", "I am currently in the Dock and I completed the tune antenna job, no deaths.": "location,task,death", "I wait.": "",
    }
    from emberline.functions import text

    df = spark.createDataFrame([(k, info) for k in said], "s string, i string")
    out = df.select("s", F.array_join(notes.fact_conflicts(F.col("s"), F.col("i"), F.lit(""), text.tasks(F.col("i"))), ",").alias("c")).collect()
    assert {r.s: r.c for r in out} == said


def test_run_offs(spark, tmp_path):
    events = [("draw", None), ("x", 3), ("x", 4), ("draw", None), ("none", "no")]
    log = [{"event": "end_vote", "day": 1, "content": {"vote_outcome": o, **({} if e in (None, "no") else {"expelled": e})}} for o, e in events] + [{"event": "end_vote", "day": 2, "content": {"expelled": None}}]
    spark.createDataFrame([(1, "g", "m", json.dumps(log))], "file_id bigint, game_path string, matchup string, payload string").write.parquet(f"{tmp_path}/game_log.parquet")
    got = sorted((r.seq, r.phase, r.expelled) for r in labels.g_pk_rounds(spark, str(tmp_path)).collect())
    assert got == [(1, "1_day_vote", None), (2, "1_day_vote_pk", 3), (3, "1_day_vote", 4), (4, "1_day_vote", None), (6, "2_day_vote", None)]


def test_with_replacement(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(10)], "id bigint, k string")
    quotas = spark.createDataFrame([("a", 3, 8), ("b", 7, 2)], "k string, available bigint, quota bigint")
    out = sampling.with_replacement(df, quotas, ["k"], "id", "s")
    rows = out.collect()
    assert sum(r.k == "a" for r in rows) == 8 and sum(r.k == "b" for r in rows) == 2
    times = {}
    for r in rows:
        times[r.id] = times.get(r.id, 0) + 1
    assert sorted(v for k, v in times.items() if k < 3) == [2, 3, 3]
    report = {r.k: (r.requested, r.selected, r.missing) for r in sampling.sample_report(out, quotas, ["k"]).collect()}
    assert report == {"a": (8, 8, 0), "b": (2, 2, 0)}
