"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.operators.nested import ROOT, child_items, flat_table, learn_plan, shred
from emberline.sources.game_text import AGENT_LOG, GAME_LOG, RESPONSE
from emberline.sources.tables import spread, table

_SOURCES = {"game_log": ("file_id", "payload", GAME_LOG), "agent_log": ("line_id", "record", AGENT_LOG), "player_trace": ("trace_id", "response", RESPONSE)}
#: Lists of the events' contents that are asked for, beside role_map and identity_labels.
CONTENT_LISTS = ["wolf_team", "dead_list", "speech_queue", "vote_queue"]


def rows_of(spark: SparkSession, sf_dir: str, name: str, *only: str) -> DataFrame:
    """The shredded rows of a source, of the tables ``only`` where any are given. Redelivered records give repeated rows."""
    key, text, reader = _SOURCES[name]
    return shred(spread(table(spark, sf_dir, name).select(key, text), key), key, text, reader, only=set(only) or None)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child items of all three sources. Only narrow rows are shuffled to remove redelivered ones."""
    none = F.lit(None).cast("string")
    lists = [f"{x}[]" for x in CONTENT_LISTS]
    games = child_items(rows_of(spark, sf_dir, "game_log", "content:god_view.#", "identity_labels.#", *lists))
    in_content = F.col("parent_table") == "events[]"
    name = (
        F.when(F.col("table") == "content:god_view.#", F.lit("role_map"))
        .when(F.col("table") == "identity_labels.#", F.lit("identity_labels"))
        .when(F.col("table").isin(lists), F.col("member"))
        .otherwise(none)
    )
    games = games.filter(in_content).select(F.lit("game_log").alias("tab"), "rec_id", "parent_no", name.alias("list_name"), "item_no", "item_text")
    traces = child_items(rows_of(spark, sf_dir, "player_trace", "identity_labels.#")).filter(F.col("table") == "identity_labels.#")
    traces = traces.select(F.lit("player_trace").alias("tab"), "rec_id", F.lit(0).alias("parent_no"), F.lit("identity_labels").alias("list_name"), "item_no", "item_text")
    agents = child_items(rows_of(spark, sf_dir, "agent_log", "Player Roster[]", "Action Repair Attempts[]")).filter(F.col("parent_table") == ROOT)
    repair = F.col("table") == "Action Repair Attempts[]"
    agents = agents.filter(repair | (F.col("table") == "Player Roster[]")).select(
        F.lit("agent_log").alias("tab"), "rec_id", F.lit(0).alias("parent_no"), F.when(repair, "repair").otherwise("roster").alias("list_name"),
        "item_no", F.when(repair, F.col("columns")["invalid_action"]).otherwise(F.col("item_text")).alias("item_text"),
    )
    out = games.unionByName(traces).unionByName(agents)
    return out.filter("list_name IS NOT NULL AND item_text IS NOT NULL").distinct()


def p3_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of events with the singletons of their contents inlined."""
    columns = {
        "event": "event", "day": "day", "time": "time", "source": "source", "target": "target", "speech_content": "content.speech_content",
        "vote_target": "content.vote_target", "vote_outcome": "content.vote_outcome", "expelled": "content.expelled", "kill_target": "content.kill_target",
        "kill_decision": "content.kill_decision", "protected": "content.protected", "checked_identity": "content.checked_identity", "heal": "content.heal",
        "poison": "content.poison", "pass": "content.pass", "shoot": "content.shoot", "outcome": "content.outcome",
    }
    flat = flat_table(rows_of(spark, sf_dir, "game_log", "events[]"), "events[]", columns)
    return flat.withColumnsRenamed({"rec_id": "file_id", "place": "event_no"}).drop("table", "parent_table", "row_key", "parent_key", "path", "item_text").distinct()


def p3_agent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of agent log records: player, prompt and response inlined."""
    i = "interaction."
    columns = {
        "game_index": "game_index", "step": "step", "type": "type", "timestamp": "timestamp", "player_name": "player.name", "player_identity": "player.identity",
        "player_model": "player.model", "player_location": "player.location", "prompt_phase": i + "prompt.Phase", "all_info": i + "prompt.All Info",
        "memory": i + "prompt.Memory", "speech_event_id": i + "prompt.Speech Event Id", "response_text": i + "response", "response_memory": i + "response.Condensed Memory",
        "response_thought": i + "response.Thinking Process.thought", "response_thinking": i + "response.Thinking Process", "response_action": i + "response.Action",
    }
    flat = flat_table(rows_of(spark, sf_dir, "agent_log", ROOT), ROOT, columns)
    return flat.withColumnRenamed("rec_id", "line_id").drop("table", "parent_table", "row_key", "parent_key", "path", "place", "item_text").distinct()


def p3_table_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, element, reason): the tables that the schema graphs call for."""
    rows = []
    for name, (key, text, reader) in _SOURCES.items():
        plan = learn_plan(table(spark, sf_dir, name).select(key, text), text, reader)
        rows += [(name, element, why) for element, why in sorted(plan.tables.items())]
    return spark.createDataFrame(rows, "tab string, element string, reason string")


QUERIES = {"p3_found": p3_found, "p3_events": p3_events, "p3_agent_records": p3_agent_records, "p3_table_plan": p3_table_plan}
