"""Queries that run as streams over the tables' files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.sources.logs import with_sql
from emberline.sources.tables import table
from emberline.streaming import events as st


#: How far behind the newest row a row may come; state older than that is let go.
LATE = "30 days"


def st_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their value per hour and type."""
    out = st.finished(st.windowed_counts(st.stream_of(spark, sf_dir, "events"), "1 hour", LATE), "update", ["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.col("value").alias("value"))


def st_traces_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces per matchup, each counted once however often it was delivered."""
    rows = st.delivered_once(st.stream_of(spark, sf_dir, "player_trace").select("trace_id", "matchup", "ingested_at"), "trace_id", "ingested_at", LATE)
    return st.finished(rows.select("trace_id", "matchup"), "append").groupBy("matchup").agg(F.count(F.lit(1)).alias("traces"))


def st_running_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each game after all rows: rows, players, last phase."""
    rows = st.stream_of(spark, sf_dir, "player_trace").select("trace_id", "game_path", "player_id", "phase", "logged_at")
    return st.finished(st.running_games(rows), "update", ["game_path"], "traces")


def st_late_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read, rows in the hourly windows, and rows that came behind the watermark."""
    out = st.finished(st.windowed_counts(st.stream_of(spark, sf_dir, "events"), "1 hour", LATE), "update", ["start", "event_type"])
    read = table(spark, sf_dir, "events").select(F.count("ts").alias("read"))
    return read.withColumn("counted", out.agg(F.coalesce(F.sum("events"), F.lit(0))).scalar()).withColumn("late", F.lit(out.late_rows).cast("bigint"))


QUERIES = {f.__name__: f for f in (st_event_windows, st_traces_once, st_running_games, st_late_report)}
ORACLE = {
    "st_event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, sum(value) AS value FROM events GROUP BY ALL",
    "st_traces_once": with_sql("SELECT matchup, count(*) AS traces FROM traces GROUP BY ALL"),
    "st_late_report": "SELECT count(ts) AS read, count(ts) AS counted, 0::BIGINT AS late FROM events",
    "st_running_games": "SELECT game_path, count(*) AS traces, CAST(count(DISTINCT player_id) AS INT) AS players, coalesce(arg_max(struct_pack(p := phase), trace_id).p, '') AS last_phase FROM player_trace GROUP BY ALL",
}
