"""Watermarks over several files: late rows are reported, state is let go, players of any number are told apart."""

import datetime as dt

from pyspark.sql import functions as F

from emberline.plans import streams


def _write(spark, folder, name, frames):
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")


def test_late_rows_are_reported(spark, tmp_path, monkeypatch):
    day = dt.datetime(2025, 3, 1)
    rows = [[(1, day, "view", 1.0), (2, day + dt.timedelta(days=100), "view", 2.0)], [(3, day + dt.timedelta(days=101), "view", 4.0)], [(4, day, "click", 8.0)]]
    schema = "event_id bigint, ts timestamp_ntz, event_type string, value double"
    monkeypatch.setattr(streams.st.stream_of, "__defaults__", (1,))
    _write(spark, str(tmp_path), "events", [spark.createDataFrame(r, schema) for r in rows])
    report = streams.st_late_report(spark, str(tmp_path)).collect()[0]
    assert report.read == 4 and report.counted + report.late == 4
    assert streams.st_event_windows(spark, str(tmp_path)).agg(F.sum("events")).first()[0] == report.counted


def test_players_beyond_64(spark, tmp_path):
    at = dt.datetime(2025, 3, 1)
    rows = [(i, "g", p, "1_day_vote", at) for i, p in enumerate([1, 64, 65, 1000, 65, None])]
    spark.createDataFrame(rows, "trace_id bigint, game_path string, player_id int, phase string, logged_at timestamp_ntz").write.parquet(f"{tmp_path}/player_trace.parquet")
    out = streams.st_running_games(spark, str(tmp_path)).collect()
    assert [(r.traces, r.players, r.last_phase) for r in out] == [(6, 4, "1_day_vote")]
