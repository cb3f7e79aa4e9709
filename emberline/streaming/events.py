"""Structured Streaming over the same sources: windows with watermarks, delivery once, and state per game."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from emberline.session import remove_at_exit, shared_dir, tune


def stream_of(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """A table's files as a stream; the schema is that of the files that are there."""
    tune(spark)
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(_folder(path))


def _folder(path: str) -> str:
    import os

    return path if os.path.isdir(path) else path.replace(".parquet", ".parquet*")


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "3 days") -> DataFrame:
    """(window start, event_type, events, value) over tumbling windows; rows later than ``late`` are dropped with their state."""
    ts = F.col("ts").cast("timestamp")
    w = events.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")


def delivered_once(rows: DataFrame, key: str, delivered: str, within: str = "30 days") -> DataFrame:
    """Redelivered rows dropped while their key's state is kept."""
    ts = rows.withColumn(delivered, F.col(delivered).cast("timestamp")).withWatermark(delivered, within)
    return ts.dropDuplicatesWithinWatermark([key])


def running_games(traces: DataFrame, at: str = "logged_at", late: str = "30 days", idle_days: int = 90) -> DataFrame:
    """(game_path, traces, players, last_phase) after each batch in which a game got rows: state kept per game.

    A game's state is dropped once the watermark is ``idle_days`` past its last row.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, seen, last, latest, newest = state.get if state.exists else (0, "", "", 0, 0)
        players = set(filter(None, seen.split(",")))
        for f in frames:
            n += len(f)
            players.update(str(int(p)) for p in f["player_id"].dropna())
            newest = max(newest, int(f[at].max().timestamp() * 1000) if f[at].notna().any() else 0)
            f = f.sort_values("trace_id")
            if len(f) and int(f["trace_id"].iloc[-1]) >= latest:
                latest, last = int(f["trace_id"].iloc[-1]), f["phase"].iloc[-1] or ""
        state.update((n, ",".join(sorted(players)), last, latest, newest))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_days * 86_400_000)
        yield pd.DataFrame({"game_path": [key[0]], "traces": [n], "players": [len(players)], "last_phase": [last]})

    rows = traces.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.select("game_path", "player_id", "phase", "trace_id", at).groupBy("game_path").applyInPandasWithState(
        update, "game_path string, traces bigint, players int, last_phase string", "n bigint, players string, last string, latest bigint, newest bigint", "update", GroupStateTimeout.EventTimeTimeout
    )


def finished(stream: DataFrame, mode: str, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Run a stream over what is there and give its result as a table in the shared folder.

    Complete results replace each other; of updates the last one per key counts. ``late_rows`` of the result tells how many
    rows came behind the watermark and are in no result.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    remove_at_exit(spark, base)
    schema = StructType([*stream.schema.fields, StructField("__batch", IntegerType())])

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/rows")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    late = sum(int(o["numRowsDroppedByWatermark"]) for p in q.recentProgress for o in p["stateOperators"])
    rows = spark.read.schema(schema).parquet(f"{base}/rows")
    if keys:
        rest = [c for c in rows.columns if c not in keys and c != "__batch"]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__batch", *([order] if order else []))).alias("v")).select(*keys, "v.*")
    else:
        rows = rows.drop("__batch")
    rows.late_rows = late
    return rows
