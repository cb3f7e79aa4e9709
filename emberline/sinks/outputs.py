"""Writing samples and maps. All writes are distributed; nothing passes through the driver."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from emberline.functions.phases import phase_day


def phase_map(df: DataFrame) -> DataFrame:
    """(category, label, game_path, players): per game the phases of each player, without repeats, by day and name."""
    day = F.coalesce(phase_day(F.col("phase")), F.lit(1 << 30))
    per = df.groupBy("category", "label", "game_path", "player_id").agg(F.array_sort(F.collect_set(F.struct(day.alias("d"), F.col("phase").alias("p")))).alias("l"))
    per = per.select("category", "label", "game_path", "player_id", F.transform("l", lambda x: x["p"]).alias("phases"))
    entries = F.array_sort(F.collect_list(F.struct("player_id", "phases")))
    games = per.groupBy("category", "label", "game_path").agg(entries.alias("e"))
    return games.select("category", "label", "game_path", F.map_from_entries(F.transform("e", lambda x: F.struct(x["player_id"].cast("string"), x["phases"]))).alias("players"))


def write_phase_maps(df: DataFrame, path: str) -> None:
    """A folder per category and label with a JSON record per game."""
    phase_map(df).write.mode("overwrite").partitionBy("category", "label").json(path)


def write_companion_maps(df: DataFrame, path: str, value: str, order: str) -> None:
    """A JSON record per game: player -> phase -> value; of several values of a phase the last by ``order`` wins. A game's players are few."""
    last = df.groupBy("game_path", "player_id", "phase").agg(F.max_by(F.col(value).cast("string"), order).alias("v"))
    per = last.groupBy("game_path", "player_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "v")))).alias("m"))
    games = per.groupBy("game_path").agg(F.collect_list(F.struct(F.col("player_id").cast("string").alias("k"), F.col("m").alias("v"))).alias("e"))
    games.select("game_path", F.map_from_entries("e").alias("players")).write.mode("overwrite").json(path)


def write_rows(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet; refuses a target that exists unless told to overwrite."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_columnar(df: DataFrame, path: str, key: str, rows_per_record: int = 10_000) -> None:
    """JSON records of parallel arrays, each of at most ``rows_per_record`` rows, so that no task holds all rows."""
    blocks = df.withColumn("__block", F.floor(F.monotonically_increasing_id() / rows_per_record))
    arrays = [F.col(f"l.{c}").alias(c) for c in df.columns]
    rows = blocks.groupBy("__block").agg(F.sort_array(F.collect_list(F.struct(key, *[c for c in df.columns if c != key]))).alias("l"))
    rows.select(*arrays).write.mode("overwrite").json(path)


def model_family(model: str) -> str:
    """A model's family as a path component: lower case, without size, safe characters only."""
    name = re.sub(r"[-_]?\d+(\.\d+)?b?$", "", model.lower())
    return re.sub(r"[^a-z0-9]+", "_", name).strip("_") or "unknown"


def scoped_path(base: str, models: list[str]) -> str:
    """``base`` with the families of the models, in order and without repeats."""
    families = sorted({model_family(m) for m in models})
    return f"{base.rstrip('/')}/{'+'.join(families) or 'all_models'}"
