"""Reading raw logs and samples from files: one game per folder, many games per file, row-wise and columnar JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

def whole_texts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, text) of each file."""
    df = spark.read.text(paths, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def line_texts(spark: SparkSession, paths: list[str] | str, recursive: bool = False) -> DataFrame:
    """(path, text) of each line that isn't blank; large files are split among tasks."""
    df = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(paths)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(F.trim("text") != "")


def game_of(path: Column) -> Column:
    """The folder of a game's file."""
    return F.regexp_extract(path, r"^(?:file:)?/*(.*)/[^/]+$", 1)


def read_game_logs(spark: SparkSession, root: str, layout: str = "*/game_*", name: str = "game_log.json") -> DataFrame:
    """(game_path, matchup, seq, event) of log files, arrays of events; files that aren't are left out."""
    files = whole_texts(spark, f"{root}/{layout}/{name}")
    rows = files.select(game_of(F.col("path")).alias("game_path"), F.try_variant_get(F.try_parse_json("text"), "$", "array<variant>").alias("events"))
    rows = rows.select("game_path", F.posexplode("events").alias("pos", "event"))
    return rows.select("game_path", F.regexp_extract("game_path", r"(w-[^/]+_vs_v-[^/]+)", 1).alias("matchup"), (F.col("pos") + 1).alias("seq"), "event")


def read_player_traces(spark: SparkSession, root: str, layout: str = "*/game_*", name: str = "Player_*.jsonl", number: str = r"Player_(\d+)\.jsonl$") -> DataFrame:
    """(game_path, player_id, entry) of players' files; blank and malformed lines are skipped, the id comes from the path."""
    rows = line_texts(spark, f"{root}/{layout}/{name}").withColumn("entry", F.try_parse_json("text")).filter("entry IS NOT NULL")
    return rows.select(game_of(F.col("path")).alias("game_path"), F.regexp_extract("path", number, 1).try_cast("int").alias("player_id"), "entry")


def read_entries(spark: SparkSession, paths: list[str] | str, strict: bool = True, without: str | None = None, recursive: bool = False) -> DataFrame:
    """(log_path, entry) of JSON lines. Strict: a malformed line fails the job. ``without``: a folder name that excludes a path."""
    rows = line_texts(spark, paths, recursive)
    if without:
        rows = rows.filter(~F.array_contains(F.split("path", "/"), without))
    parse = F.parse_json if strict else F.try_parse_json
    out = rows.select(F.col("path").alias("log_path"), parse(F.col("text")).alias("entry"))
    return out if strict else out.filter("entry IS NOT NULL")


def read_records(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, record) of files that hold an array, one object, or a record per line; found out for each file."""
    files = whole_texts(spark, paths).withColumn("v", F.try_parse_json("text"))
    kept = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    lines = F.filter(F.transform(kept, F.try_parse_json), lambda x: x.isNotNull())
    by_line = F.try_parse_json(F.get(kept, F.lit(0))).isNotNull()  # parsing reads the first value only, so the whole text would pass as one object
    records = (
        F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).when(F.col("v").isNotNull() & ~by_line, F.array("v")).otherwise(lines)
    )
    return files.select("path", F.explode(records).alias("record"))


def first_games(df: DataFrame, n: int, path: str = "game_path") -> DataFrame:
    """The rows of the first ``n`` games by path, of those that could be read. Only the paths are sorted."""
    return df.join(df.select(path).distinct().orderBy(path).limit(n), path, "left_semi")


def is_speech_file(path: Column) -> Column:
    """Whether a file holds speech samples that nobody has verified yet."""
    name = F.element_at(F.split(path, "/"), -1)
    return name.rlike(r"speech") & name.rlike(r"\.jsonl?$") & ~name.rlike(r"^(?:reverify_|verified_)")


def read_summaries(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, game, winner, reason) of summary lines ``{"Game k": {...}}``; winners 1 and 4 are the impostors, 2 and 3 the crew."""
    rows = line_texts(spark, paths).withColumn("games", F.try_variant_get(F.try_parse_json("text"), "$", "map<string,variant>"))
    rows = rows.select("path", F.explode("games").alias("game", "g"))
    winner = F.try_variant_get("g", "$.winner", "int")
    return rows.select("path", "game", F.when(winner.isin(1, 4), "impostors").when(winner.isin(2, 3), "crew").alias("winner"), F.try_variant_get("g", "$.winner_reason", "string").alias("reason"))


def columns_to_rows(df: DataFrame, columns: list[str], short: str = "strict") -> DataFrame:
    """Parallel arrays as rows. ``short`` says what a shorter array gives: ``strict`` an error, ``pad`` nulls, ``repeat`` the whole array in each row."""
    size = F.size(F.col(columns[0]))
    if short == "strict":
        same = F.lit(True)
        for c in columns[1:]:
            same = same & (F.size(F.col(c)) == size)
        df = df.filter(F.when(same, True).otherwise(F.raise_error(F.lit("arrays of different lengths")).cast("boolean")))
    if short == "repeat":
        fixed = [F.when(F.size(F.col(c)) == size, F.lit(True)).otherwise(F.lit(False)).alias(f"__{c}") for c in columns]
        rows = df.select("*", *fixed, F.posexplode(F.sequence(F.lit(0), size - 1)).alias("__i", "__j"))
        item = lambda c: F.when(F.col(f"__{c}"), F.get(F.col(c), F.col("__i")).cast("string")).otherwise(F.to_json(F.col(c)))
        return rows.select(*[item(c).alias(c) for c in columns])
    return df.select(F.inline(F.arrays_zip(*columns)))


def read_parquets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several parquet data sets as one; missing columns are null."""
    out = spark.read.parquet(paths[0])
    for p in paths[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out


def or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A source that may be absent: its rows, or none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_phase_maps(spark: SparkSession, path: str) -> DataFrame:
    """(category, label, game_path, player_id, phase) of the maps that ``sinks.outputs.write_phase_maps`` writes."""
    maps = spark.read.schema("game_path string, players map<string,array<string>>, category string, label string").json(path)
    rows = maps.select("category", "label", "game_path", F.explode("players").alias("player", "phases"))
    return rows.select("category", "label", "game_path", F.col("player").cast("int").alias("player_id"), F.explode("phases").alias("phase"))


def read_companion_maps(spark: SparkSession, path: str) -> DataFrame:
    """(game_path, player_id, phase, value) of the maps that ``sinks.outputs.write_companion_maps`` writes."""
    maps = spark.read.schema("game_path string, players map<string,map<string,string>>").json(path)
    rows = maps.select("game_path", F.explode("players").alias("player", "values"))
    return rows.select("game_path", F.col("player").cast("int").alias("player_id"), F.explode("values").alias("phase", "value"))


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path) of the files below a folder, at any depth; their contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return df.select(F.regexp_replace("path", r"^file:/*", "/").alias("path"))


def resolve_logs(paths: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """(root, path): the log files called ``name`` of each root folder: its own, else those one level below, else all deeper ones.

    ``paths`` (path) is met with ``roots`` (root) on the folders above each path, so no root is compared with every path.
    """
    parts = F.split("path", "/")
    files = paths.filter(F.element_at(parts, -1) == name)
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("root"), (F.size(parts) - n).alias("depth")))
    found = files.select("path", F.inline(above)).join(roots.select("root").distinct(), "root").withColumn("level", F.least("depth", F.lit(3)))
    nearest = found.groupBy("root").agg(F.min("level").alias("level"))
    return found.join(nearest, ["root", "level"]).select("root", "path").distinct()


def game_dir(path: Column) -> Column:
    """The nearest folder ``game_*`` that a path is or lies in; null where there is none."""
    return F.nullif(F.regexp_extract(path, r"^((?:.*/)?game_[^/]+)(?:/.*)?$", 1), F.lit(""))


def sides(path: Column) -> Column:
    """``wolf``, ``good`` and ``self_play`` from the folder ``w-X_vs_v-Y`` of a path; a temperature behind a model's name isn't part of it."""
    name = lambda i: F.nullif(F.regexp_replace(F.regexp_extract(path, r"(?:^|/)w-([^/]+?)_vs_v-([^/]+)", i), r"_tmp[0-9.]+$", ""), F.lit(""))
    return F.struct(name(1).alias("wolf"), name(2).alias("good"), (name(1) == name(2)).alias("self_play"))
