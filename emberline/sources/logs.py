"""The logs of both games as typed rows, JVM-side: texts are parsed to VARIANT, never to an inferred schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.session import staged
from emberline.sources.tables import table


def once(df: DataFrame, key: str) -> DataFrame:
    """A record counts once however often it was delivered; deliveries agree in all but the time of delivery."""
    return df.dropDuplicates([key])


def traces(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Distinct player traces; name the columns that are needed, so that texts that aren't stay out of the shuffle."""
    df = table(spark, sf_dir, "player_trace")
    return once(df.select("trace_id", *columns) if columns else df, "trace_id")


def samples(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = table(spark, sf_dir, "kto_dataset")
    return once(df.select("sample_id", *columns) if columns else df, "sample_id")


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(game_path, id, role, model), one row per player."""
    return table(spark, sf_dir, "role_model").groupBy("game_path", "id").agg(F.max("role").alias("role"), F.max("model").alias("model"))


def _is(kind: str, variant: Column) -> Column:
    return F.schema_of_variant(variant).startswith(kind)


def _event_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, game_path, matchup, events) of every delivery: the events of a readable file as an array of VARIANT, whatever its layout."""
    files = table(spark, sf_dir, "game_log").select("file_id", "game_path", "matchup", "payload")
    cut = F.filter(F.split("payload", "\n"), lambda x: F.trim(x) != "")
    by_line = _once(F.transform(cut, F.try_parse_json), lambda x: F.when((F.size(x) > 0) & ~F.exists(x, lambda y: y.isNull()), x))
    # a cast to the kind that is looked for tells kinds apart without the schema of the whole value
    array = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    events = _once(F.try_parse_json(F.col("payload")), lambda v: F.coalesce(array(v, "$"), array(v, "$.game_log"), by_line))
    return files.select("file_id", "game_path", "matchup", events.alias("events"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used: a lambda's variable isn't inlined."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def game_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, game_path, matchup, n_events) of each readable file; payloads are read in place, not shuffled."""
    return once(_event_lists(spark, sf_dir).select("file_id", "game_path", "matchup", F.size("events").alias("n_events")).filter("n_events >= 0"), "file_id")


def game_events(spark: SparkSession, sf_dir: str, *kinds: str, bare: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, game_path, matchup, seq, event, day, source, target, time, content): one row per event, of the ``kinds`` where any are named.

    Files are taken apart where they are read; what is shuffled, to count redelivered files once, are these narrow rows.
    ``target`` is the single target (null for a list or none); ``content`` is VARIANT, also where the file holds its text, and
    null for the kinds in ``bare``, whose content isn't asked for.
    """
    rows = _event_lists(spark, sf_dir).select("file_id", "game_path", "matchup", F.posexplode_outer("events").alias("pos", "e"))
    rows = rows.withColumn("event", F.try_variant_get(F.col("e"), "$.event", "string"))
    # an outer explode, so that no condition on the list, with all that it takes to make it, is put before it
    rows = rows.filter(F.col("event").isin(*kinds) if kinds else F.col("pos").isNotNull())
    text = F.try_variant_get(F.col("e"), "$.content", "string")
    content = F.try_variant_get(F.col("e"), "$.content", "variant")
    is_object = F.try_variant_get(F.col("e"), "$.content", "map<string,variant>").isNotNull()
    content = F.when(is_object, content).otherwise(F.try_parse_json(text))
    if bare:
        content = F.when(~F.col("event").isin(*bare), content)
    target = F.try_variant_get(F.col("e"), "$.target", "variant")
    rows = rows.select(
        "file_id", "game_path", "matchup", (F.col("pos") + 1).alias("seq"), "event", F.try_variant_get(F.col("e"), "$.day", "int").alias("day"),
        F.try_variant_get(F.col("e"), "$.source", "int").alias("source"), F.when(_is("BIGINT", target), F.try_variant_get(F.col("e"), "$.target", "int")).alias("target"),
        F.try_variant_get(F.col("e"), "$.time", "string").alias("time"), content.alias("content"),
    )
    return rows.dropDuplicates(["file_id", "seq"])


def staged_events(spark: SparkSession, sf_dir: str, *kinds: str, bare: tuple[str, ...] = ()) -> DataFrame:
    """The same, written once to the shared folder, for queries that look at the events several times."""
    return staged(game_events(spark, sf_dir, *kinds, bare=bare).drop("game_path"), "events")


def content_of(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("content"), f"$.{path}", kind)


def agent_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per readable line of the task/meeting game, prompt and response as VARIANT, ``ord`` the place in the file."""
    lines = once(table(spark, sf_dir, "agent_log").select("line_id", "log_path", "game_index", "record"), "line_id")
    rows = lines.withColumn("r", F.try_parse_json("record")).filter(F.col("r").isNotNull())
    g = lambda path, kind="string": F.try_variant_get(F.col("r"), path, kind)
    prompt = g("$.interaction.prompt", "variant")
    prompt = F.when(_is("STRING", prompt), F.try_parse_json(g("$.interaction.prompt"))).otherwise(prompt)
    name = g("$.player.name")
    return rows.select(
        "line_id", "log_path", F.coalesce(g("$.game_index"), F.col("game_index")).alias("game"), g("$.step", "int").alias("step"), g("$.type").alias("type"),
        g("$.timestamp").alias("ts"), name.alias("player"), F.nullif(F.regexp_extract(name, r"(\d+)", 1), F.lit("")).cast("int").alias("player_no"),
        g("$.player.identity").alias("identity"), g("$.player.model").alias("model"), g("$.player.location").alias("location"), prompt.alias("prompt"),
        g("$.interaction.response", "variant").alias("response"), g("$.interaction.full_response").alias("full_response"), g("$.interaction.system_prompt").alias("system_prompt"),
    )


def prompt_of(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("prompt"), f"$['{path}']", kind)


def response_of(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("response"), f"$['{path}']", kind)


#: The same rows in DuckDB, as common table expressions.
SQL = r"""
traces AS (SELECT DISTINCT ON (trace_id) * FROM player_trace ORDER BY trace_id, ingested_at),
samples AS (SELECT DISTINCT ON (sample_id) * FROM kto_dataset ORDER BY sample_id, exported_at),
roles AS (SELECT game_path, id, max(role) AS role, max(model) AS model FROM role_model GROUP BY ALL),
files AS (SELECT DISTINCT ON (file_id) file_id, game_path, matchup, payload FROM game_log ORDER BY file_id, landed_at),
file_lists AS (SELECT file_id, game_path, matchup, CASE
    WHEN json_valid(payload) AND json_type(payload) = 'ARRAY' THEN json_extract(payload, '$[*]')
    WHEN json_valid(payload) AND json_type(payload, '$.game_log') = 'ARRAY' THEN json_extract(payload, '$.game_log[*]')
    WHEN len(list_filter(string_split(payload, chr(10)), lambda x: trim(x) <> '')) > 0
     AND len(list_filter(string_split(payload, chr(10)), lambda x: trim(x) <> '' AND NOT json_valid(x))) = 0
    THEN list_transform(list_filter(string_split(payload, chr(10)), lambda x: trim(x) <> ''), lambda x: x::JSON) END AS events FROM files),
game_raw AS (SELECT file_id, game_path, matchup, unnest(events) AS e, generate_subscripts(events, 1) AS seq FROM file_lists WHERE events IS NOT NULL),
game_events AS (SELECT file_id, game_path, matchup, CAST(seq AS INT) AS seq, e ->> '$.event' AS event, TRY_CAST(e ->> '$.day' AS INT) AS day, TRY_CAST(e ->> '$.source' AS INT) AS source,
    CASE WHEN json_type(e, '$.target') IN ('BIGINT', 'UBIGINT') THEN CAST(e ->> '$.target' AS INT) END AS target, e ->> '$.time' AS time,
    CASE WHEN json_type(e, '$.content') = 'VARCHAR' THEN (CASE WHEN json_valid(e ->> '$.content') THEN (e ->> '$.content')::JSON END) ELSE json_extract(e, '$.content') END AS content
  FROM game_raw),
lines AS (SELECT DISTINCT ON (line_id) line_id, log_path, game_index, record FROM agent_log ORDER BY line_id, landed_at),
entries AS (SELECT line_id, log_path, coalesce(record ->> '$.game_index', game_index) AS game, CAST(record ->> '$.step' AS INT) AS step, record ->> '$.type' AS type,
    record ->> '$.timestamp' AS ts, record ->> '$.player.name' AS player, TRY_CAST(nullif(regexp_extract(record ->> '$.player.name', '(\d+)', 1), '') AS INT) AS player_no,
    record ->> '$.player.identity' AS identity, record ->> '$.player.model' AS model, record ->> '$.player.location' AS location,
    CASE WHEN json_type(record, '$.interaction.prompt') = 'VARCHAR' THEN (CASE WHEN json_valid(record ->> '$.interaction.prompt') THEN (record ->> '$.interaction.prompt')::JSON END)
      ELSE json_extract(record, '$.interaction.prompt') END AS prompt,
    json_extract(record, '$.interaction.response') AS response, record ->> '$.interaction.full_response' AS full_response, record ->> '$.interaction.system_prompt' AS system_prompt
  FROM lines WHERE json_valid(record))
"""


def with_sql(*parts: str) -> str:
    """A query over the tables of ``SQL``: further table expressions, then the final SELECT."""
    *tables, final = parts
    return "WITH " + ",\n".join([SQL.strip(), *tables]) + "\n" + final
