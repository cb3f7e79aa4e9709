"""Queries of scalar functions over the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.functions import phases, render, roles, text
from emberline.sources import logs
from emberline.sources.tables import table


def fn_phase_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("phase")
    return logs.traces(spark, sf_dir, "phase").select(
        "trace_id", phases.phase_day(p).alias("day"), phases.phase_time(p).alias("time_of_day"), phases.sample_type(p).alias("sample_type"), phases.is_pk(p).alias("pk"),
        phases.training_group(p, phases.GROUPS_BY_ACTION, "other").alias("group_a"), phases.training_group(p, phases.GROUPS_BY_SPEECH, "other").alias("group_b"),
        phases.training_group(p, phases.GROUPS_BY_MEETING, "other").alias("group_c"),
    )


def _group_sql(order: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(phase), '{a}') THEN '{b}'" for a, b in order) + " ELSE 'other' END"


SQL_PHASE = f"""SELECT trace_id, TRY_CAST(split_part(phase, '_', 1) AS INT) AS day, CASE WHEN contains(phase, '_day_') THEN 'day' WHEN contains(phase, '_night_') THEN 'night' END AS time_of_day,
  CASE WHEN contains(phase, '_day_speech') THEN 'speech' WHEN contains(phase, '_day_vote') THEN 'vote' WHEN contains(phase, 'night_skill') THEN 'action'
    WHEN contains(phase, 'state_reconstruction') THEN 'state_recon' END AS sample_type, ends_with(phase, '_pk') AS pk,
  {_group_sql(phases.GROUPS_BY_ACTION)} AS group_a, {_group_sql(phases.GROUPS_BY_SPEECH)} AS group_b, {_group_sql(phases.GROUPS_BY_MEETING)} AS group_c FROM traces"""


def fn_role_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.traces(spark, sf_dir, "role").select(F.lit("trace").alias("tab"), "role")
    rows = rows.unionAll(table(spark, sf_dir, "role_model").select(F.lit("roster"), "role"))
    r = roles.role(F.col("role"))
    return rows.groupBy("tab", "role").agg(F.count(F.lit(1)).alias("n")).select(
        "tab", "role", r.alias("role_name"), roles.camp(r).alias("camp"), roles.binary_role(F.col("role")).alias("binary_role"), "n"
    )


_VALUES = lambda d: ", ".join(f"('{k}', '{v}')" for k, v in d.items())
SQL_ROLE = f"""rows_ AS (SELECT 'trace' AS tab, role FROM traces UNION ALL SELECT 'roster', role FROM role_model),
counted AS (SELECT tab, role, count(*) AS n FROM rows_ GROUP BY ALL),
zh(k, v) AS (VALUES {_VALUES(roles.CHINESE)}), al(k, v) AS (VALUES {_VALUES(roles.ALIASES)}),
named AS (SELECT tab, role, n, coalesce((SELECT v FROM zh WHERE k = trim(role)), (SELECT v FROM al WHERE k = lower(trim(role))),
  CASE WHEN starts_with(lower(trim(role)), 'unknown') THEN 'Unknown' END,
  CASE {' '.join(f"WHEN contains(lower(trim(role)), '{a}') THEN '{b}'" for a, b in roles.PARTS)} END,
  (SELECT v FROM al WHERE k = regexp_replace(lower(trim(role)), '[^a-z]', '', 'g'))) AS role_name FROM counted)"""
SQL_ROLE_END = """SELECT tab, role, role_name, CASE WHEN role_name = 'Werewolf' THEN 'wolf' WHEN role_name IN ('Villager','Seer','Witch','Guard','Hunter') THEN 'good' END AS camp,
  CASE lower(trim(role)) WHEN 'crewmate' THEN 'Crewmate' WHEN 'impostor' THEN 'Impostor' ELSE 'unknown' END AS binary_role, n FROM named"""


def fn_action_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions as JSON or Python literals, and the readings of their target."""
    rows = logs.traces(spark, sf_dir, "action", "gen_times").filter("action IS NOT NULL").withColumn("v", text.object_of(F.col("action")))
    keys = ["vote", "kill", "check", "guard", "heal", "poison", "shoot", "target"]
    said = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "string") for k in keys])
    rows = rows.withColumn("said", said)
    return rows.select(
        "trace_id", F.col("v").isNotNull().alias("readable"), "said", text.first_number(F.col("said")).alias("first_number"), text.all_digits(F.col("said")).alias("all_digits"),
        text.target_number(F.col("said")).alias("target"), text.target_or_zero(F.col("said")).alias("target_or_zero"),
        F.coalesce(F.col("gen_times") <= 3, F.lit(True)).alias("few_tries"),
    )


SQL_ACTION = r"""acts AS (SELECT trace_id, gen_times, action, regexp_extract(action, '^\s*\{\s*[''"](?:vote|kill|check|guard|heal|poison|shoot|target)[''"]\s*:\s*[''"]?([^''"}]*)[''"]?\s*\}\s*$', 1) AS v,
  regexp_matches(action, '^\s*\{.*\}\s*$') AS readable FROM traces WHERE action IS NOT NULL),
said AS (SELECT *, CASE WHEN regexp_matches(action, '^\s*\{\s*[''"](?:vote|kill|check|guard|heal|poison|shoot|target)[''"]') AND v <> 'null' AND v <> 'None' THEN v END AS said FROM acts)"""
SQL_ACTION_END = r"""SELECT trace_id, readable, said, TRY_CAST(nullif(regexp_extract(said, '(\d+)', 1), '') AS INT) AS first_number,
  TRY_CAST(nullif(regexp_replace(said, '[^0-9]', '', 'g'), '') AS BIGINT) AS all_digits,
  CASE WHEN lower(trim(said)) NOT IN ('', '0', '-1', 'none', 'null', 'pass', 'abstain', 'no one', 'nobody') THEN TRY_CAST(nullif(regexp_extract(said, '(\d+)', 1), '') AS INT) END AS target,
  CASE WHEN said IS NULL THEN NULL WHEN lower(trim(said)) IN ('', '0', '-1', 'none', 'null', 'pass', 'abstain', 'no one', 'nobody') THEN 0
    ELSE TRY_CAST(nullif(regexp_extract(said, '(\d+)', 1), '') AS INT) END AS target_or_zero, coalesce(gen_times <= 3, true) AS few_tries FROM said"""


def fn_fenced_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses read as JSON, bare or fenced; the votes and labels in them."""
    rows = logs.traces(spark, sf_dir, "response").withColumn("v", text.json_or_fence(F.col("response")))
    vote = F.coalesce(*[F.try_variant_get("v", f"$['{k}']", "string") for k in ("voting player", "voting_player", "Vote", "vote")])
    night = F.coalesce(*[F.try_variant_get("v", f"$['{k}']", "string") for k in ("kill", "check", "poison", "heal", "protected_player", "guard", "shoot", "target")])
    return rows.select(
        "trace_id", F.schema_of_variant("v").startswith("OBJECT").alias("is_object"), text.target_or_zero(vote).alias("vote"), text.target_or_zero(night).alias("night_target"),
        F.try_variant_get("v", "$['Identity to Present']", "string").alias("identity"), F.length(F.try_variant_get("v", "$.Speech", "string")).alias("speech_chars"),
    )


_ZERO = "CASE WHEN {0} IS NULL THEN NULL WHEN lower(trim({0})) IN ('', '0', '-1', 'none', 'null', 'pass', 'abstain', 'no one', 'nobody') THEN 0 ELSE TRY_CAST(nullif(regexp_extract({0}, '(\\d+)', 1), '') AS INT) END"
SQL_FENCED = r"""inner_ AS (SELECT trace_id, response, regexp_extract(response, '(?is)```(?:json)?\s*(.*?)\s*```', 1) AS f FROM traces),
parsed AS (SELECT trace_id, CASE WHEN json_valid(response) THEN response::JSON WHEN f <> '' AND json_valid(f) THEN f::JSON END AS v FROM inner_),
got AS (SELECT trace_id, v, coalesce(v ->> '$."voting player"', v ->> '$.voting_player', v ->> '$.Vote', v ->> '$.vote') AS vote,
  coalesce(v ->> '$.kill', v ->> '$.check', v ->> '$.poison', v ->> '$.heal', v ->> '$.protected_player', v ->> '$.guard', v ->> '$.shoot', v ->> '$.target') AS night FROM parsed)"""
SQL_FENCED_END = f"""SELECT trace_id, json_type(v) = 'OBJECT' AS is_object, {_ZERO.format('vote')} AS vote, {_ZERO.format('night')} AS night_target,
  v ->> '$."Identity to Present"' AS identity, length(v ->> '$.Speech') AS speech_chars FROM got"""


def fn_message_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity, text and turn records of the messages of each sample."""
    both = F.concat(F.coalesce("prompt", F.array()), F.coalesce("completion", F.array()))
    s = logs.samples(spark, sf_dir, "prompt", "completion", "label", "source_model", "role_label")
    return s.select(
        "sample_id", text.valid_messages(F.col("prompt")).alias("prompt_valid"), text.valid_messages(F.col("completion")).alias("completion_valid"),
        F.md5(text.message_text(both)).alias("text_md5"), F.size(F.filter(both, lambda m: m["role"] == "assistant")).alias("assistant_turns"),
        F.coalesce(F.col("label").cast("int"), F.lit(-1)).alias("label_or_unknown"), F.lower(F.regexp_replace("source_model", "-[0-9]+b$", "")).alias("model_family"),
        F.cardinality("role_label").alias("n_roles"),
    )


SQL_MESSAGES = r"""SELECT sample_id,
  coalesce(len(prompt) > 0 AND len(list_filter(prompt, lambda m: m.role IS NULL OR m.content IS NULL OR trim(m.content, ' ') = '')) = 0, false) AS prompt_valid,
  coalesce(len(completion) > 0 AND len(list_filter(completion, lambda m: m.role IS NULL OR m.content IS NULL OR trim(m.content, ' ') = '')) = 0, false) AS completion_valid,
  md5(array_to_string(list_transform(list_filter(list_concat(prompt, completion), lambda m: m.content IS NOT NULL), lambda m: m.content), chr(10))) AS text_md5,
  len(list_filter(list_concat(coalesce(prompt, []), coalesce(completion, [])), lambda m: m.role = 'assistant')) AS assistant_turns,
  coalesce(CAST(label AS INT), -1) AS label_or_unknown, lower(regexp_replace(source_model, '-[0-9]+b$', '')) AS model_family, cardinality(role_label) AS n_roles FROM samples"""


def fn_info_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of the rendered state text of each entry."""
    e = logs.agent_entries(spark, sf_dir).withColumn("info", logs.prompt_of("All Info"))
    room, acts, todo = text.room_players(F.col("info")), text.available_actions(F.col("info")), text.tasks(F.col("info"))
    seen = ["dead", "body", "killed"]
    return e.select(
        "line_id", F.regexp_extract("info", r"Current Location: ([^\n]*)", 1).alias("room"), F.array_join(room, "|").alias("room_players"),
        F.size(F.filter(room, lambda x: x.endswith("(dead)"))).alias("bodies"), F.array_join(acts, "|").alias("actions"), F.size(todo).alias("n_tasks"),
        F.size(F.filter(todo, lambda t: t["done"])).alias("n_done"), F.array_join(F.transform(F.filter(todo, lambda t: ~t["done"]), lambda t: t["name"]), "|").alias("open_tasks"),
        F.exists(acts, lambda a: a.startswith("COMPLETE TASK")).alias("can_work"), F.exists(F.array(*[F.lit(x) for x in seen]), lambda x: F.col("info").contains(x)).alias("hard_evidence"),
    )


SQL_INFO = r"""infos AS (SELECT line_id, prompt ->> '$."All Info"' AS info FROM entries),
cut AS (SELECT line_id, info, list_filter(list_transform(string_split(regexp_extract(info, 'Players in [^:\n]+: ([^\n]*)', 1), ','), lambda x: trim(x)), lambda x: x <> '') AS room_p,
  list_filter(list_transform(string_split(regexp_extract(info, '(?s)Available actions:\n(.*?)(?:\n\n|$)', 1), chr(10)), lambda x: regexp_replace(x, '^\d+\. ', '')), lambda x: x <> '') AS acts,
  list_filter(string_split(regexp_extract(info, '(?s)Your Assigned Tasks:\n(.*?)(?:\n\n|$)', 1), chr(10)), lambda x: regexp_matches(x, '^\d+\. ')) AS todo FROM infos)"""
SQL_INFO_END = r"""SELECT line_id, regexp_extract(info, 'Current Location: ([^\n]*)', 1) AS room, array_to_string(room_p, '|') AS room_players, len(list_filter(room_p, lambda x: ends_with(x, '(dead)'))) AS bodies,
  array_to_string(acts, '|') AS actions, len(todo) AS n_tasks, len(list_filter(todo, lambda x: contains(x, '[completed]'))) AS n_done,
  array_to_string(list_transform(list_filter(todo, lambda x: NOT contains(x, '[completed]')), lambda x: trim(regexp_replace(x, '^\d+\. ', ''))), '|') AS open_tasks,
  len(list_filter(acts, lambda a: starts_with(a, 'COMPLETE TASK'))) > 0 AS can_work, contains(info, 'dead') OR contains(info, 'body') OR contains(info, 'killed') AS hard_evidence FROM cut"""


def _raw_action():
    said = F.coalesce(logs.response_of("Action"), F.try_variant_get("response", "$['Thinking Process'].action", "string"))
    shown = F.regexp_extract("full_response", r"\[Action\][ \t]*([^\n]*)", 1)
    inline = F.regexp_extract(F.try_variant_get("response", "$", "string"), r"\[Action\][ \t]*([^\n]*)", 1)
    return F.split_part(F.trim(F.coalesce(said, text.unless_blank(shown), text.unless_blank(inline))), F.lit("\n"), F.lit(1))


def fn_applied_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action of each entry as written and as the available action it names; its category, bucket and repair attempts."""
    e = logs.agent_entries(spark, sf_dir).withColumn("acts", text.available_actions(logs.prompt_of("All Info"))).withColumn("raw_action", _raw_action())
    e = e.withColumn("action", text.normalised_action(F.col("raw_action"), F.col("acts"))).withColumn("category", text.action_category(F.col("action")))
    repairs = F.try_variant_get("prompt", "$['Action Repair Attempts']", "array<variant>")
    return e.select(
        "line_id", "raw_action", "action", "category", phases.bucket(logs.prompt_of("Phase"), F.col("category")).alias("bucket"),
        F.coalesce(F.exists("acts", lambda a: F.col("raw_action").contains(a)), F.lit(False)).alias("is_valid"), F.coalesce(F.array_size(repairs), F.lit(0)).alias("repairs"),
        F.coalesce(prompt_bool("Action Repair Fallback"), F.lit(False)).alias("fallback"),
    )


def prompt_bool(path: str):
    return F.try_variant_get("prompt", f"$['{path}']", "boolean")


SQL_APPLIED = rf"""acted AS (SELECT line_id, prompt, list_filter(list_transform(string_split(regexp_extract(prompt ->> '$."All Info"', '(?s)Available actions:\n(.*?)(?:\n\n|$)', 1), chr(10)), lambda x: regexp_replace(x, '^\d+\. ', '')), lambda x: x <> '') AS acts,
  split_part(trim(coalesce(response ->> '$.Action', response ->> '$."Thinking Process".action', nullif(regexp_extract(full_response, '\[Action\][ \t]*([^\n]*)', 1), ''),
    nullif(regexp_extract(CASE WHEN json_type(response) = 'VARCHAR' THEN response ->> '$' END, '\[Action\][ \t]*([^\n]*)', 1), '')), ' '), chr(10), 1) AS raw_action FROM entries),
normed AS (SELECT *, coalesce(list_filter(acts, lambda a: contains(raw_action, a) AND NOT starts_with(a, 'SPEAK:'))[1], raw_action) AS action FROM acted),
cats AS (SELECT *, CASE {' '.join(f"WHEN starts_with(upper(trim(action)), '{a}') THEN '{a}'" for a in text.ACTIONS)} END AS category FROM normed)"""
SQL_APPLIED_END = """SELECT line_id, raw_action, action, category, CASE WHEN contains(lower(prompt ->> '$.Phase'), 'task') THEN 'task_action'
    WHEN contains(lower(prompt ->> '$.Phase'), 'meeting') AND category = 'VOTE' THEN 'meeting_vote' WHEN contains(lower(prompt ->> '$.Phase'), 'meeting') AND category = 'SPEAK' THEN 'meeting_speech' ELSE 'other' END AS bucket,
  coalesce(len(list_filter(acts, lambda a: contains(raw_action, a))) > 0, false) AS is_valid, coalesce(CAST(json_array_length(prompt, '$."Action Repair Attempts"') AS INT), 0) AS repairs,
  coalesce(TRY_CAST(prompt ->> '$."Action Repair Fallback"' AS BOOLEAN), false) AS fallback FROM cats"""


def fn_belief_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players and roles of the belief lines in documents; the last line of a player counts."""
    docs = table(spark, sf_dir, "documents").filter(F.col("text").contains("Role=")).select("doc_id", F.explode(text.belief_map(F.col("text"))).alias("player", "role"))
    return docs.groupBy("player", "role").agg(F.count(F.lit(1)).alias("documents"))


SQL_BELIEF = r"""lines_ AS (SELECT doc_id, unnest(regexp_extract_all(text, 'Player (\d+): Role=(?:Crewmate|Impostor|unknown)', 1)) AS p,
  unnest(regexp_extract_all(text, 'Player \d+: Role=(Crewmate|Impostor|unknown)', 1)) AS role, generate_subscripts(regexp_extract_all(text, 'Player (\d+): Role=(?:Crewmate|Impostor|unknown)', 1), 1) AS i
  FROM documents WHERE contains(text, 'Role=')),
last_ AS (SELECT doc_id, CAST(p AS INT) AS player, arg_max(role, i) AS role FROM lines_ GROUP BY ALL)"""


def fn_known_impostors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster numbers of each entry, and the latest game time it shows."""
    e = logs.agent_entries(spark, sf_dir)
    roster = F.transform(F.try_variant_get("prompt", "$['Player Roster']", "array<string>"), lambda x: F.regexp_extract(x, r"(\d+)", 1).try_cast("int"))
    time = F.regexp_extract(logs.prompt_of("All Info"), r"Game Time: (\d+)/", 1).try_cast("int")
    return e.select(
        "line_id", F.coalesce(F.size(roster), F.lit(0)).alias("roster_size"), F.array_max(roster).alias("last_number"), time.alias("game_time"),
        F.coalesce(F.size(roster) < F.array_max(roster), F.lit(False)).alias("roster_gap"), F.coalesce(F.array_contains(roster, F.col("player_no")), F.lit(False)).alias("lists_self"),
    )


SQL_ROSTER = r"""rost AS (SELECT line_id, player_no, TRY_CAST(nullif(regexp_extract(prompt ->> '$."All Info"', 'Game Time: (\d+)/', 1), '') AS INT) AS game_time,
  CASE WHEN json_type(prompt, '$."Player Roster"') = 'ARRAY' THEN list_transform(prompt ->> '$."Player Roster"[*]', lambda x: TRY_CAST(nullif(regexp_extract(x, '(\d+)', 1), '') AS INT)) END AS roster FROM entries)"""
SQL_ROSTER_END = """SELECT line_id, coalesce(len(roster), 0) AS roster_size, list_max(roster) AS last_number, game_time, coalesce(len(roster) < list_max(roster), false) AS roster_gap,
  coalesce(list_contains(roster, player_no), false) AS lists_self FROM rost"""


def fn_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys made of texts: game uid, event key, cache key."""
    t = logs.traces(spark, sf_dir, "game_path", "player_id", "phase", "prompt")
    return t.select(
        "trace_id", F.concat(F.regexp_extract("game_path", r"([^/]+/[^/]+)$", 1), F.lit("@"), F.substring(F.md5("game_path"), 1, 8)).alias("game_uid"),
        F.concat_ws("::", "game_path", "player_id", "phase").alias("event_key"), F.sha2("prompt", 256).alias("cache_key"), F.sha1(F.concat_ws("|", "game_path", "phase")).alias("pair_id"),
    )


SQL_KEYS = """SELECT trace_id, regexp_extract(game_path, '([^/]+/[^/]+)$', 1) || '@' || substr(md5(game_path), 1, 8) AS game_uid, concat_ws('::', game_path, player_id, phase) AS event_key,
  sha256(prompt) AS cache_key, sha1(concat_ws('|', game_path, phase)) AS pair_id FROM traces"""


def fn_matchup_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of both sides from the folder's name, self-play, and filters by model name."""
    g = logs.game_files(spark, sf_dir)
    wolf, good = F.regexp_extract("game_path", r"w-(.+?)_vs_v-", 1), F.regexp_extract("game_path", r"_vs_v-([^/]+)/", 1)
    wanted = F.split(F.lit("tern-13b|orchid-lite"), r"\|")
    return g.select(
        "file_id", wolf.alias("wolf_model"), good.alias("good_model"), (wolf == good).alias("self_play"), F.array_contains(wanted, wolf).alias("wolf_wanted"),
        F.array_contains(wanted, good).alias("good_wanted"), F.exists(F.array(F.lit("MOE"), F.lit("lite")), lambda f: F.lower(F.col("game_path")).contains(F.lower(f))).alias("name_matches"), "n_events",
    )


SQL_SIDES = r"""SELECT file_id, regexp_extract(game_path, 'w-(.+?)_vs_v-', 1) AS wolf_model, regexp_extract(game_path, '_vs_v-([^/]+)/', 1) AS good_model,
  regexp_extract(game_path, 'w-(.+?)_vs_v-', 1) = regexp_extract(game_path, '_vs_v-([^/]+)/', 1) AS self_play, regexp_extract(game_path, 'w-(.+?)_vs_v-', 1) IN ('tern-13b', 'orchid-lite') AS wolf_wanted,
  regexp_extract(game_path, '_vs_v-([^/]+)/', 1) IN ('tern-13b', 'orchid-lite') AS good_wanted, contains(lower(game_path), 'moe') OR contains(lower(game_path), 'lite') AS name_matches, len(events) AS n_events
  FROM file_lists WHERE events IS NOT NULL"""

def fn_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages of each sample and its completion with the applied action."""
    s = logs.samples(spark, sf_dir, "prompt", "completion", "action_text", "game_path")
    m = render.to_messages(F.col("prompt"), F.col("completion"))
    shown = F.when(F.col("action_text") != "", render.with_action(text.message_text(F.col("completion")), F.col("action_text")))
    return s.select(
        "sample_id", F.size(m).alias("messages"), F.md5(F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["role"], x["content"])), "|")).alias("messages_md5"), F.md5(shown).alias("shown_md5"),
        F.md5(render.english_roles(text.message_text(F.col("prompt")))).alias("english_md5"), render.game_type(F.coalesce(F.col("game_path"), F.lit("agent-logs"))).alias("game"),
    )


_EN = "array_to_string(list_transform(list_filter(prompt, lambda m: m.content IS NOT NULL), lambda m: m.content), chr(10))"
for _zh, _to in roles.CHINESE.items():
    _EN = f"replace({_EN}, '{_zh}', '{_to}')"
_TEXT = "array_to_string(list_transform(list_filter(completion, lambda m: m.content IS NOT NULL), lambda m: m.content), chr(10))"
SQL_RENDER = f"""msgs AS (SELECT *, list_filter(list_concat(coalesce(prompt, []), coalesce(completion, [])), lambda m: m.role IN ('system', 'user', 'assistant') AND trim(m.content, ' ') <> '') AS ms FROM samples)"""
SQL_RENDER_END = f"""SELECT sample_id, len(ms) AS messages, md5(array_to_string(list_transform(ms, lambda m: m.role || ':' || trim(m.content, ' ')), '|')) AS messages_md5,
  md5(CASE WHEN action_text <> '' THEN CASE WHEN regexp_matches({_TEXT}, '(?i)\\[action\\]') THEN regexp_replace({_TEXT}, '(?is)\\[action\\].*$', '') || '[Action] ' || action_text ELSE concat_ws(chr(10), {_TEXT}, '[Action] ' || action_text) END END) AS shown_md5,
  md5({_EN}) AS english_md5, CASE WHEN game_path IS NULL THEN 'task_meeting' WHEN regexp_matches(game_path, 'night_day|werewolf|/w-') THEN 'night_day' WHEN regexp_matches(game_path, 'task_meeting|agent-logs') THEN 'task_meeting' END AS game FROM msgs"""


def fn_prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user prompt of each entry rendered from its parts, and its player's name tidied."""
    e = logs.agent_entries(spark, sf_dir)
    shown = render.user_prompt(logs.prompt_of("Phase"), logs.prompt_of("All Info"), logs.prompt_of("Memory"))
    return e.select("line_id", F.md5(shown).alias("prompt_md5"), render.tidy_name(F.col("player")).alias("player"))


_PART = "CASE WHEN trim({1}, ' ') <> '' THEN '[{0}]' || chr(10) || trim({1}, ' ') END"
SQL_PROMPT = f"""SELECT line_id, md5(concat_ws(chr(10) || chr(10), {_PART.format("Phase", "(prompt ->> '$.Phase')")}, {_PART.format("State", "(prompt ->> '$.\"All Info\"')")}, {_PART.format("Memory", "(prompt ->> '$.Memory')")})) AS prompt_md5,
  regexp_replace(regexp_replace(trim(player, ' '), '\\s+', ' ', 'g'), '\\s*:\\s*', ': ', 'g') AS player FROM entries"""

QUERIES = {f.__name__: f for f in (fn_phase_parts, fn_role_normalise, fn_action_targets, fn_fenced_labels, fn_message_rows, fn_info_sections, fn_applied_actions, fn_belief_lines, fn_known_impostors, fn_keys, fn_matchup_sides, fn_rendered, fn_prompt_text)}
ORACLE = {
    "fn_phase_parts": logs.with_sql(SQL_PHASE), "fn_role_normalise": logs.with_sql(SQL_ROLE, SQL_ROLE_END), "fn_action_targets": logs.with_sql(SQL_ACTION, SQL_ACTION_END),
    "fn_fenced_labels": logs.with_sql(SQL_FENCED, SQL_FENCED_END), "fn_message_rows": logs.with_sql(SQL_MESSAGES), "fn_info_sections": logs.with_sql(SQL_INFO, SQL_INFO_END),
    "fn_applied_actions": logs.with_sql(SQL_APPLIED, SQL_APPLIED_END), "fn_belief_lines": logs.with_sql(SQL_BELIEF, "SELECT player, role, count(*) AS documents FROM last_ GROUP BY ALL"),
    "fn_known_impostors": logs.with_sql(SQL_ROSTER, SQL_ROSTER_END), "fn_keys": logs.with_sql(SQL_KEYS), "fn_matchup_sides": logs.with_sql(SQL_SIDES),
    "fn_rendered": logs.with_sql(SQL_RENDER, SQL_RENDER_END), "fn_prompt_text": logs.with_sql(SQL_PROMPT),
}
