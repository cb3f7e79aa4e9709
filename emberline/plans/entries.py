"""Queries over the log of the task/meeting game and the player traces: as-of joins, pairings, looks back, keyed lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from emberline.functions import notes, phases, text
from emberline.functions import roles as role_fn
from emberline.operators import matching, ordered, votes
from emberline.plans.functions import SQL_APPLIED, _raw_action
from emberline.sources import logs
from emberline.sources.logs import agent_entries, prompt_of, response_of, with_sql
from emberline.session import staged
from emberline.sources.tables import table

_PLAYER = ["log_path", "game", "player_no"]
_ORDER = ["step", "ts", "late", "line_id"]


def _ordered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their action, the belief they state, and ``late``: 0 for belief updates, which come before actions of the same time."""
    e = agent_entries(spark, sf_dir)
    belief = response_of("Relational Belief")
    update = prompt_of("Belief Update Trigger").isNotNull()
    e = e.withColumn("acts", text.available_actions(prompt_of("All Info"))).withColumn("raw_action", _raw_action())
    return e.withColumn("action", text.normalised_action(F.col("raw_action"), F.col("acts"))).withColumn("belief", belief).withColumn("late", F.when(update, 0).otherwise(1))


SQL_ORDERED = SQL_APPLIED.replace("SELECT line_id, prompt,", "SELECT *,") + """,
ord AS (SELECT *, response ->> '$."Relational Belief"' AS belief, CASE WHEN prompt ->> '$."Belief Update Trigger"' IS NOT NULL THEN 0 ELSE 1 END AS late FROM cats)"""
_W = "(PARTITION BY log_path, game, player_no ORDER BY step, ts, late, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def e_latest_belief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of: the player's latest belief strictly before each entry, and the previous action."""
    e = ordered.latest_before(_ordered_entries(spark, sf_dir), _PLAYER, _ORDER, F.col("belief"), "belief_before")
    e = ordered.latest_before(e, _PLAYER, _ORDER, text.action_category(F.col("action")), "action_before")
    return e.select("line_id", F.md5("belief_before").alias("belief_before"), "action_before")


def e_prior_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many earlier entries of the player called a meeting, entries of the same step and time not counted, and whether one did so far."""
    e = _ordered_entries(spark, sf_dir)
    hit = F.coalesce(text.action_category(F.col("action")) == "CALL MEETING", F.lit(False))
    e = ordered.prior_count(e, _PLAYER, ["step", "ts"], hit, "prior_calls")
    return ordered.sticky(e, _PLAYER, _ORDER, hit, "called_so_far").select("line_id", F.col("prior_calls").cast("bigint").alias("prior_calls"), "called_so_far")


SQL_PRIOR = """SELECT line_id, CAST(sum(CASE WHEN category = 'CALL MEETING' THEN 1 ELSE 0 END) OVER (PARTITION BY log_path, game, player_no ORDER BY step, ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
   - sum(CASE WHEN category = 'CALL MEETING' THEN 1 ELSE 0 END) OVER (PARTITION BY log_path, game, player_no, step, ts) AS BIGINT) AS prior_calls,
  max(coalesce(category = 'CALL MEETING', false)) OVER (PARTITION BY log_path, game, player_no ORDER BY step, ts, late, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS called_so_far FROM ord"""


def e_pre_post_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per speech event and observer: entries before (last) and after (first) the speech, in one pass."""
    e = agent_entries(spark, sf_dir).withColumn("trigger", prompt_of("Belief Update Trigger")).withColumn("speech_id", prompt_of("Speech Event Id")).filter("speech_id IS NOT NULL")
    order = F.struct("step", "ts", "line_id")
    return ordered.pre_post(e, ["log_path", "game", "speech_id"], order, F.col("trigger").isin("pre_speech", "meeting_start"), F.col("trigger").isin("post_speech", "pre_action"), "line_id")


SQL_PRE_POST = """sp AS (SELECT log_path, game, prompt ->> '$."Speech Event Id"' AS speech_id, prompt ->> '$."Belief Update Trigger"' AS trig, step, ts, line_id FROM entries WHERE prompt ->> '$."Speech Event Id"' IS NOT NULL),
pp AS (SELECT log_path, game, speech_id, arg_max(line_id, struct_pack(step, ts, line_id)) FILTER (WHERE trig IN ('pre_speech', 'meeting_start')) AS pre,
  arg_min(line_id, struct_pack(step, ts, line_id)) FILTER (WHERE trig IN ('post_speech', 'pre_action')) AS post FROM sp GROUP BY ALL)"""


def e_belief_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How beliefs of a player about others change from one statement to the next: mean change per player, then per game.

    A player whose statements change nothing counts with 0.
    """
    e = _ordered_entries(spark, sf_dir).filter("belief IS NOT NULL").withColumn("now", text.belief_map(F.col("belief")))
    e = ordered.latest_before(e, _PLAYER, _ORDER, F.col("now"), "before").filter("before IS NOT NULL")
    truth = agent_entries(spark, sf_dir).select("log_path", "game", F.col("player_no").alias("target"), "identity")
    truth = votes.consistent(truth, ["log_path", "game", "target"], "identity", "truth").select("log_path", "game", "target", "truth")
    rows = e.select("log_path", "game", "player_no", "line_id", "before", F.explode("now").alias("target", "role"))
    rows = rows.withColumn("was", F.try_element_at("before", "target")).filter("was IS NOT NULL").join(truth, ["log_path", "game", "target"])
    right = lambda c: F.col(c) == F.col("truth")
    score = F.when(right("role") & ~right("was"), 1).when(~right("role") & right("was"), -1).otherwise(0)
    scored = rows.withColumn("score", score).filter("truth IS NOT NULL")
    per = scored.groupBy("log_path", "game", "player_no").agg(F.coalesce(F.avg(F.when(F.col("was") != F.col("role"), F.col("score"))), F.lit(0.0)).alias("mean_shift"), F.count_if(F.col("score") > 0).alias("better"), F.count_if(F.col("score") < 0).alias("worse"))
    return per.groupBy("log_path", "game").agg(F.avg("mean_shift").alias("mean_shift"), F.sum("better").alias("better"), F.sum("worse").alias("worse"), F.count(F.lit(1)).alias("players"))


SQL_SHIFT = rf"""bel AS (SELECT log_path, game, player_no, line_id, belief, last_value(belief IGNORE NULLS) OVER {_W} AS before_ FROM ord),
now_l AS (SELECT log_path, game, player_no, line_id, before_, unnest(regexp_extract_all(belief, 'Player (\d+): Role=(?:Crewmate|Impostor|unknown)', 1)) AS p, unnest(regexp_extract_all(belief, 'Player \d+: Role=(Crewmate|Impostor|unknown)', 1)) AS role,
  generate_subscripts(regexp_extract_all(belief, 'Player (\d+): Role=(?:Crewmate|Impostor|unknown)', 1), 1) AS i FROM bel WHERE belief IS NOT NULL AND before_ IS NOT NULL),
now_m AS (SELECT log_path, game, player_no, line_id, CAST(p AS INT) AS target, arg_max(role, i) AS role FROM now_l GROUP BY ALL),
was_l AS (SELECT line_id, unnest(regexp_extract_all(before_, 'Player (\d+): Role=(?:Crewmate|Impostor|unknown)', 1)) AS p, unnest(regexp_extract_all(before_, 'Player \d+: Role=(Crewmate|Impostor|unknown)', 1)) AS role,
  generate_subscripts(regexp_extract_all(before_, 'Player (\d+): Role=(?:Crewmate|Impostor|unknown)', 1), 1) AS i FROM bel WHERE belief IS NOT NULL AND before_ IS NOT NULL),
was_m AS (SELECT line_id, CAST(p AS INT) AS target, arg_max(role, i) AS was FROM was_l GROUP BY ALL),
truths AS (SELECT log_path, game, player_no AS target, CASE WHEN min(identity) = max(identity) THEN max(identity) END AS truth FROM entries GROUP BY ALL),
scored AS (SELECT n.*, CASE WHEN n.role = t.truth AND w.was <> t.truth THEN 1 WHEN n.role <> t.truth AND w.was = t.truth THEN -1 ELSE 0 END AS score, w.was <> n.role AS changed FROM now_m n JOIN was_m w USING (line_id, target)
  JOIN truths t ON t.log_path = n.log_path AND t.game = n.game AND t.target = n.target WHERE t.truth IS NOT NULL),
per AS (SELECT log_path, game, player_no, coalesce(avg(score) FILTER (WHERE changed), 0.0::DOUBLE) AS mean_shift, count_if(score > 0) AS better, count_if(score < 0) AS worse FROM scored GROUP BY ALL)"""


def e_consistent_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One identity per player and game where all entries agree, missing ones completed from the number of impostors."""
    e = agent_entries(spark, sf_dir).filter("game IS NOT NULL AND player_no IS NOT NULL").withColumn("identity", role_fn.binary_role(F.col("identity")))
    c = votes.consistent(e, ["log_path", "game", "player_no"], "identity", "role")
    known = c.groupBy("log_path", "game").agg(F.count_if(F.col("role") == "Impostor").alias("impostors"))
    return c.join(known, ["log_path", "game"]).select(
        "log_path", "game", "player_no", F.when(F.col("role").isNull() & (F.col("impostors") == 2), "Crewmate").otherwise(F.col("role")).alias("role"), F.col("observations")
    )


SQL_CONSISTENT = """cons AS (SELECT log_path, game, player_no, CASE WHEN min(i) = max(i) THEN max(i) END AS role, count(i) AS observations FROM
  (SELECT log_path, game, player_no, CASE lower(trim(identity)) WHEN 'crewmate' THEN 'Crewmate' WHEN 'impostor' THEN 'Impostor' ELSE 'unknown' END AS i FROM entries WHERE game IS NOT NULL AND player_no IS NOT NULL) GROUP BY ALL),
imp AS (SELECT log_path, game, count_if(role = 'Impostor') AS impostors FROM cons GROUP BY ALL)"""


def e_room_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entry: living players in the room besides the player, and how many of them are crewmates."""
    e = agent_entries(spark, sf_dir).withColumn("in_room", F.explode(text.room_players(prompt_of("All Info"))))
    e = e.filter(~F.col("in_room").endswith("(dead)")).withColumn("other", text.first_number(F.col("in_room"))).filter("other <> player_no")
    r = e_consistent_roles(spark, sf_dir).select("log_path", "game", F.col("player_no").alias("other"), "role")
    return e.join(r, ["log_path", "game", "other"], "left").groupBy("line_id").agg(F.count(F.lit(1)).alias("others"), F.count_if(F.col("role") == "Crewmate").alias("crew_witnesses"))


SQL_WITNESS = r"""room AS (SELECT line_id, log_path, game, player_no, unnest(list_filter(list_transform(string_split(regexp_extract(prompt ->> '$."All Info"', 'Players in [^:\n]+: ([^\n]*)', 1), ','), lambda x: trim(x)), lambda x: x <> '')) AS p FROM entries),
others AS (SELECT *, TRY_CAST(nullif(regexp_extract(p, '(\d+)', 1), '') AS INT) AS other FROM room WHERE NOT ends_with(p, '(dead)')),
final_roles AS (SELECT c.log_path, c.game, c.player_no, CASE WHEN c.role IS NULL AND impostors = 2 THEN 'Crewmate' ELSE c.role END AS role FROM cons c JOIN imp USING (log_path, game))"""


def e_repair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero or more rows per entry: each repair attempt with its invalid action's kind."""
    e = agent_entries(spark, sf_dir)
    rows = e.select("line_id", F.posexplode(F.try_variant_get("prompt", "$['Action Repair Attempts']", "array<variant>")).alias("pos", "a"))
    bad = F.try_variant_get("a", "$.invalid_action", "string")
    return rows.select("line_id", (F.col("pos") + 1).alias("attempt_no"), bad.alias("invalid_action"), text.action_category(bad).alias("category"), F.coalesce(F.trim(bad) == "", F.lit(True)).alias("blank"))


SQL_REPAIR = f"""att AS (SELECT line_id, unnest(json_extract(prompt, '$."Action Repair Attempts"[*]')) AS a, generate_subscripts(json_extract(prompt, '$."Action Repair Attempts"[*]'), 1) AS n FROM entries)
SELECT line_id, CAST(n AS INT) AS attempt_no, a ->> '$.invalid_action' AS invalid_action, CASE {' '.join(f"WHEN starts_with(upper(trim(a ->> '$.invalid_action', ' ')), '{x}') THEN '{x}'" for x in text.ACTIONS)} END AS category,
  coalesce(trim(a ->> '$.invalid_action', ' ') = '', true) AS blank FROM att"""


def e_rule_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each player may know of each member of the roster after each entry: roles seen so far, own role, teammates.

    Evidence is the actor of a KILL or VENT in the history; own and teammates' roles come with every entry. A member's role
    is kept from entry to entry, forgotten once an entry's roster lacks the member, and unknown before. As a window: the last
    role stated since the member's last absence.
    """
    e = agent_entries(spark, sf_dir).filter("game IS NOT NULL AND player_no IS NOT NULL")
    roster = F.transform(F.coalesce(F.try_variant_get("prompt", "$['Player Roster']", "array<string>"), F.array()), text.first_number)
    to_int = lambda found: F.transform(found, lambda x: x.cast("int"))
    mates = to_int(F.regexp_extract_all(F.regexp_extract("system_prompt", KNOWN_IMPOSTORS, 1), F.lit(r"Player\s+(\d+)"), F.lit(1)))
    seen = to_int(F.regexp_extract_all(F.coalesce(prompt_of("All Info"), F.lit("")), F.lit(SEEN_IMPOSTORS), F.lit(1)))
    rows = e.select("log_path", "game", "player_no", "line_id", "step", "ts", role_fn.binary_role(F.col("identity")).alias("own"), F.array_distinct(F.array_compact(roster)).alias("roster"), mates.alias("mates"), seen.alias("seen"))
    rows = staged(rows, "fold")
    group = ["log_path", "game", "player_no"]
    members = rows.select(*group, F.explode("roster").alias("member")).distinct()  # those of one game
    j = rows.join(members, group)
    here = F.array_contains("roster", F.col("member"))
    impostor = F.array_contains("seen", F.col("member")) | ((F.col("own") == "Impostor") & F.array_contains("mates", F.col("member")))
    stated = F.when(here & impostor, "Impostor").when(here & (F.col("member") == F.col("player_no")), F.col("own"))
    upto = Window.partitionBy(*group, "member").orderBy("step", "ts", "line_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = j.withColumn("here", here).withColumn("stated", stated).withColumn("absences", F.sum(F.when(here, 0).otherwise(1)).over(upto))
    since = Window.partitionBy(*group, "member", "absences").orderBy("step", "ts", "line_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return j.withColumn("role", F.coalesce(F.last("stated", ignorenulls=True).over(since), F.lit("unknown"))).filter("here").select("line_id", "member", "role")


#: The list of teammates in a system prompt, and the actor of a KILL or VENT in the action history.
KNOWN_IMPOSTORS = r"Known Impostors:\s*\[([^\]]*)\]"
SEEN_IMPOSTORS = r"(?i)Timestep\s+\d+:\s*\[[^\]]+\]\s*Player\s+(\d+)(?:\s*:\s*[A-Za-z]+)?\s+(?:KILL|VENT)\b"
SQL_FOLD = rf"""fe AS (SELECT log_path, game, player_no, line_id, step, ts, CASE lower(trim(identity)) WHEN 'crewmate' THEN 'Crewmate' WHEN 'impostor' THEN 'Impostor' ELSE 'unknown' END AS own,
  list_distinct(list_filter(list_transform(coalesce(prompt ->> '$."Player Roster"[*]', []), lambda x: TRY_CAST(nullif(regexp_extract(x, '(\d+)', 1), '') AS INT)), lambda x: x IS NOT NULL)) AS roster,
  list_transform(regexp_extract_all(regexp_extract(coalesce(system_prompt, ''), '{KNOWN_IMPOSTORS}', 1), 'Player\s+(\d+)', 1), lambda x: CAST(x AS INT)) AS mates,
  list_transform(regexp_extract_all(coalesce(prompt ->> '$."All Info"', ''), '{SEEN_IMPOSTORS}', 1), lambda x: CAST(x AS INT)) AS seen FROM entries WHERE game IS NOT NULL AND player_no IS NOT NULL),
fm AS (SELECT DISTINCT log_path, game, player_no, unnest(roster) AS member FROM fe),
fj AS (SELECT *, list_contains(roster, member) AS here, CASE WHEN list_contains(roster, member) AND (list_contains(seen, member) OR own = 'Impostor' AND list_contains(mates, member)) THEN 'Impostor'
  WHEN list_contains(roster, member) AND member = player_no THEN own END AS stated FROM fe JOIN fm USING (log_path, game, player_no)),
fa AS (SELECT *, sum(CASE WHEN here THEN 0 ELSE 1 END) OVER (PARTITION BY log_path, game, player_no, member ORDER BY step, ts, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS absences FROM fj),
fr AS (SELECT line_id, member, here, coalesce(last_value(stated IGNORE NULLS) OVER (PARTITION BY log_path, game, player_no, member, absences ORDER BY step, ts, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS role FROM fa)"""


def t_entry_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces with the roster's role and model; how often both roles agree. The roster is a dimension of a row per player."""
    t = logs.traces(spark, sf_dir, "game_path", "player_id", "role", "gen_times").filter("coalesce(gen_times <= 3, true)")
    r = logs.roles(spark, sf_dir).select("game_path", F.col("id").alias("player_id"), role_fn.role(F.col("role")).alias("true_role"), "model")
    j = t.join(r, ["game_path", "player_id"]).withColumn("said", role_fn.role(F.col("role")))
    return j.groupBy("model", "true_role").agg(F.count(F.lit(1)).alias("traces"), F.count_if(F.col("said") == F.col("true_role")).alias("agree"), F.count_if(F.col("said").isNull()).alias("unsaid"))


def _role_case(col: str) -> str:
    from emberline.plans.games import _ROLE_SQL

    return _ROLE_SQL.format(col)


def t_first_per_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first trace of each (game, player, phase), for the phases that training samples exist for: a semi-join."""
    wanted = logs.samples(spark, sf_dir, "game_path", "phase", "label").filter("label").select("game_path", "phase").distinct()
    t = logs.traces(spark, sf_dir, "game_path", "player_id", "phase", "logged_at").join(wanted, ["game_path", "phase"], "left_semi")
    return ordered.first_wins(t, ["game_path", "player_id", "phase"], F.struct("logged_at", "trace_id"), "trace_id")


def _canonical_labels(col: Column) -> Column:
    """The digest of a label text's JSON object whatever the order of its members; of the text itself where it holds none."""
    labels = F.try_variant_get(text.json_or_fence(col), "$", "map<string,string>")
    return F.md5(F.coalesce(text.canonical_map(labels), text.strip_fence(col)))


def t_ranked_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State reconstructions matched to traces: the same labels first, else the same game, player and day; the strategy that matched."""
    from emberline.sources.logs import content_of, game_events

    e = game_events(spark, sf_dir, "state_reconstruction").select(
        F.concat_ws("/", "file_id", "seq").alias("event_key"), "game_path", F.col("source").alias("player_id"), "day", _canonical_labels(content_of("identity_labels")).alias("canon")
    )
    e = staged(e, "recon")
    t = logs.traces(spark, sf_dir, "game_path", "player_id", "phase", "response").filter(F.col("phase").contains("state_reconstruction"))
    t = t.select("game_path", "player_id", phases.phase_day(F.col("phase")).alias("day"), _canonical_labels(F.col("response")).alias("canon"), "trace_id")
    t = staged(t, "recon-traces")
    out = matching.best_match(e, "event_key", [(t, ["game_path", "player_id", "canon"], 1), (t, ["game_path", "player_id", "day"], 2)], "trace_id", "trace_id")
    return out.select("event_key", "match", "strategy")


_STRIP = "trim(CASE WHEN regexp_extract({0}, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1) <> '' THEN regexp_extract({0}, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1) ELSE {0} END, ' ')"
_FENCED = "regexp_extract({0}, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1)"
_LABELS = "CASE WHEN json_valid({0}) THEN CASE WHEN json_type({0}::JSON) = 'OBJECT' THEN {0}::JSON END WHEN json_valid(nullif(" + _FENCED + ", '')) THEN CASE WHEN json_type(" + _FENCED + "::JSON) = 'OBJECT' THEN " + _FENCED + "::JSON END END"
_CANON = "md5(coalesce((SELECT string_agg(k || '=' || coalesce(j ->> ('$.\"' || k || '\"'), ''), chr(1) ORDER BY k) FROM (SELECT j, unnest(json_keys(j)) AS k FROM (SELECT " + _LABELS + " AS j) WHERE j IS NOT NULL)), " + _STRIP + "))"
SQL_RANKED = f"""ev AS (SELECT file_id || '/' || seq AS event_key, game_path, source AS player_id, day, {_CANON.format("(content ->> '$.identity_labels')")} AS canon FROM game_events WHERE event = 'state_reconstruction'),
tr AS (SELECT game_path, player_id, TRY_CAST(split_part(phase, '_', 1) AS INT) AS day, {_CANON.format('response')} AS canon, trace_id FROM traces WHERE contains(phase, 'state_reconstruction')),
hits AS (SELECT event_key, 1 AS strategy, min(trace_id) AS m FROM ev JOIN tr USING (game_path, player_id, canon) GROUP BY ALL UNION ALL SELECT event_key, 2, min(trace_id) FROM ev JOIN tr USING (game_path, player_id, day) GROUP BY ALL)
SELECT ev.event_key, h.m AS match, h.strategy FROM ev LEFT JOIN (SELECT event_key, min(strategy) AS strategy, arg_min(m, strategy) AS m FROM hits GROUP BY event_key) h USING (event_key)"""


def t_changed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre- and post-phase answers of a player on a day that differ: two rows per pair with a shared id; equal ones dropped."""
    t = logs.traces(spark, sf_dir, "game_path", "player_id", "phase", "response", "logged_at").filter("response IS NOT NULL")
    side = lambda p: ordered.last_wins(
        t.filter(F.col("phase").endswith(f"_day_{p}_state_reconstruction")).withColumn("day", phases.phase_day(F.col("phase"))), ["game_path", "player_id", "day"], F.struct("logged_at", "trace_id"), "trace_id", "response"
    )
    j = side("pre").join(side("post").withColumnsRenamed({"trace_id": "post_id", "response": "post_response"}), ["game_path", "player_id", "day"]).filter(F.col("response") != F.col("post_response"))
    pair = F.sha1(F.concat_ws("|", "game_path", "player_id", "day"))
    return j.select(pair.alias("pair_id"), F.expr("stack(2, 'pre', trace_id, 'post', post_id) AS (side, trace_id)"))


SQL_CHANGED = """sides AS (SELECT game_path, player_id, TRY_CAST(split_part(phase, '_', 1) AS INT) AS day, CASE WHEN ends_with(phase, '_day_pre_state_reconstruction') THEN 'pre' ELSE 'post' END AS side,
  arg_max(struct_pack(trace_id, response), struct_pack(logged_at, trace_id)) AS v FROM traces WHERE response IS NOT NULL AND (ends_with(phase, '_day_pre_state_reconstruction') OR ends_with(phase, '_day_post_state_reconstruction')) GROUP BY ALL),
both_ AS (SELECT a.game_path, a.player_id, a.day, a.v.trace_id AS pre_id, b.v.trace_id AS post_id FROM sides a JOIN sides b ON a.game_path = b.game_path AND a.player_id = b.player_id AND a.day = b.day WHERE a.side = 'pre' AND b.side = 'post' AND a.v.response <> b.v.response)
SELECT sha1(concat_ws('|', game_path, player_id, day)) AS pair_id, 'pre' AS side, pre_id AS trace_id FROM both_ UNION ALL SELECT sha1(concat_ws('|', game_path, player_id, day)), 'post', post_id FROM both_"""


def t_missing_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of games that have no trace of their phase, by bucket: an anti-join."""
    s = logs.samples(spark, sf_dir, "game_path", "phase", "kto_bucket").filter("game_path IS NOT NULL")
    return s.join(logs.traces(spark, sf_dir, "game_path", "phase"), ["game_path", "phase"], "left_anti").groupBy("kto_bucket").agg(F.count(F.lit(1)).alias("missing"))


#: The moment at which the cache of ``t_cache_lookup`` was taken.
CACHED_UNTIL = "2025-07-01"


def t_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by what becomes of them: those until a moment make up a cache, later ones are looked up in it by digest or computed."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("key"), F.coalesce(F.col("created_at") < F.lit(CACHED_UNTIL).cast("timestamp_ntz"), F.lit(False)).alias("early"))
    cache = d.filter("early").groupBy("key").agg(F.min("doc_id").alias("cached_from"))
    hit, new = matching.cached_or_new(d.filter("NOT early"), cache, "key")
    parts = [d.filter("early").select(F.lit("cache").alias("kind")), hit.select(F.lit("hit").alias("kind")), new.select(F.lit("new").alias("kind"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("documents"))


def t_phase_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of each player, without repeats, by day and name, as one text per (game, player): the flat form of a phase map."""
    t = logs.traces(spark, sf_dir, "game_path", "player_id", "phase").filter("phase IS NOT NULL")
    days = F.array_sort(F.collect_set(F.struct(F.coalesce(phases.phase_day(F.col("phase")), F.lit(9999)).alias("d"), F.col("phase").alias("p"))))
    return t.groupBy("game_path", "player_id").agg(days.alias("l")).select("game_path", "player_id", F.array_join(F.transform("l", lambda x: x["p"]), ",").alias("phases"), F.size("l").alias("n"))


def t_name_or_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries matched to the names of their own game's rosters: the exact name, else the number where one name of the game has it."""
    e = agent_entries(spark, sf_dir)
    names = F.explode(F.try_variant_get("prompt", "$['Player Roster']", "array<string>")).alias("name")
    roster = e.select("log_path", "game", names).filter("name IS NOT NULL").distinct().withColumn("number", text.first_number(F.col("name")))
    out = matching.exact_or_unique(e.select("line_id", "log_path", "game", "player", "player_no"), ["log_path", "game"], "player", "player_no", roster, "name", "number", "name")
    return out.groupBy("match").agg(F.count(F.lit(1)).alias("entries"))


SQL_NAME = r"""rr AS (SELECT DISTINCT log_path, game, unnest(prompt ->> '$."Player Roster"[*]') AS name FROM entries), rn AS (SELECT *, TRY_CAST(nullif(regexp_extract(name, '(\d+)', 1), '') AS INT) AS number FROM rr WHERE name IS NOT NULL),
un AS (SELECT log_path, game, number, max(name) AS name FROM rn GROUP BY ALL HAVING count(*) = 1)
SELECT coalesce(x.name, u.name) AS match, count(*) AS entries FROM entries e LEFT JOIN rn x ON x.log_path = e.log_path AND x.game = e.game AND x.name = e.player
  LEFT JOIN un u ON u.log_path = e.log_path AND u.game = e.game AND u.number = e.player_no GROUP BY ALL"""


def _tail(sql: str) -> tuple[str, str]:
    head, end = sql.split("\nSELECT", 1)
    return head, "SELECT" + end


def e_accused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players of the same game whom a speech accuses, with their roles; null where entries name two."""
    e = _ordered_entries(spark, sf_dir)
    said = e.filter(F.col("action").startswith("SPEAK")).select("log_path", "game", "line_id", F.regexp_replace("action", r"^SPEAK[: ]*", "").alias("said"))
    known = e.filter(F.col("identity").isin("Crewmate", "Impostor") & (F.trim("player") != "")).groupBy("log_path", "game", notes.player_name(F.col("player")).alias("accused"))
    known = known.agg(F.when(F.min("identity") == F.max("identity"), F.min("identity")).alias("role"))
    return said.join(known, ["log_path", "game"]).filter(notes.accuses(F.col("said"), F.col("accused"))).select("line_id", "accused", "role")


def t_note_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What traces state in the wordings of the Chinese notes: summary, its topics, roles, the vote's reason, and what the prompt tells."""
    t = logs.traces(spark, sf_dir, "prompt", "response", "note")
    note, response = F.col("note"), F.col("response")
    return t.select(
        "trace_id", notes.summary(note).alias("summary"), notes.topics(note).alias("topics"), notes.noted_roles(note).alias("noted_roles"), notes.vote_reason(response).alias("vote_reason"),
        notes.predicted_roles(response).alias("predicted_roles"), notes.prompt_digest(F.col("prompt")).alias("prompt_digest"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        e_latest_belief, e_prior_calls, e_pre_post_beliefs, e_belief_shift, e_consistent_roles, e_room_witnesses, e_repair_rows, e_rule_fold, t_entry_roles, t_first_per_phase, t_ranked_match,
        t_changed_labels, t_missing_original, t_cache_lookup, t_phase_map, t_name_or_number, e_accused, t_note_parts,
    )
}
ORACLE = {
    "e_latest_belief": with_sql(SQL_ORDERED, f"SELECT line_id, md5(last_value(belief IGNORE NULLS) OVER {_W}) AS belief_before, last_value(category IGNORE NULLS) OVER {_W} AS action_before FROM ord"),
    "e_prior_calls": with_sql(SQL_ORDERED, SQL_PRIOR),
    "e_pre_post_beliefs": with_sql(SQL_PRE_POST, "SELECT * FROM pp WHERE pre IS NOT NULL AND post IS NOT NULL"),
    "e_belief_shift": with_sql(SQL_ORDERED, SQL_SHIFT, "SELECT log_path, game, avg(mean_shift) AS mean_shift, sum(better) AS better, sum(worse) AS worse, count(*) AS players FROM per GROUP BY ALL"),
    "e_consistent_roles": with_sql(SQL_CONSISTENT, "SELECT c.log_path, c.game, c.player_no, CASE WHEN c.role IS NULL AND impostors = 2 THEN 'Crewmate' ELSE c.role END AS role, c.observations FROM cons c JOIN imp USING (log_path, game)"),
    "e_room_witnesses": with_sql(SQL_CONSISTENT, SQL_WITNESS, "SELECT o.line_id, count(*) AS others, coalesce(count_if(r.role = 'Crewmate'), 0) AS crew_witnesses FROM others o LEFT JOIN final_roles r ON r.log_path = o.log_path AND r.game = o.game AND r.player_no = o.other WHERE o.other <> o.player_no GROUP BY ALL"),
    "e_repair_rows": with_sql(*_tail(SQL_REPAIR)),
    "e_rule_fold": with_sql(SQL_FOLD, "SELECT line_id, member, role FROM fr WHERE here"),
    "t_entry_roles": with_sql(f"""SELECT r.model, {_role_case('r.role')} AS true_role, count(*) AS traces, count_if({_role_case('t.role')} = {_role_case('r.role')}) AS agree, count_if({_role_case('t.role')} IS NULL) AS unsaid
      FROM traces t JOIN roles r ON r.game_path = t.game_path AND r.id = t.player_id WHERE coalesce(gen_times <= 3, true) GROUP BY ALL"""),
    "t_first_per_phase": with_sql("SELECT game_path, player_id, phase, arg_min(trace_id, struct_pack(logged_at, trace_id)) AS trace_id FROM traces t WHERE EXISTS (SELECT 1 FROM samples s WHERE s.label AND s.game_path = t.game_path AND s.phase = t.phase) GROUP BY ALL"),
    "t_ranked_match": with_sql(*_tail(SQL_RANKED)), "t_changed_labels": with_sql(*_tail(SQL_CHANGED)),
    "t_missing_original": with_sql("SELECT kto_bucket, count(*) AS missing FROM samples s WHERE game_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM traces t WHERE t.game_path = s.game_path AND t.phase = s.phase) GROUP BY ALL"),
    "t_cache_lookup": f"""WITH d AS (SELECT sha256(text) AS k, coalesce(created_at < TIMESTAMP '{CACHED_UNTIL}', false) AS early FROM documents WHERE text IS NOT NULL)
      SELECT CASE WHEN early THEN 'cache' WHEN k IN (SELECT k FROM d WHERE early) THEN 'hit' ELSE 'new' END AS kind, count(*) AS documents FROM d GROUP BY ALL""",
    "t_phase_map": with_sql("""SELECT game_path, player_id, array_to_string(list_transform(list_sort(list_distinct(list(struct_pack(d := coalesce(TRY_CAST(split_part(phase, '_', 1) AS INT), 9999), p := phase)))), lambda x: x.p), ',') AS phases,
      count(DISTINCT phase) AS n FROM traces WHERE phase IS NOT NULL GROUP BY ALL"""),
    "t_name_or_number": with_sql(*_tail(SQL_NAME)),
}
