"""Labels of events and entries: from beliefs, outcomes and facts to samples and back to the rows they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from emberline.functions import notes, phases, text
from emberline.functions import roles as role_fn
from emberline.operators import matching, ordered, sampling, votes
from emberline.plans.entries import SQL_ORDERED, _ordered_entries
from emberline.plans.extras import called_wolves
from emberline.plans.games import SQL_BELIEFS, SQL_ROSTER, _beliefs, _roster
from emberline.session import staged
from emberline.sources import logs
from emberline.sources.logs import content_of, game_events, prompt_of, staged_events, with_sql

_GOOD_TEAM = ("Villager", "Seer", "Witch", "Guard", "Hunter")


# -- labels back to rows -----------------------------------------------------------------------------------------------
def good_vote_phases(events: DataFrame) -> DataFrame:
    """A phase map as rows (game_path, player_id, phase): the votes of each player that hit a werewolf."""
    wolves = _roster(events).filter("role = 'Werewolf'").select("file_id", F.col("player").alias("target"))
    v = events.filter("event IN ('vote', 'vote_pk')").select("file_id", "game_path", "source", "event", "day", content_of("vote_target", "int").alias("target"))
    hits = v.join(wolves, ["file_id", "target"], "left_semi")
    return hits.select("game_path", F.col("source").alias("player_id"), F.concat_ws("_day_", F.col("day").cast("string"), "event").alias("phase")).distinct()


def t_rehydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The traces that a phase map names, all of a phase, with a prompt and a response: a semi-join of the raw rows."""
    e = staged(game_events(spark, sf_dir, "god_view", "vote", "vote_pk"), "events")
    t = logs.traces(spark, sf_dir, "game_path", "player_id", "phase", "prompt", "response").filter("prompt <> '' AND response <> ''")
    return t.join(good_vote_phases(e), ["game_path", "player_id", "phase"], "left_semi").select("trace_id", "game_path", "player_id", "phase")


_SQL_HITS = """hits AS (SELECT DISTINCT v.game_path, v.source AS player_id, v.day || '_day_' || v.event AS phase FROM game_events v
  JOIN roster r ON r.file_id = v.file_id AND r.player = TRY_CAST(v.content ->> '$.vote_target' AS INT) WHERE v.event IN ('vote', 'vote_pk') AND r.role = 'Werewolf')"""


def _recon_labels(events: DataFrame) -> DataFrame:
    """(file_id, viewer, day, night, recon): whether the last belief stated by day, or by night, has at least 0.6 of the known roles right."""
    truth = _roster(events).select("file_id", F.col("player").alias("target"), F.col("role").alias("truth"))
    known = F.coalesce(F.col("role") != "Unknown", F.lit(False))
    per = _beliefs(events).join(truth, ["file_id", "target"]).groupBy("file_id", "viewer", "day", "night", "seq")
    per = per.agg((F.avg(F.when(known, (F.col("role") == F.col("truth")).cast("double"))) >= 0.6).alias("recon")).filter("recon IS NOT NULL")
    return ordered.last_wins(per, ["file_id", "viewer", "day", "night"], F.col("seq"), "recon")


_SQL_RECON = """recon_s AS (SELECT b.file_id, b.viewer, b.day, b.night, b.seq, avg(CASE WHEN b.role <> 'Unknown' THEN CAST(b.role = r.role AS DOUBLE) END) >= 0.6 AS recon
  FROM beliefs b JOIN roster r ON r.file_id = b.file_id AND r.player = b.target GROUP BY ALL),
recon_l AS (SELECT file_id, viewer, day, night, arg_max(recon, seq) AS recon FROM recon_s WHERE recon IS NOT NULL GROUP BY ALL)"""


def g_label_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes and night skills with the label of the player's reconstruction of that day or night, else with a label of the move itself."""
    kinds = {"vote": "vote_target", "vote_pk": "vote_target", "skill_wolf": "kill_target", "skill_seer": None, "skill_guard": "protected"}
    e = staged_events(spark, sf_dir, "god_view", "state_reconstruction", *kinds)
    target = F.lit(None).cast("int")
    for kind, member in kinds.items():
        target = F.when(F.col("event") == kind, content_of(member, "int") if member else F.col("target")).otherwise(target)
    moves = e.filter(F.col("event").isin(*kinds)).select("file_id", "seq", F.col("source").alias("viewer"), "day", F.col("event").startswith("skill_").alias("night"), target.alias("target"))
    role = _roster(e).select("file_id", F.col("player").alias("target"), "role")
    rows = moves.join(role, ["file_id", "target"], "left").join(_recon_labels(e), ["file_id", "viewer", "day", "night"], "left")
    process = F.when(F.col("target") > 0, F.col("role") == "Werewolf")
    return rows.groupBy("night", "recon", process.alias("process"), F.coalesce("recon", process).alias("label")).agg(F.count(F.lit(1)).alias("moves"))


_SQL_MOVES = """moves AS (SELECT file_id, seq, source AS viewer, day, starts_with(event, 'skill_') AS night, CASE WHEN event IN ('vote', 'vote_pk') THEN TRY_CAST(content ->> '$.vote_target' AS INT)
  WHEN event = 'skill_wolf' THEN TRY_CAST(content ->> '$.kill_target' AS INT) WHEN event = 'skill_seer' THEN target WHEN event = 'skill_guard' THEN TRY_CAST(content ->> '$.protected' AS INT) END AS target
  FROM game_events WHERE event IN ('vote', 'vote_pk', 'skill_wolf', 'skill_seer', 'skill_guard')),
labelled AS (SELECT m.night, l.recon, CASE WHEN m.target > 0 THEN r.role = 'Werewolf' END AS process FROM moves m LEFT JOIN roster r ON r.file_id = m.file_id AND r.player = m.target
  LEFT JOIN recon_l l ON l.file_id = m.file_id AND l.viewer = m.viewer AND l.day = m.day AND l.night = m.night)"""


# -- what speeches in prompts say --------------------------------------------------------------------------------------
def t_prompt_speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speeches that a prompt tells, a row per player; speeches as digests."""
    t = logs.traces(spark, sf_dir, "prompt").select("trace_id", F.explode(notes.speeches(F.col("prompt"))).alias("player", "speech"))
    return t.select("trace_id", "player", F.md5("speech").alias("speech"))


def t_seer_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vote and player whom the voter takes for a seer and whose speech the prompt tells: the players that speech calls wolves."""
    e = staged(game_events(spark, sf_dir, "state_reconstruction"), "events")
    seers = ordered.last_wins(_beliefs(e).filter("NOT night"), ["file_id", "viewer", "day", "target"], F.col("seq"), "role", "raw")
    seers = seers.filter((F.col("role") == "Seer") & ~role_fn.is_dead_label(F.col("raw"))).join(e.select("file_id", "game_path").distinct(), "file_id")
    t = logs.traces(spark, sf_dir, "game_path", "player_id", "phase", "prompt").filter(F.col("phase").contains("_day_vote"))
    t = t.select("trace_id", "game_path", F.col("player_id").alias("viewer"), phases.phase_day(F.col("phase")).alias("day"), notes.speeches(F.col("prompt")).alias("said"))
    rows = t.join(seers.select("game_path", "viewer", "day", "target"), ["game_path", "viewer", "day"])
    rows = rows.withColumn("speech", F.try_element_at("said", "target")).filter("speech IS NOT NULL")
    return rows.select("trace_id", F.col("target").alias("seer"), F.array_join(F.array_sort(called_wolves(F.col("speech"))).cast("array<string>"), ",").alias("wolves"))


# -- rounds, days, viewers ---------------------------------------------------------------------------------------------
def g_pk_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws and expulsions with the phase they belong to: after a draw the day's next expulsion belongs to the run-off."""
    e = game_events(spark, sf_dir, "end_vote")
    named = F.try_variant_get("content", "$.expelled", "variant").isNotNull()
    e = e.select("file_id", "seq", "day", named.alias("named"), (~named & F.coalesce(content_of("vote_outcome") == "draw", F.lit(False))).alias("draw"), content_of("expelled", "int").alias("expelled")).filter("named OR draw")
    before = Window.partitionBy("file_id", "day").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("round", F.coalesce(F.sum(F.col("named").cast("int")).over(before), F.lit(0)))
    drawn = F.max("draw").over(Window.partitionBy("file_id", "day", "round"))
    phase = F.concat(F.col("day").cast("string"), F.lit("_day_vote"), F.when(F.col("named") & drawn, "_pk").otherwise(""))
    return e.select("file_id", "seq", "day", phase.alias("phase"), F.nullif("expelled", F.lit(0)).alias("expelled"), "draw")


_SQL_PK = """ev AS (SELECT file_id, seq, day, json_type(content, '$.expelled') IS NOT NULL AS named, json_type(content, '$.expelled') IS NULL AND coalesce(content ->> '$.vote_outcome' = 'draw', false) AS draw,
  TRY_CAST(content ->> '$.expelled' AS INT) AS expelled FROM game_events WHERE event = 'end_vote'),
er AS (SELECT *, coalesce(sum(CAST(named AS INT)) OVER (PARTITION BY file_id, day ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS round FROM ev WHERE named OR draw),
pk AS (SELECT file_id, seq, day, day || '_day_vote' || CASE WHEN named AND max(draw) OVER (PARTITION BY file_id, day, round) THEN '_pk' ELSE '' END AS phase, nullif(expelled, 0) AS expelled, draw FROM er)"""


def g_day_expelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day whether any of its rounds expelled a werewolf, and for how many voters that holds."""
    e = staged_events(spark, sf_dir, "god_view", "end_vote", "vote", "vote_pk")
    out = e.filter("event = 'end_vote'").select("file_id", "day", content_of("expelled", "int").alias("player"))
    out = out.join(_roster(e), ["file_id", "player"], "left").groupBy("file_id", "day").agg(F.bool_or(F.coalesce(F.col("role") == "Werewolf", F.lit(False))).alias("wolf_expelled"))
    v = e.filter("event IN ('vote', 'vote_pk')").groupBy("file_id", "day").agg(F.count(F.lit(1)).alias("votes"))
    return out.join(v, ["file_id", "day"], "left").select("file_id", "day", "wolf_expelled", F.coalesce("votes", F.lit(0)).alias("votes"))


_SQL_DAY = """SELECT o.file_id, o.day, o.wolf_expelled, coalesce(v.votes, 0) AS votes FROM (SELECT e.file_id, e.day, bool_or(coalesce(r.role = 'Werewolf', false)) AS wolf_expelled FROM game_events e
  LEFT JOIN roster r ON r.file_id = e.file_id AND r.player = TRY_CAST(e.content ->> '$.expelled' AS INT) WHERE e.event = 'end_vote' GROUP BY ALL) o
  LEFT JOIN (SELECT file_id, day, count(*) AS votes FROM game_events WHERE event IN ('vote', 'vote_pk') GROUP BY ALL) v ON v.file_id = o.file_id AND v.day IS NOT DISTINCT FROM o.day"""


def g_team_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day the mean F1 of the good side's beliefs about who is a werewolf, and how many viewers it is of."""
    e = staged_events(spark, sf_dir, "god_view", "state_reconstruction")
    roster = _roster(e)
    b = ordered.last_wins(_beliefs(e).filter("NOT night"), ["file_id", "viewer", "day", "target"], F.col("seq"), "role")
    b = b.join(roster.select("file_id", F.col("player").alias("target"), F.col("role").alias("truth")), ["file_id", "target"], "left")
    said, wolf = F.coalesce(F.col("role") == "Werewolf", F.lit(False)), F.coalesce(F.col("truth") == "Werewolf", F.lit(False))
    per = b.groupBy("file_id", "viewer", "day").agg(F.count_if(said & wolf).alias("tp"), F.count_if(said & ~wolf).alias("fp"))
    team = roster.filter(F.col("role").isin(*_GOOD_TEAM)).select("file_id", F.col("player").alias("viewer"))
    wolves = roster.groupBy("file_id").agg(F.count_if(F.col("role") == "Werewolf").alias("wolves"))
    per = per.join(team, ["file_id", "viewer"], "left_semi").join(wolves, "file_id")
    return per.groupBy("file_id", "day").agg(F.avg(votes.f1(F.col("tp"), F.col("fp"), F.col("wolves") - F.col("tp"))).alias("mean_f1"), F.count(F.lit(1)).alias("viewers"))


_SQL_TEAM = """tb AS (SELECT file_id, viewer, day, target, arg_max(struct_pack(r := role), seq).r AS role FROM beliefs WHERE NOT night GROUP BY ALL),
tw AS (SELECT file_id, count_if(role = 'Werewolf') AS wolves FROM roster GROUP BY ALL),
tp AS (SELECT b.file_id, b.viewer, b.day, count_if(b.role = 'Werewolf' AND r.role = 'Werewolf') AS tp, count_if(b.role = 'Werewolf' AND coalesce(r.role, '') <> 'Werewolf') AS fp FROM tb b
  LEFT JOIN roster r ON r.file_id = b.file_id AND r.player = b.target GROUP BY ALL)"""


_SECTIONS = {"speech": "speech", "speech_pk": "speech", "vote": "vote", "vote_pk": "vote", "skill_wolf": "night", "skill_seer": "night", "skill_guard": "night", "skill_witch": "night", "skill_hunter": "night",
             "end_night": "deaths", "end_vote": "outcome", "end_game": "winner"}


def g_game_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The course of each game in order: actions, votes with the first reason that their player's traces give, speeches as digests, deaths, outcomes, the winner."""
    e = game_events(spark, sf_dir, *_SECTIONS)
    section = F.lit(None).cast("string")
    for event, name in _SECTIONS.items():
        section = F.when(F.col("event") == event, name).otherwise(section)
    chosen = [F.nullif(content_of(m, "int"), F.lit(0)) for m in ("vote_target", "kill_target", "protected", "heal", "poison", "shoot", "expelled")]
    detail = F.when(section == "speech", F.md5(content_of("speech_content"))).when(section == "deaths", F.array_join(content_of("dead_list", "array<string>"), ","))
    detail = detail.when(section == "winner", F.when(content_of("outcome", "int") == 1, "wolves").when(content_of("outcome", "int") == -1, "village"))
    phase = F.when(section == "vote", F.concat_ws("_day_", F.col("day").cast("string"), "event"))
    rows = e.select("file_id", "game_path", "seq", section.alias("section"), F.col("source").alias("player_id"), F.coalesce(*chosen, F.when(section == "night", F.col("target"))).alias("target"), detail.alias("detail"), phase.alias("phase"))
    reasons = logs.traces(spark, sf_dir, "game_path", "player_id", "phase", "vote_reason").filter("trim(vote_reason) <> ''")
    reasons = ordered.first_wins(reasons, ["game_path", "player_id", "phase"], F.col("trace_id"), "vote_reason")
    out = rows.join(reasons, ["game_path", "player_id", "phase"], "left")
    return out.select("file_id", "seq", "section", F.col("player_id").alias("actor"), "target", "detail", F.md5("vote_reason").alias("reason"))


_SECTION_SQL = "CASE event " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SECTIONS.items()) + " END"
_SQL_GAME = f"""gr AS (SELECT file_id, game_path, seq, day, event, source, target AS single, content, {_SECTION_SQL} AS section FROM game_events),
gd AS (SELECT file_id, game_path, seq, section, source AS player_id, coalesce({", ".join(f"nullif(TRY_CAST(content ->> '$.{m}' AS INT), 0)" for m in ("vote_target", "kill_target", "protected", "heal", "poison", "shoot", "expelled"))},
  CASE WHEN section = 'night' THEN single END) AS target, CASE section WHEN 'speech' THEN md5(content ->> '$.speech_content') WHEN 'deaths' THEN CASE WHEN json_type(content, '$.dead_list') = 'ARRAY' THEN array_to_string(content ->> '$.dead_list[*]', ',') END
  WHEN 'winner' THEN CASE TRY_CAST(content ->> '$.outcome' AS INT) WHEN 1 THEN 'wolves' WHEN -1 THEN 'village' END END AS detail, CASE WHEN section = 'vote' THEN day || '_day_' || event END AS phase FROM gr WHERE section IS NOT NULL),
gq AS (SELECT game_path, player_id, phase, arg_min(vote_reason, trace_id) AS vote_reason FROM traces WHERE trim(vote_reason, ' ') <> '' GROUP BY ALL)"""


# -- keys, counters, weights -------------------------------------------------------------------------------------------
def s_label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of each (game, phase) that samples agree on; null where some are good and some are bad."""
    s = logs.samples(spark, sf_dir, "game_path", "phase", "label").filter("label IS NOT NULL AND game_path IS NOT NULL AND phase IS NOT NULL")
    return votes.consistent(s, ["game_path", "phase"], "label", "agreed")


def g_model_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest name of a known model that a game's path contains, then the first by name; null where none does."""
    names = logs.roles(spark, sf_dir).filter("model <> ''").agg(F.collect_set("model")).scalar()  # as many as there are models
    g = logs.game_files(spark, sf_dir).withColumn("names", names)
    hits = F.filter("names", lambda n: F.contains("game_path", n))
    best = F.array_min(F.transform(hits, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
    return g.select("file_id", best["n"].alias("model"))


def s_aux_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of auxiliary rows, by group: reconstruction traces over samples of the same phase group."""
    kind = phases.sample_type(F.lower("phase"))
    t = logs.traces(spark, sf_dir, "phase").groupBy(F.coalesce(kind, F.lit("other")).alias("kind")).agg(F.count(F.lit(1)).alias("traces"))
    s = logs.samples(spark, sf_dir, "phase").groupBy(F.coalesce(kind, F.lit("other")).alias("kind")).agg(F.count(F.lit(1)).alias("samples"))
    both = t.join(s, "kind", "full").select("kind", F.coalesce("traces", F.lit(0)).alias("traces"), F.coalesce("samples", F.lit(0)).alias("samples"))
    return both.withColumn("weight", F.try_divide(F.col("traces").cast("double"), F.col("samples").cast("double")))


_KIND = "CASE WHEN contains(lower(phase), '_day_speech') THEN 'speech' WHEN contains(lower(phase), '_day_vote') THEN 'vote' WHEN contains(lower(phase), 'night_skill') THEN 'action' WHEN contains(lower(phase), 'state_reconstruction') THEN 'state_recon' ELSE 'other' END"


def t_skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why traces are skipped, by kind of phase: the counters of a pass over all of them."""
    t = logs.traces(spark, sf_dir, "phase", "prompt", "response", "gen_times")
    parsed = text.json_or_fence(F.col("response"))
    return t.groupBy(F.coalesce(phases.sample_type(F.lower("phase")), F.lit("other")).alias("kind")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("phase").isNull()).alias("no_phase"), F.count_if(F.coalesce(F.col("prompt") == "", F.lit(True))).alias("no_prompt"),
        F.count_if(F.coalesce(F.trim("response") == "", F.lit(True))).alias("no_response"), F.count_if(F.col("gen_times") > 3).alias("many_tries"),
        F.count_if((F.trim("response") != "") & parsed.isNull()).alias("no_json"),
    )


_FENCED = "regexp_extract(response, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1)"
_SQL_SKIPS = f"""SELECT {_KIND} AS kind, count(*) AS rows, count_if(phase IS NULL) AS no_phase, count_if(coalesce(prompt = '', true)) AS no_prompt, count_if(coalesce(trim(response, ' ') = '', true)) AS no_response,
  count_if(gen_times > 3) AS many_tries, count_if(trim(response, ' ') <> '' AND NOT json_valid(response) AND NOT coalesce(json_valid(nullif({_FENCED}, '')), false)) AS no_json FROM traces GROUP BY ALL"""


def e_action_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of each entry's action for rebalancing, and the detail type it is weighted by."""
    e = _ordered_entries(spark, sf_dir)
    up = F.upper(F.trim(F.coalesce("action", F.lit(""))))
    kind = F.when(up.startswith("COMPLETE "), "COMPLETE TASK").when(up.startswith("REPORT"), "REPORT")
    for name in ("MOVE", "VIEW", "CALL", "KILL", "VENT", "VOTE", "SPEAK"):
        kind = kind.when(up.startswith(name), name)
    category = text.action_category(F.col("action"))
    detail = F.when(category == "COMPLETE TASK", "complete_task").when(category == "MOVE", "movement").when(category.isin("COMPLETE FAKE TASK", "KILL", "VENT"), "impostor_action")
    detail = detail.when(category.isin("CALL MEETING", "REPORT DEAD BODY"), "meeting_trigger").when(category == "VIEW MONITOR", "monitor").otherwise("other")
    return e.groupBy(kind.otherwise("<missing>").alias("kind"), detail.alias("detail")).agg(F.count(F.lit(1)).alias("entries"))


_CATEGORY = "CASE " + " ".join(f"WHEN starts_with(upper(trim(action, ' ')), '{x}') THEN '{x}'" for x in text.ACTIONS) + " END"
_SQL_DETAILS = f"""ad AS (SELECT upper(trim(coalesce(action, ''), ' ')) AS up, {_CATEGORY} AS category FROM ord)
SELECT CASE WHEN starts_with(up, 'COMPLETE ') THEN 'COMPLETE TASK' WHEN starts_with(up, 'REPORT') THEN 'REPORT' {" ".join(f"WHEN starts_with(up, '{x}') THEN '{x}'" for x in ("MOVE", "VIEW", "CALL", "KILL", "VENT", "VOTE", "SPEAK"))} ELSE '<missing>' END AS kind,
  CASE WHEN category = 'COMPLETE TASK' THEN 'complete_task' WHEN category = 'MOVE' THEN 'movement' WHEN category IN ('COMPLETE FAKE TASK', 'KILL', 'VENT') THEN 'impostor_action'
   WHEN category IN ('CALL MEETING', 'REPORT DEAD BODY') THEN 'meeting_trigger' WHEN category = 'VIEW MONITOR' THEN 'monitor' ELSE 'other' END AS detail, count(*) AS entries FROM ad GROUP BY ALL"""


def e_fact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each entry says against what its prompt shows: false where it contradicts, true where no rule does, null where it says nothing."""
    e = _ordered_entries(spark, sf_dir)
    said = F.coalesce(F.nullif(F.trim(F.regexp_replace("action", r"(?i)^SPEAK[: ]*", "")), F.lit("")), F.lit(""))
    said = F.when(F.upper("action").startswith("SPEAK"), said).otherwise(F.coalesce(F.try_variant_get("response", "$['Thinking Process']", "string"), F.lit("")))
    info = F.coalesce(prompt_of("All Info"), F.lit(""))
    memory = F.coalesce(prompt_of("Memory"), F.lit(""))
    e = e.select("line_id", said.alias("said"), info.alias("info"), memory.alias("memory"), text.tasks(info).alias("tasks"))
    conflicts = notes.fact_conflicts(F.col("said"), F.col("info"), F.col("memory"), F.col("tasks"))
    return e.select("line_id", F.when(F.col("said") != "", F.size(conflicts) == 0).alias("holds"), F.array_join(conflicts, ",").alias("conflicts"))


def s_relabel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undesirable votes and night skills of days whose reconstruction was right, as pairs of the rejected row and its relabelled copy."""
    e = staged(game_events(spark, sf_dir, "god_view", "state_reconstruction"), "events")
    right = _recon_labels(e).join(e.select("file_id", "game_path").distinct(), "file_id").groupBy("game_path", "day").agg(F.bool_or("recon").alias("state_recon"))
    s = logs.samples(spark, sf_dir, "game_path", "phase", "label").filter(~F.col("label") & (F.col("phase").contains("night_skill") | F.col("phase").contains("_day_vote")))
    s = s.withColumn("day", phases.phase_day(F.col("phase"))).join(right.filter("state_recon"), ["game_path", "day"], "left_semi")
    pair = F.sha1(F.concat_ws("|", F.lit("kto_dataset"), "sample_id"))
    return s.select(pair.alias("pair_id"), "sample_id", "phase", F.expr("stack(2, 'rejected', false, 'chosen', true) AS (side, label)"))


_SQL_PAIRS = """rd AS (SELECT DISTINCT f.game_path, l.day FROM recon_l l JOIN files f USING (file_id) WHERE l.recon),
bad AS (SELECT s.sample_id, s.phase FROM samples s JOIN rd ON rd.game_path = s.game_path AND rd.day = TRY_CAST(split_part(s.phase, '_', 1) AS INT) WHERE NOT s.label AND (contains(s.phase, 'night_skill') OR contains(s.phase, '_day_vote')))
SELECT sha1('kto_dataset|' || sample_id) AS pair_id, sample_id, phase, side, side = 'chosen' AS label FROM bad, (VALUES ('rejected'), ('chosen')) x(side)"""


# -- sampling by tables ------------------------------------------------------------------------------------------------
SEED = "d-1"
# Fixed values: (good or bad, kind, role, what the phase has, what it lacks, chance to stay, copies for sure, copies by chance, that chance).
# The first rule about the phase and the first about the role apply.
CHANCES = [
    ("bad", "vote", None, r"^1_day_vote$", None, 0.5, 0, 0, 0.0),
    ("bad", "vote", None, r"^2_day_vote$", None, 0.8, 0, 0, 0.0),
    ("bad", "vote", None, r"[345]_day_vote", "pk", 1.0, 0, 1, 0.9),
    ("bad", "vote", None, "pk", None, 1.0, 0, 1, 0.99),
    ("good", "vote", None, r"[12]_day_vote", "pk", 0.4, 0, 0, 0.0),
    ("good", "vote", None, r"[34]_day_vote", "pk", 1.0, 0, 1, 0.99),
    ("good", "vote", None, "pk", None, 1.0, 1, 0, 0.0),
    ("good", "action", None, "1_night_skill_wolf", None, 0.5, 0, 0, 0.0),
    ("good", "action", None, r"2_night_skill_witch|[34]_night_skill", None, 1.0, 0, 2, 0.99),
    ("bad", "action", None, "", None, 1.0, 0, 1, 0.999),
    ("good", "speech", None, "pk", None, 1.0, 0, 1, 0.95),
    ("good", "speech", None, r"^1_day_speech$", None, 0.5, 0, 0, 0.0),
    ("good", "speech", None, r"[345]_day_speech", None, 1.0, 0, 1, 0.8),
    ("bad", "speech", None, "pk", None, 1.0, 2, 0, 0.0),
    ("bad", "speech", None, r"[12]_day_speech", None, 0.7, 0, 0, 0.0),
    ("bad", "speech", None, r"[345]_day_speech", None, 1.0, 0, 1, 0.99),
    ("good", "speech", "Villager", "", None, 0.4, 0, 0, 0.0),
    ("good", "speech", "Werewolf", "", None, 0.6, 0, 0, 0.0),
    ("bad", "speech", "Seer", "", None, 1.0, 2, 0, 0.0),
    ("bad", "speech", "Werewolf", "", None, 0.4, 0, 0, 0.0),
    ("bad", "speech", "Villager", "", None, 0.6, 0, 0, 0.0),
]


def s_drawn_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples dropped and copied by chance, by label, kind, day, run-off and role."""
    s = logs.samples(spark, sf_dir, "phase", "label", "actor_role").filter("label IS NOT NULL AND phase IS NOT NULL")
    s = s.withColumn("kind", phases.sample_type(F.lower("phase"))).withColumn("low", F.lower("phase")).withColumn("name", role_fn.role(F.col("actor_role")))
    parts = []
    for by_role in (False, True):
        rule = F.lit(None).cast("struct<stay:double,sure:int,more:int,chance:double>")
        for side, kind, who, has, lacks, *values in reversed([c for c in CHANCES if (c[2] is not None) == by_role]):
            here = (F.col("label") == F.lit(side == "good")) & (F.col("kind") == kind) & F.col("low").rlike(has)
            here = here & ~F.col("low").contains(lacks) if lacks else here
            here = here & (F.col("name") == who) if who else here
            rule = F.when(here, F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(values, ("double", "int", "int", "double"), ("stay", "sure", "more", "chance"))])).otherwise(rule)
        parts.append(rule)
    s = s.withColumn("a", parts[0]).withColumn("b", parts[1])
    u = lambda name: sampling.unit(f"{SEED}{name}", F.col("sample_id"))
    of = lambda r, n, d: F.coalesce(F.col(f"{r}.{n}"), F.lit(d))
    stays = (u("a") < of("a", "stay", 1.0)) & (u("b") < of("b", "stay", 1.0))
    n = 1 + of("a", "sure", 0) + of("b", "sure", 0) + F.when(u("c") < of("a", "chance", 0.0), of("a", "more", 0)).otherwise(0)
    return s.filter(stays).select("sample_id", "kind", F.explode(F.sequence(F.lit(1), n)).alias("copy_no"))


def _rule_sql(by_role: bool, value: int) -> str:
    default = 1.0 if value == 5 else 0
    cases = []
    for c in CHANCES:
        if (c[2] is not None) == by_role:
            lacks = f" AND NOT contains(low, '{c[4]}')" if c[4] else ""
            who = f" AND name = '{c[2]}'" if c[2] else ""
            cases.append(f"WHEN label = {c[0] == 'good'} AND kind = '{c[1]}' AND regexp_matches(low, '{c[3]}'){lacks}{who} THEN {c[value]}{'::DOUBLE' if value in (5, 8) else ''}")
    return "CASE " + " ".join(cases) + f" ELSE {default} END"


_U = lambda name: f"CAST(('0x' || substr(md5('{SEED}{name}|' || sample_id), 1, 8))::UBIGINT AS DOUBLE) / 4294967296"


def _sql_drawn() -> str:
    from emberline.plans.games import _ROLE_SQL

    return f"""dk AS (SELECT sample_id, label, nullif({_KIND}, 'other') AS kind, lower(phase) AS low, {_ROLE_SQL.format('actor_role')} AS name FROM samples WHERE label IS NOT NULL AND phase IS NOT NULL),
dn AS (SELECT sample_id, kind, 1 + {_rule_sql(False, 6)} + {_rule_sql(True, 6)} + CASE WHEN {_U('c')} < {_rule_sql(False, 8)} THEN {_rule_sql(False, 7)} ELSE 0 END AS n FROM dk
  WHERE {_U('a')} < {_rule_sql(False, 5)} AND {_U('b')} < {_rule_sql(True, 5)})
SELECT sample_id, kind, CAST(unnest(generate_series(1, n)) AS INT) AS copy_no FROM dn"""


def s_flat_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket weights from three levels: labels 3 to 2, details by how many samples they have, roles 1 to 1."""
    s = logs.samples(spark, sf_dir, "label", "kto_bucket", "actor_role").filter("label IS NOT NULL AND kto_bucket IS NOT NULL")
    labels = s.select("label").distinct().withColumn("w", F.when(F.col("label"), 3.0).otherwise(2.0))
    details = s.groupBy("label", F.col("kto_bucket").alias("detail")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    roles = s.select("label", role_fn.binary_role(F.col("actor_role")).alias("role")).filter("role <> 'unknown'").distinct().withColumn("w", F.lit(1.0))
    return sampling.flatten_weights(labels, details, roles)


_SQL_FLAT = """fs AS (SELECT label, kto_bucket AS detail, CASE lower(trim(actor_role, ' ')) WHEN 'crewmate' THEN 'Crewmate' WHEN 'impostor' THEN 'Impostor' END AS role FROM samples WHERE label IS NOT NULL AND kto_bucket IS NOT NULL),
fd AS (SELECT label, detail, count(*) / sum(count(*)) OVER (PARTITION BY label) AS share FROM fs GROUP BY label, detail),
fr AS (SELECT label, role, 1.0::DOUBLE / count(*) OVER (PARTITION BY label) AS share FROM (SELECT DISTINCT label, role FROM fs WHERE role IS NOT NULL))
SELECT d.label, d.detail, r.role, CASE WHEN d.label THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END * d.share * coalesce(r.share, 1.0::DOUBLE) AS weight FROM fd d LEFT JOIN fr r ON r.label = d.label"""


def _oversampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = logs.samples(spark, sf_dir, "label", "kto_bucket").filter("label IS NOT NULL AND kto_bucket IS NOT NULL").select("sample_id", "label", F.col("kto_bucket").alias("bucket"))
    s = staged(s, "pool")
    n = s.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("available")).withColumn("w", F.lit(1.0)).withColumn("name", F.concat_ws("|", "bucket", F.col("label").cast("string")))
    quotas = sampling.largest_remainder(n, s.agg(F.count(F.lit(1))).scalar(), "w", "name").select("label", "bucket", "available", "quota")
    return sampling.with_replacement(s, quotas, ["label", "bucket"], "sample_id", SEED), quotas


def s_oversampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows as there are samples, the same number of each (label, bucket): rare buckets give their rows repeatedly."""
    return _oversampled(spark, sf_dir)[0].select("sample_id", "label", "bucket", "copy_no")


def s_oversampling_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested, available, selected and missing rows of each bucket."""
    return sampling.sample_report(*_oversampled(spark, sf_dir), ["label", "bucket"])


_SQL_OVER = f"""pool AS (SELECT sample_id, label, kto_bucket AS bucket FROM samples WHERE label IS NOT NULL AND kto_bucket IS NOT NULL),
ov_n AS (SELECT label, bucket, count(*) AS available, bucket || '|' || CAST(label AS VARCHAR) AS name FROM pool GROUP BY ALL),
ov_q AS (SELECT label, bucket, available, (SELECT count(*) FROM pool) // (SELECT count(*) FROM ov_n) + CASE WHEN row_number() OVER (ORDER BY name) <= (SELECT count(*) FROM pool) % (SELECT count(*) FROM ov_n) THEN 1 ELSE 0 END AS quota FROM ov_n),
ov_r AS (SELECT *, row_number() OVER (PARTITION BY label, bucket ORDER BY md5('{SEED}|' || sample_id), sample_id) AS place FROM pool JOIN ov_q USING (label, bucket)),
ov AS (SELECT sample_id, label, bucket, CAST(unnest(generate_series(1, (quota - place + available) // available)) AS BIGINT) AS copy_no FROM ov_r WHERE place <= quota)"""


QUERIES = {
    f.__name__: f
    for f in (
        t_rehydrated, g_label_with_fallback, t_prompt_speeches, t_seer_called, g_pk_rounds, g_day_expelled, g_team_f1, g_game_report, s_label_conflicts, g_model_key, s_aux_weight, t_skip_counts, e_action_details,
        e_fact_check, s_relabel_pairs, s_drawn_by_table, s_flat_weights, s_oversampled, s_oversampling_report,
    )
}
ORACLE = {
    "t_rehydrated": with_sql(SQL_ROSTER, _SQL_HITS, "SELECT t.trace_id, t.game_path, t.player_id, t.phase FROM traces t JOIN hits h ON h.game_path = t.game_path AND h.player_id = t.player_id AND h.phase = t.phase WHERE t.prompt <> '' AND t.response <> ''"),
    "g_label_with_fallback": with_sql(SQL_ROSTER, SQL_BELIEFS, _SQL_RECON, _SQL_MOVES, "SELECT night, recon, process, coalesce(recon, process) AS label, count(*) AS moves FROM labelled GROUP BY ALL"),
    "g_pk_rounds": with_sql(_SQL_PK, "SELECT * FROM pk"),
    "g_game_report": with_sql(_SQL_GAME, """SELECT d.file_id, d.seq, d.section, d.player_id AS actor, d.target, d.detail, md5(q.vote_reason) AS reason FROM gd d
      LEFT JOIN gq q ON q.game_path = d.game_path AND q.player_id = d.player_id AND q.phase = d.phase"""),
    "g_day_expelled": with_sql(SQL_ROSTER, _SQL_DAY),
    "g_team_f1": with_sql(SQL_ROSTER, SQL_BELIEFS, _SQL_TEAM, """SELECT p.file_id, p.day, avg(CASE WHEN tp + fp + wolves > 0 THEN 2.0::DOUBLE * tp / (tp + fp + wolves) ELSE 0 END) AS mean_f1, count(*) AS viewers FROM tp p
      JOIN roster r ON r.file_id = p.file_id AND r.player = p.viewer AND r.role IN ('Villager', 'Seer', 'Witch', 'Guard', 'Hunter') JOIN tw w ON w.file_id = p.file_id GROUP BY p.file_id, p.day"""),
    "s_label_conflicts": with_sql("SELECT game_path, phase, CASE WHEN max(label) = min(label) THEN max(label) END AS agreed, count(label) AS observations FROM samples WHERE label IS NOT NULL AND game_path IS NOT NULL AND phase IS NOT NULL GROUP BY ALL"),
    "g_model_key": with_sql("ms AS (SELECT DISTINCT model FROM roles WHERE model <> '')", "SELECT file_id, (SELECT arg_min(model, struct_pack(l := -length(model), m := model)) FROM ms WHERE contains(f.game_path, ms.model)) AS model FROM file_lists f WHERE events IS NOT NULL"),
    "s_aux_weight": with_sql(f"aux_t AS (SELECT {_KIND} AS kind, count(*) AS traces FROM traces GROUP BY ALL)", f"aux_s AS (SELECT {_KIND} AS kind, count(*) AS samples FROM samples GROUP BY ALL)",
        "SELECT kind, coalesce(traces, 0) AS traces, coalesce(samples, 0) AS samples, coalesce(traces, 0)::DOUBLE / nullif(coalesce(samples, 0), 0) AS weight FROM aux_t FULL JOIN aux_s USING (kind)"),
    "t_skip_counts": with_sql(_SQL_SKIPS),
    "e_action_details": with_sql(SQL_ORDERED, *_SQL_DETAILS.split("\nSELECT", 1)[:1], "SELECT" + _SQL_DETAILS.split("\nSELECT", 1)[1]),
    "s_relabel_pairs": with_sql(SQL_ROSTER, SQL_BELIEFS, _SQL_RECON, _SQL_PAIRS.split("\nSELECT", 1)[0], "SELECT" + _SQL_PAIRS.split("\nSELECT", 1)[1]),
    "s_drawn_by_table": with_sql(_sql_drawn().split("\nSELECT", 1)[0], "SELECT" + _sql_drawn().split("\nSELECT", 1)[1]),
    "s_flat_weights": with_sql(_SQL_FLAT.split("\nSELECT", 1)[0], "SELECT" + _SQL_FLAT.split("\nSELECT", 1)[1]),
    "s_oversampled": with_sql(_SQL_OVER, "SELECT * FROM ov"),
    "s_oversampling_report": with_sql(_SQL_OVER, "SELECT q.label, q.bucket, q.quota AS requested, q.available, count(o.sample_id) AS selected, q.quota - count(o.sample_id) AS missing FROM ov_q q LEFT JOIN ov o ON o.label = q.label AND o.bucket = q.bucket GROUP BY q.label, q.bucket, q.quota, q.available"),
}
