"""Queries over the events of the night/day game, each with its SQL: beliefs, votes, nights, lives, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.functions import roles as role_fn
from emberline.functions import text
from emberline.operators import matching, ordered, votes
from emberline.sources import logs
from emberline.sources.logs import content_of, game_events, staged_events, with_sql

_GAME = ["file_id"]
_VOTE_KINDS = ("vote", "vote_pk", "end_vote")


def _roster(events: DataFrame) -> DataFrame:
    """(file_id, player, role) from the first god_view of each file."""
    g = events.filter("event = 'god_view'").withColumn("m", content_of_map())
    first = ordered.first_wins(g, _GAME, F.col("seq"), "m")
    return first.select("file_id", F.explode("m").alias("k", "r")).select("file_id", F.col("k").cast("int").alias("player"), role_fn.role(F.col("r")).alias("role"))


def content_of_map():
    return F.try_variant_get("content", "$", "map<string,string>")


def _beliefs(events: DataFrame) -> DataFrame:
    """(file_id, viewer, day, seq, target, role) of every state_reconstruction; labels that don't parse are left out."""
    e = events.filter("event = 'state_reconstruction'")
    labels = F.try_variant_get(text.json_or_fence(content_of("identity_labels")), "$", "map<string,string>")
    rows = e.select("file_id", F.col("source").alias("viewer"), "day", F.col("time").contains("Night").alias("night"), "seq", F.explode(labels).alias("k", "r"))
    return rows.filter(F.col("k").rlike(r"^Player \d+$")).select(
        "file_id", "viewer", "day", "night", "seq", text.first_number(F.col("k")).alias("target"), role_fn.role(F.col("r")).alias("role"), F.col("r").alias("raw")
    )


_ROLE_SQL = (
    "coalesce(CASE trim({0}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in role_fn.CHINESE.items()) + " END, CASE lower(trim({0})) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in role_fn.ALIASES.items()) + " END, CASE WHEN starts_with(lower(trim({0})), 'unknown') THEN 'Unknown' END, CASE "
    + " ".join(f"WHEN contains(lower(trim({{0}})), '{a}') THEN '{b}'" for a, b in role_fn.PARTS)
    + " END, CASE regexp_replace(lower(trim({0})), '[^a-z]', '', 'g') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in role_fn.LETTERS.items()) + " END)"
)
SQL_ROSTER = f"""god AS (SELECT file_id, arg_min(content, seq) AS m FROM game_events WHERE event = 'god_view' AND json_type(content) = 'OBJECT' GROUP BY file_id),
god_keys AS (SELECT file_id, m, unnest(json_keys(m)) AS k FROM god),
roster AS (SELECT file_id, CAST(k AS INT) AS player, {_ROLE_SQL.format("(m ->> ('$.\"' || k || '\"'))")} AS role FROM god_keys WHERE (m ->> ('$."' || k || '"')) IS NOT NULL)"""
SQL_BELIEFS = f"""recon AS (SELECT file_id, source AS viewer, day, contains(time, 'Night') AS night, seq, content ->> '$.identity_labels' AS t FROM game_events WHERE event = 'state_reconstruction'),
recon_json AS (SELECT * EXCLUDE (t), CASE WHEN json_valid(t) THEN t::JSON WHEN json_valid(nullif(regexp_extract(t, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1), '')) THEN regexp_extract(t, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1)::JSON END AS j FROM recon),
recon_keys AS (SELECT *, unnest(json_keys(j)) AS k FROM recon_json WHERE json_type(j) = 'OBJECT'),
beliefs AS (SELECT file_id, viewer, day, night, seq, CAST(regexp_extract(k, '(\\d+)', 1) AS INT) AS target, {_ROLE_SQL.format("(j ->> ('$.\"' || k || '\"'))")} AS role
  FROM recon_keys WHERE regexp_matches(k, '^Player \\d+$'))"""


def g_votes_with_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes per game and day by the voter's and the target's role: an inner join with each file's roster."""
    e = staged_events(spark, sf_dir, "god_view", "vote", "vote_pk")
    v = e.filter("event IN ('vote', 'vote_pk')").select("file_id", "event", "source", F.nullif(content_of("vote_target", "int"), F.lit(0)).alias("t"))
    r = _roster(e)
    rows = v.join(r.select("file_id", F.col("player").alias("source"), F.col("role").alias("voter_role")), ["file_id", "source"])
    rows = rows.join(r.select("file_id", F.col("player").alias("t"), F.col("role").alias("target_role")), ["file_id", "t"], "left")
    return rows.groupBy("event", "voter_role", "target_role").agg(F.count(F.lit(1)).alias("votes"))


SQL_VOTES = """SELECT v.event, a.role AS voter_role, b.role AS target_role, count(*) AS votes FROM (SELECT file_id, event, source, nullif(TRY_CAST(content ->> '$.vote_target' AS INT), 0) AS t
  FROM game_events WHERE event IN ('vote', 'vote_pk')) v JOIN roster a ON a.file_id = v.file_id AND a.player = v.source LEFT JOIN roster b ON b.file_id = v.file_id AND b.player = v.t GROUP BY ALL"""


def _vote_rows(events: DataFrame) -> DataFrame:
    """(file_id, day, event, source, target) with 0 for abstaining, and the place of the day's outcome that follows."""
    e = events.filter("event IN ('vote', 'vote_pk', 'end_vote')")
    e = ordered.first_after(e, _GAME, ["seq"], F.when(F.col("event") == "end_vote", F.col("seq")), "outcome_seq")
    return e.filter("event <> 'end_vote'").select("file_id", "day", "event", "outcome_seq", "source", content_of("vote_target", "int").alias("target"))


def g_vote_plurality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vote round: who has most votes, null on a tie; abstentions don't count."""
    return _plurality(game_events(spark, sf_dir, *_VOTE_KINDS))


def _plurality(events: DataFrame) -> DataFrame:
    v = _vote_rows(events).withColumn("choice", F.nullif(F.col("target"), F.lit(0)))
    counts = votes.tally(v, ["file_id", "day", "outcome_seq"], "choice")
    return votes.plurality(counts, ["file_id", "day", "outcome_seq"], "choice")


SQL_ROUNDS = """rounds AS (SELECT file_id, day, event, source, TRY_CAST(content ->> '$.vote_target' AS INT) AS target,
  first_value(CASE WHEN event = 'end_vote' THEN seq END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS outcome_seq
  FROM (SELECT * FROM game_events WHERE event IN ('vote', 'vote_pk', 'end_vote'))),
tallies AS (SELECT file_id, day, outcome_seq, target AS choice, count(*) AS votes FROM rounds WHERE event <> 'end_vote' AND target <> 0 GROUP BY ALL),
tops AS (SELECT file_id, day, outcome_seq, max(votes) AS top_votes FROM tallies GROUP BY ALL),
plural AS (SELECT t.file_id, t.day, t.outcome_seq, t.top_votes, CAST(count(*) AS INT) AS tied, CASE WHEN count(*) = 1 THEN max(c.choice) END AS winner
  FROM tops t JOIN tallies c ON c.file_id = t.file_id AND c.day IS NOT DISTINCT FROM t.day AND c.outcome_seq IS NOT DISTINCT FROM t.outcome_seq AND c.votes = t.top_votes GROUP BY ALL)"""


def g_vote_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed winners of vote rounds against the logged outcomes."""
    e = staged_events(spark, sf_dir, *_VOTE_KINDS)
    ends = e.filter("event = 'end_vote'").select("file_id", F.col("seq").alias("outcome_seq"), content_of("expelled", "int").alias("expelled"), content_of("vote_outcome").alias("vote_outcome"))
    w = _plurality(e).select("file_id", "outcome_seq", "winner", "tied")
    rows = ends.join(w, ["file_id", "outcome_seq"], "left")
    kind = F.when(F.col("expelled").isNull() & F.col("winner").isNull(), "no one, agreed").when(F.col("expelled") == F.col("winner"), "same").when(F.col("expelled").isNull(), "not expelled").when(F.col("winner").isNull(), "not unique").otherwise("other")
    return rows.groupBy(kind.alias("audit")).agg(F.count(F.lit(1)).alias("rounds"), F.count_if(F.col("vote_outcome").rlike(r"^-?\d+$")).alias("numeric_outcomes"))


SQL_AUDIT = r"""SELECT CASE WHEN expelled IS NULL AND winner IS NULL THEN 'no one, agreed' WHEN expelled = winner THEN 'same' WHEN expelled IS NULL THEN 'not expelled' WHEN winner IS NULL THEN 'not unique' ELSE 'other' END AS audit,
  count(*) AS rounds, count_if(regexp_matches(vote_outcome, '^-?\d+$')) AS numeric_outcomes FROM (SELECT e.file_id, TRY_CAST(e.content ->> '$.expelled' AS INT) AS expelled, e.content ->> '$.vote_outcome' AS vote_outcome, p.winner
  FROM game_events e LEFT JOIN plural p ON p.file_id = e.file_id AND p.outcome_seq = e.seq WHERE e.event = 'end_vote') GROUP BY ALL"""


def g_majority_belief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the other players believe about each speaker on a day: the majority role, Tie, or null; last belief of a viewer counts."""
    e = staged_events(spark, sf_dir, "state_reconstruction", "speech", "speech_pk", bare=("speech", "speech_pk"))
    b = ordered.last_wins(_beliefs(e).filter("NOT night"), ["file_id", "viewer", "day", "target"], F.col("seq"), "role")
    s = e.filter("event IN ('speech', 'speech_pk')").select("file_id", "day", F.col("source").alias("speaker")).distinct()
    seen = matching.other_rows(s, b.withColumnRenamed("target", "speaker"), ["file_id", "day", "speaker"], F.col("viewer") != F.col("speaker"))
    keys = ["file_id", "day", "speaker"]
    p = votes.plurality(votes.tally(seen, keys, "role"), keys, "role")
    wolves = seen.groupBy(*keys).agg(F.count_if(F.col("role") == "Werewolf").alias("wolf_beliefs"))
    out = s.join(p, keys, "left").join(wolves, keys, "left")
    return out.select(*keys, F.when(F.col("tied") > 1, "Tie").otherwise(F.col("winner")).alias("majority"), F.coalesce("wolf_beliefs", F.lit(0)).alias("wolf_beliefs"))


SQL_MAJORITY = """last_b AS (SELECT file_id, viewer, day, target, arg_max(struct_pack(r := role), seq).r AS role FROM beliefs WHERE NOT night GROUP BY ALL),
speakers AS (SELECT DISTINCT file_id, day, source AS speaker FROM game_events WHERE event IN ('speech', 'speech_pk')),
seen AS (SELECT s.*, b.role FROM speakers s JOIN last_b b ON b.file_id = s.file_id AND b.day = s.day AND b.target = s.speaker AND b.viewer <> s.speaker),
seen_n AS (SELECT file_id, day, speaker, role, count(*) AS n FROM seen WHERE role IS NOT NULL GROUP BY ALL),
best AS (SELECT file_id, day, speaker, CASE WHEN count(*) > 1 THEN 'Tie' ELSE max(role) END AS majority FROM seen_n c WHERE n = (SELECT max(n) FROM seen_n d WHERE d.file_id = c.file_id AND d.day = c.day AND d.speaker = c.speaker) GROUP BY ALL)"""
SQL_MAJORITY_END = """SELECT s.file_id, s.day, s.speaker, b.majority, coalesce(w.n, 0) AS wolf_beliefs FROM speakers s LEFT JOIN best b USING (file_id, day, speaker)
  LEFT JOIN (SELECT file_id, day, speaker, count_if(role = 'Werewolf') AS n FROM seen GROUP BY ALL) w USING (file_id, day, speaker)"""


def g_best_belief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One belief per (file, viewer, day, target): day before night, then the later one."""
    rows = _beliefs(game_events(spark, sf_dir, "state_reconstruction")).withColumn("rank", F.struct((~F.col("night")).cast("int").alias("p"), "seq"))
    return ordered.last_wins(rows, ["file_id", "viewer", "day", "target"], F.col("rank"), "role", "night")


SQL_BEST = """ranked_b AS (SELECT *, row_number() OVER (PARTITION BY file_id, viewer, day, target ORDER BY CASE WHEN night THEN 0 ELSE 1 END DESC, seq DESC) AS rn FROM beliefs)
SELECT file_id, viewer, day, target, role, night FROM ranked_b WHERE rn = 1"""


def g_belief_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per viewer and belief: share of known players whose role is right, whether all special roles are, and the wolf F1."""
    e = staged_events(spark, sf_dir, "state_reconstruction", "god_view")
    b = _beliefs(e).join(_roster(e).select("file_id", F.col("player").alias("target"), F.col("role").alias("truth")), ["file_id", "target"])
    wolf, said = F.col("truth") == "Werewolf", F.coalesce(F.col("role") == "Werewolf", F.lit(False))
    known = F.coalesce(F.col("role") != "Unknown", F.lit(False))
    agg = b.groupBy("file_id", "viewer", "day", "seq").agg(
        F.avg(F.when(known, (F.col("role") == F.col("truth")).cast("double"))).alias("accuracy"),
        F.bool_and(F.when(F.col("truth") != "Villager", F.coalesce(F.col("role") == F.col("truth"), F.lit(False)))).alias("specials_right"),
        F.count_if(wolf & said).alias("tp"), F.count_if(~wolf & said).alias("fp"), F.count_if(wolf & ~said).alias("fn"),
    )
    return agg.select("file_id", "viewer", "day", "seq", "accuracy", (F.col("accuracy") >= 0.6).alias("good"), "specials_right", votes.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("wolf_f1"))


SQL_ACCURACY = """SELECT b.file_id, viewer, day, seq, avg(CASE WHEN b.role <> 'Unknown' THEN CAST(b.role = r.role AS DOUBLE) END) AS accuracy, avg(CASE WHEN b.role <> 'Unknown' THEN CAST(b.role = r.role AS DOUBLE) END) >= 0.6 AS good,
  bool_and(CASE WHEN r.role <> 'Villager' THEN coalesce(b.role = r.role, false) END) AS specials_right,
  CASE WHEN 2 * count_if(r.role = 'Werewolf' AND b.role = 'Werewolf') + count_if(r.role <> 'Werewolf' AND b.role = 'Werewolf') + count_if(r.role = 'Werewolf' AND coalesce(b.role, '') <> 'Werewolf') > 0
   THEN 2.0::DOUBLE * count_if(r.role = 'Werewolf' AND b.role = 'Werewolf') / (2 * count_if(r.role = 'Werewolf' AND b.role = 'Werewolf') + count_if(r.role <> 'Werewolf' AND b.role = 'Werewolf') + count_if(r.role = 'Werewolf' AND coalesce(b.role, '') <> 'Werewolf')) ELSE 0 END AS wolf_f1
  FROM beliefs b JOIN roster r ON r.file_id = b.file_id AND r.player = b.target GROUP BY ALL"""


def g_speech_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes that each speaker gets in the vote round of the same kind and day; 0 where nobody votes for them."""
    e = staged_events(spark, sf_dir, "vote", "vote_pk", "speech", "speech_pk", bare=("speech", "speech_pk"))
    s = e.filter("event IN ('speech', 'speech_pk')").select("file_id", "day", F.replace("event", F.lit("speech"), F.lit("vote")).alias("round"), F.col("source").alias("player")).distinct()
    v = e.filter("event IN ('vote', 'vote_pk')").select("file_id", "day", F.col("event").alias("round"), content_of("vote_target", "int").alias("player"))
    n = v.groupBy("file_id", "day", "round", "player").agg(F.count(F.lit(1)).alias("n"))
    return s.join(n, ["file_id", "day", "round", "player"], "left").withColumn("votes", F.coalesce("n", F.lit(0))).drop("n")


SQL_SPEECH_VOTES = """SELECT s.file_id, s.day, s.round, s.player, count(v.file_id) AS votes FROM (SELECT DISTINCT file_id, day, replace(event, 'speech', 'vote') AS round, source AS player FROM game_events WHERE event IN ('speech', 'speech_pk')) s
  LEFT JOIN (SELECT file_id, day, event AS round, TRY_CAST(content ->> '$.vote_target' AS INT) AS player FROM game_events WHERE event IN ('vote', 'vote_pk')) v USING (file_id, day, round, player) GROUP BY ALL"""


def _deaths(e: DataFrame) -> DataFrame:
    night = e.filter("event = 'end_night'").select("file_id", "seq", F.explode(content_of("dead_list", "array<int>")).alias("player"))
    day = e.filter("event = 'end_vote'").select("file_id", "seq", content_of("expelled", "int").alias("player")).filter("player IS NOT NULL")
    return night.unionAll(day).groupBy("file_id", "player").agg(F.min("seq").alias("death_seq"))


def g_alive_at_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players alive at the first vote of each round, and votes for players who aren't."""
    every = staged_events(spark, sf_dir, "god_view", "end_night", *_VOTE_KINDS)
    e = every.filter("event IN ('vote', 'vote_pk')")
    first = e.groupBy("file_id", "day", "event").agg(F.min("seq").alias("at"))
    d = _deaths(every)
    alive = first.join(_roster(every), "file_id").join(d, ["file_id", "player"], "left")
    living = F.col("death_seq").isNull() | (F.col("death_seq") >= F.col("at"))
    alive = alive.groupBy("file_id", "day", "event").agg(F.count_if(living).alias("alive"), F.count_if(living & (F.col("role") == "Werewolf")).alias("wolves_alive"))
    cast = e.select("file_id", "day", "event", content_of("vote_target", "int").alias("player")).join(first, ["file_id", "day", "event"]).join(d, ["file_id", "player"])
    dead = cast.filter(F.col("death_seq") < F.col("at")).groupBy("file_id", "day", "event").agg(F.count(F.lit(1)).alias("n"))
    return alive.join(dead, ["file_id", "day", "event"], "left").withColumn("votes_for_dead", F.coalesce("n", F.lit(0))).drop("n")


SQL_DEATHS = """deaths AS (SELECT file_id, player, min(seq) AS death_seq FROM (SELECT file_id, seq, CAST(unnest(content ->> '$.dead_list[*]') AS INT) AS player FROM game_events WHERE event = 'end_night'
  UNION ALL SELECT file_id, seq, TRY_CAST(content ->> '$.expelled' AS INT) FROM game_events WHERE event = 'end_vote' AND TRY_CAST(content ->> '$.expelled' AS INT) IS NOT NULL) GROUP BY ALL),
firsts AS (SELECT file_id, day, event, min(seq) AS at_ FROM game_events WHERE event IN ('vote', 'vote_pk') GROUP BY ALL)"""
SQL_ALIVE = """SELECT f.file_id, f.day, f.event, count_if(d.death_seq IS NULL OR d.death_seq >= at_) AS alive, count_if((d.death_seq IS NULL OR d.death_seq >= at_) AND r.role = 'Werewolf') AS wolves_alive,
  (SELECT count(*) FROM game_events e JOIN deaths x ON x.file_id = e.file_id AND x.player = TRY_CAST(e.content ->> '$.vote_target' AS INT) WHERE e.file_id = f.file_id AND e.day = f.day AND e.event = f.event AND x.death_seq < f.at_) AS votes_for_dead
  FROM firsts f JOIN roster r ON r.file_id = f.file_id LEFT JOIN deaths d ON d.file_id = r.file_id AND d.player = r.player GROUP BY f.file_id, f.day, f.event, f.at_"""


def g_night_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per night: the kill decision, guard, heal and poison, and who should be dead; compared with the logged list."""
    e = game_events(spark, sf_dir, "kill_decision", "skill_guard", "skill_witch", "end_night")
    night = e.groupBy("file_id", "day").agg(
        F.max(F.when(F.col("event") == "kill_decision", F.nullif(content_of("kill_decision", "int"), F.lit(0)))).alias("killed"),
        F.max(F.when(F.col("event") == "skill_guard", F.nullif(content_of("protected", "int"), F.lit(0)))).alias("guarded"),
        F.max(F.when(F.col("event") == "skill_witch", F.nullif(content_of("heal", "int"), F.lit(0)))).alias("healed"),
        F.max(F.when(F.col("event") == "skill_witch", F.nullif(content_of("poison", "int"), F.lit(0)))).alias("poisoned"),
        F.count_if(F.col("event") == "end_night").alias("ends"),
    ).filter("ends > 0")
    guard, heal = F.coalesce(F.col("guarded") == F.col("killed"), F.lit(False)), F.coalesce(F.col("healed") == F.col("killed"), F.lit(False))
    dies = F.col("killed").isNotNull() & (guard == heal)  # neither, or both
    dead = F.array_sort(F.array_distinct(F.array_compact(F.array(F.when(dies, F.col("killed")), F.col("poisoned")))))
    return night.select("file_id", "day", "killed", "guarded", "healed", "poisoned", F.array_join(dead, ",").alias("dead"))


SQL_NIGHT = """nights AS (SELECT file_id, day, max(CASE WHEN event = 'kill_decision' THEN nullif(TRY_CAST(content ->> '$.kill_decision' AS INT), 0) END) AS killed,
  max(CASE WHEN event = 'skill_guard' THEN nullif(TRY_CAST(content ->> '$.protected' AS INT), 0) END) AS guarded, max(CASE WHEN event = 'skill_witch' THEN nullif(TRY_CAST(content ->> '$.heal' AS INT), 0) END) AS healed,
  max(CASE WHEN event = 'skill_witch' THEN nullif(TRY_CAST(content ->> '$.poison' AS INT), 0) END) AS poisoned, count_if(event = 'end_night') AS ends FROM game_events GROUP BY ALL)
SELECT file_id, day, killed, guarded, healed, poisoned, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN killed IS NOT NULL AND coalesce(guarded = killed, false) = coalesce(healed = killed, false) THEN killed END, poisoned], lambda x: x IS NOT NULL))), ',') AS dead
  FROM nights WHERE ends > 0"""


def g_kill_plurality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wolves' choice per night: plurality, on a tie the last wolf that chose anybody."""
    k = staged_events(spark, sf_dir, "skill_wolf").select("file_id", "day", "seq", F.nullif(content_of("kill_target", "int"), F.lit(0)).alias("choice"))
    p = votes.plurality(votes.tally(k, ["file_id", "day"], "choice"), ["file_id", "day"], "choice")
    last = ordered.last_wins(k.filter("choice IS NOT NULL"), ["file_id", "day"], F.col("seq"), "choice")
    return p.join(last, ["file_id", "day"]).select("file_id", "day", "top_votes", F.coalesce("winner", "choice").alias("decision"))


SQL_KILL = """kills AS (SELECT file_id, day, seq, TRY_CAST(content ->> '$.kill_target' AS INT) AS choice FROM game_events WHERE event = 'skill_wolf' AND TRY_CAST(content ->> '$.kill_target' AS INT) <> 0),
kill_n AS (SELECT file_id, day, choice, count(*) AS n FROM kills GROUP BY ALL),
kill_top AS (SELECT file_id, day, max(n) AS top_votes FROM kill_n GROUP BY ALL)
SELECT t.file_id, t.day, t.top_votes, CASE WHEN (SELECT count(*) FROM kill_n c WHERE c.file_id = t.file_id AND c.day = t.day AND c.n = t.top_votes) = 1
  THEN (SELECT max(choice) FROM kill_n c WHERE c.file_id = t.file_id AND c.day = t.day AND c.n = t.top_votes) ELSE (SELECT arg_max(choice, seq) FROM kills k WHERE k.file_id = t.file_id AND k.day = t.day) END AS decision FROM kill_top t"""


def g_seer_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of players who were checked before by the same seer."""
    c = game_events(spark, sf_dir, "skill_seer").filter("target IS NOT NULL").select("file_id", "source", "target", "day", "seq")
    return ordered.seen_before(c, ["file_id", "source", "target"], ["seq"], "again")


def g_potion_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each speech whether it follows the first day on which the witch used a potion."""
    e = staged_events(spark, sf_dir, "skill_witch", "speech", bare=("speech",))
    used = e.filter((F.col("event") == "skill_witch") & (F.coalesce(content_of("heal", "int"), content_of("poison", "int"), F.lit(0)) > 0)).groupBy("file_id").agg(F.min("day").alias("first_day"))
    s = e.filter("event = 'speech'").join(used, "file_id", "left")
    return s.groupBy("file_id", "day").agg(F.count(F.lit(1)).alias("speeches"), F.max(F.coalesce(F.col("day") > F.col("first_day"), F.lit(False))).alias("after_potion"))


def g_win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games and wins per matchup from the outcome of each file's last event."""
    every = game_events(spark, sf_dir).withColumn("content", F.when(F.col("event") == "end_game", F.col("content")))
    last = ordered.last_wins(every.withColumn("outcome", F.when(F.col("event") == "end_game", content_of("outcome", "int"))), ["file_id", "matchup"], F.col("seq"), "outcome")
    return last.groupBy("matchup").agg(
        F.count(F.lit(1)).alias("games"), F.count_if(F.col("outcome") == 1).alias("wolf_wins"), F.count_if(F.col("outcome") == -1).alias("good_wins"), F.avg((F.col("outcome") == 1).cast("double")).alias("wolf_rate")
    )


SQL_WINS = """lasts AS (SELECT file_id, matchup, arg_max(struct_pack(o := CASE WHEN event = 'end_game' THEN TRY_CAST(content ->> '$.outcome' AS INT) END), seq).o AS outcome FROM game_events GROUP BY ALL)
SELECT matchup, count(*) AS games, count_if(outcome = 1) AS wolf_wins, count_if(outcome = -1) AS good_wins, avg(CAST(outcome = 1 AS DOUBLE)) AS wolf_rate FROM lasts GROUP BY matchup"""


def g_vote_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voters per target and round as text, in order, abstentions under 0."""
    v = _vote_rows(game_events(spark, sf_dir, *_VOTE_KINDS))
    voters = F.array_sort(F.collect_list("source"))
    return v.groupBy("file_id", "outcome_seq", "event", "target").agg(voters.alias("__v"), F.count(F.lit(1)).alias("votes")).select(
        "file_id", "outcome_seq", "event", "target", F.array_join(F.transform("__v", lambda x: x.cast("string")), ",").alias("voters"), "votes"
    )


SQL_REPORT = """SELECT file_id, outcome_seq, event, target, array_to_string(list_sort(list(source)), ',') AS voters, count(*) AS votes FROM rounds WHERE event <> 'end_vote' GROUP BY ALL"""


def g_vote_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the good side: a low-level label from the voter's own belief and one from the round's outcome, combined with three values."""
    e = staged_events(spark, sf_dir, "god_view", "state_reconstruction", *_VOTE_KINDS)
    roster = _roster(e)
    v = _vote_rows(e).join(roster.select("file_id", F.col("player").alias("source"), F.col("role").alias("voter_role")), ["file_id", "source"]).filter("voter_role <> 'Werewolf'")
    b = ordered.last_wins(_beliefs(e).filter("NOT night"), ["file_id", "viewer", "day", "target"], F.col("seq"), "role").withColumnsRenamed({"viewer": "source", "role": "believed"})
    w = _plurality(e).join(roster.select("file_id", F.col("player").alias("winner"), F.col("role").alias("winner_role")), ["file_id", "winner"], "left")
    w = w.select("file_id", "outcome_seq", F.coalesce(F.col("winner_role") == "Werewolf", F.lit(False)).alias("outcome"))
    rows = v.join(b, ["file_id", "source", "day", "target"], "left").join(w, ["file_id", "outcome_seq"], "left")
    low = F.when(F.col("target") == F.col("source"), False).when(F.col("believed") == "Werewolf", True).when(F.col("believed").isin("Seer", "Witch", "Guard", "Hunter", "Villager"), False)
    label = matching.combine_labels(low, F.col("outcome"))
    return rows.groupBy(low.alias("low"), "outcome", label.alias("label")).agg(F.count(F.lit(1)).alias("votes"))


SQL_LABELS = """last_day AS (SELECT file_id, viewer, day, target, arg_max(struct_pack(r := role), seq).r AS role FROM beliefs WHERE NOT night GROUP BY ALL),
outs AS (SELECT p.file_id, p.outcome_seq, coalesce(r.role = 'Werewolf', false) AS outcome FROM plural p LEFT JOIN roster r ON r.file_id = p.file_id AND r.player = p.winner),
voted AS (SELECT v.*, CASE WHEN v.target = v.source THEN false WHEN b.role = 'Werewolf' THEN true WHEN b.role IN ('Seer','Witch','Guard','Hunter','Villager') THEN false END AS low, o.outcome
  FROM rounds v JOIN roster r ON r.file_id = v.file_id AND r.player = v.source AND r.role <> 'Werewolf' LEFT JOIN last_day b ON b.file_id = v.file_id AND b.viewer = v.source AND b.day = v.day AND b.target = v.target
  LEFT JOIN outs o ON o.file_id = v.file_id AND o.outcome_seq = v.outcome_seq WHERE v.event <> 'end_vote')
SELECT low, outcome, CASE WHEN outcome IS NULL THEN NULL WHEN low = false THEN false WHEN low = true OR outcome = true THEN true END AS label, count(*) AS votes FROM voted GROUP BY ALL"""

QUERIES = {
    f.__name__: f
    for f in (
        g_votes_with_roles, g_vote_plurality, g_vote_audit, g_majority_belief, g_best_belief, g_belief_accuracy, g_speech_votes, g_alive_at_vote, g_night_resolution, g_kill_plurality, g_seer_recheck,
        g_potion_days, g_win_rates, g_vote_report, g_vote_labels,
    )
}
ORACLE = {
    "g_votes_with_roles": with_sql(SQL_ROSTER, SQL_VOTES), "g_vote_plurality": with_sql(SQL_ROUNDS, "SELECT * FROM plural"), "g_vote_audit": with_sql(SQL_ROUNDS, SQL_AUDIT),
    "g_majority_belief": with_sql(SQL_BELIEFS, SQL_MAJORITY, SQL_MAJORITY_END), "g_best_belief": with_sql(SQL_BELIEFS, *SQL_BEST.rsplit("\n", 1)), "g_belief_accuracy": with_sql(SQL_ROSTER, SQL_BELIEFS, SQL_ACCURACY),
    "g_speech_votes": with_sql(SQL_SPEECH_VOTES), "g_alive_at_vote": with_sql(SQL_ROSTER, SQL_DEATHS, SQL_ALIVE), "g_night_resolution": with_sql(*SQL_NIGHT.split("\nSELECT", 1)[:1], "SELECT" + SQL_NIGHT.split("\nSELECT", 1)[1]),
    "g_kill_plurality": with_sql(SQL_KILL.split("\nSELECT", 1)[0], "SELECT" + SQL_KILL.split("\nSELECT", 1)[1]),
    "g_seer_recheck": with_sql("SELECT file_id, source, target, day, seq, row_number() OVER (PARTITION BY file_id, source, target ORDER BY seq) > 1 AS again FROM game_events WHERE event = 'skill_seer' AND target IS NOT NULL"),
    "g_potion_days": with_sql("""used AS (SELECT file_id, min(day) AS first_day FROM game_events WHERE event = 'skill_witch' AND coalesce(TRY_CAST(content ->> '$.heal' AS INT), TRY_CAST(content ->> '$.poison' AS INT), 0) > 0 GROUP BY ALL)""",
        "SELECT e.file_id, e.day, count(*) AS speeches, bool_or(coalesce(e.day > u.first_day, false)) AS after_potion FROM game_events e LEFT JOIN used u USING (file_id) WHERE e.event = 'speech' GROUP BY ALL"),
    "g_win_rates": with_sql(SQL_WINS.split("\nSELECT", 1)[0], "SELECT" + SQL_WINS.split("\nSELECT", 1)[1]), "g_vote_report": with_sql(SQL_ROUNDS, SQL_REPORT),
    "g_vote_labels": with_sql(SQL_ROSTER, SQL_BELIEFS, SQL_ROUNDS, SQL_LABELS.split("\nSELECT", 1)[0], "SELECT" + SQL_LABELS.split("\nSELECT", 1)[1]),
}
