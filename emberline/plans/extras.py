"""Further queries: claims in speeches, interval pairings, majorities, interleaving, assignments, verified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from emberline.functions import roles as role_fn
from emberline.functions import text, verdicts
from emberline.operators import matching, ordered, sampling
from emberline.operators.ranking import distributed_rank
from emberline.plans.games import _ROLE_SQL, SQL_ROSTER, _roster
from emberline.plans.samples import SEED, SQL_QUOTA, SQL_REBALANCE, _buckets, s_rebalance
from emberline.sources import logs
from emberline.sources.logs import agent_entries, content_of, game_events, prompt_of, staged_events, with_sql
from emberline.sources.tables import table


#: Calling a player a werewolf, in both languages of the reference, and the negations that take it back.
CALLED = (r"Player[\s\p{Z}]*(\d+)[^\n]{0,80}?(?:werewolf|wolf|狼人)", r"(\d+)号[^\n]{0,40}?狼人")
NOT_CALLED = r"not[\s\p{Z}]+(?:a[\s\p{Z}]+)?(?:werewolf|wolf)|不是[^\n]{0,6}狼人"


def called_wolves(said: Column) -> Column:
    """The numbers of the players whom a speech calls a werewolf, each once; 0 is nobody."""
    found = F.concat(*[F.regexp_extract_all(said, F.lit("(?i)" + p), F.lit(0)) for p in CALLED])
    kept = F.filter(found, lambda x: ~x.rlike("(?i)" + NOT_CALLED))
    numbers = F.transform(kept, lambda x: F.regexp_extract(x, r"(\d+)", 1).try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n > 0))


def x_wolf_accusations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players whom speeches of any wording in both languages call a werewolf, without negated ones; how many of them are."""
    e = staged_events(spark, sf_dir, "god_view", "speech", "speech_pk")
    s = e.filter("event IN ('speech', 'speech_pk')").select("file_id", "source", content_of("speech_content").alias("said"))
    rows = s.select("file_id", "source", F.explode(called_wolves(F.col("said"))).alias("target")).distinct()
    r = _roster(e).select("file_id", F.col("player").alias("target"), "role")
    return rows.join(r, ["file_id", "target"], "left").groupBy("file_id").agg(F.count(F.lit(1)).alias("accusations"), F.count_if(F.col("role") == "Werewolf").alias("right"))


SQL_CALLED = rf"""said AS (SELECT file_id, source, content ->> '$.speech_content' AS said FROM game_events WHERE event IN ('speech', 'speech_pk')),
called AS (SELECT file_id, source, unnest(list_filter(list_concat(regexp_extract_all(said, '{CALLED[0]}', 0, 'i'), regexp_extract_all(said, '{CALLED[1]}', 0, 'i')), lambda x: NOT regexp_matches(x, '{NOT_CALLED}', 'i'))) AS c FROM said),
acc AS (SELECT DISTINCT file_id, source, TRY_CAST(regexp_extract(c, '(\d+)', 1) AS INT) AS target FROM called WHERE TRY_CAST(regexp_extract(c, '(\d+)', 1) AS INT) > 0)"""


#: Claiming a role for oneself, in both languages of the claims.
CLAIMED = r"(?i)I hold the [a-z -]{0,20}?(" + "|".join(role_fn.ALIASES) + r")[a-z]* card|我拿的是(" + "|".join(role_fn.CHINESE) + ")"


def claimed_role(said: Column) -> Column:
    """The first role that a speech claims, by its English name; null where it claims none."""
    either = [F.nullif(F.regexp_extract(said, CLAIMED, i), F.lit("")) for i in (1, 2)]
    return role_fn.role(F.coalesce(*either))


def x_role_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that speakers of both languages claim for themselves in any speech, against their true roles."""
    e = staged_events(spark, sf_dir, "god_view", "speech", "speech_pk")
    s = e.filter("event IN ('speech', 'speech_pk')").select("file_id", F.col("source").alias("player"), "seq", claimed_role(content_of("speech_content")).alias("claim"))
    first = ordered.first_wins(s.filter("claim IS NOT NULL"), ["file_id", "player"], F.col("seq"), "claim")
    return first.join(_roster(e), ["file_id", "player"]).groupBy("claim", "role").agg(F.count(F.lit(1)).alias("players"))


SQL_ROLE_CLAIMS = f"""cl AS (SELECT file_id, source AS player, seq, content ->> '$.speech_content' AS said FROM game_events WHERE event IN ('speech', 'speech_pk')),
cr AS (SELECT file_id, player, seq, coalesce(nullif(regexp_extract(said, '{CLAIMED}', 1), ''), nullif(regexp_extract(said, '{CLAIMED}', 2), '')) AS said FROM cl),
cn AS (SELECT file_id, player, seq, {_ROLE_SQL.format("said")} AS claim FROM cr),
fc AS (SELECT file_id, player, arg_min(claim, seq) AS claim FROM cn WHERE claim IS NOT NULL GROUP BY ALL)"""


def x_interval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech events between the last vote round's end and the next night: events of the same day with nothing else in between."""
    e = game_events(spark, sf_dir).drop("content")
    mark = F.when(F.col("event").isin("end_vote", "end_night"), F.col("seq"))
    e = ordered.first_after(ordered.latest_before(e, ["file_id"], ["seq"], mark, "before"), ["file_id"], ["seq"], mark, "after")
    kinds = e.groupBy("file_id", "before", "after").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event").contains("speech")).alias("speeches"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return kinds.filter("before IS NOT NULL AND after IS NOT NULL AND first_day = last_day").drop("last_day")


SQL_INTERVAL = """iv AS (SELECT file_id, event, day, last_value(CASE WHEN event IN ('end_vote', 'end_night') THEN seq END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(CASE WHEN event IN ('end_vote', 'end_night') THEN seq END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM game_events)
SELECT file_id, before, after, count(*) AS events, count_if(contains(event, 'speech')) AS speeches, min(day) AS first_day FROM iv WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY ALL HAVING min(day) = max(day)"""


def x_half_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote rounds whose leading target has more than half of all votes, abstentions counted among all."""
    v = game_events(spark, sf_dir, "vote", "vote_pk").select("file_id", "day", "event", content_of("vote_target", "int").alias("t"))
    n = v.groupBy("file_id", "day", "event", "t").agg(F.count(F.lit(1)).alias("n"))
    tot = n.groupBy("file_id", "day", "event").agg(F.sum("n").alias("votes"), F.max(F.when(F.col("t") > 0, F.col("n"))).alias("top"))
    return tot.withColumn("decided", F.coalesce(F.col("top") * 2 > F.col("votes"), F.lit(False)))


def x_group_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows interleaved in proportion to their buckets: the row that is most behind comes first."""
    b = _buckets(spark, sf_dir).select("sample_id", "bucket").withColumn("h", sampling.digest_order(SEED, F.col("sample_id")))
    ranked = distributed_rank(b, ["bucket"], [F.col("h"), F.col("sample_id")], "place")
    n = b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    due = ranked.join(n, "bucket").withColumn("due", (F.col("place") - 0.5) / F.col("n"))
    return distributed_rank(due, [], [F.col("due"), F.col("bucket"), F.col("place")], "turn").select("sample_id", "bucket", "turn")


SQL_CYCLE = f"""cy AS (SELECT sample_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5('{SEED}|' || sample_id), sample_id) AS place, count(*) OVER (PARTITION BY bucket) AS n FROM buck)
SELECT sample_id, bucket, row_number() OVER (ORDER BY (place - 0.5::DOUBLE) / n, bucket, place) AS turn FROM cy"""


def x_balanced_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 8 true and 8 false rows of a bucket; the batch's number follows from the row's place among its label."""
    b = _buckets(spark, sf_dir).select("sample_id", "bucket", "label").withColumn("h", sampling.digest_order(SEED, F.col("sample_id")))
    ranked = distributed_rank(b, ["bucket", "label"], [F.col("h"), F.col("sample_id")], "place").withColumn("batch", F.floor((F.col("place") - 1) / 8))
    return ranked.groupBy("bucket", "batch").agg(F.count_if("label").alias("good"), F.count_if(~F.col("label")).alias("bad"))


SQL_BATCHES = f"""ba AS (SELECT bucket, label, CAST(floor((row_number() OVER (PARTITION BY bucket, label ORDER BY md5('{SEED}|' || sample_id), sample_id) - 1) / 8) AS BIGINT) AS batch FROM buck)
SELECT bucket, batch, count_if(label) AS good, count_if(NOT label) AS bad FROM ba GROUP BY ALL"""


def x_weighted_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each game gets a model by chance, in proportion to how many samples the models have: a number against cumulative shares."""
    n = logs.samples(spark, sf_dir, "source_model").filter("source_model IS NOT NULL").groupBy("source_model").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("source_model").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per model
    total = F.sum("n").over(Window.partitionBy())
    upto = n.withColumn("hi", F.sum("n").over(w) / total).withColumn("lo", F.col("hi") - F.col("n") / total)
    bounds = F.array_sort(F.collect_list(F.struct("hi", "source_model")))
    table_ = upto.agg(bounds).scalar()
    g = logs.game_files(spark, sf_dir).select("file_id").withColumn("u", sampling.unit("assign", F.col("file_id")))
    g = g.withColumn("b", table_)
    pick = F.element_at(F.filter("b", lambda x: F.col("u") < x["hi"]), 1)
    return g.select("file_id", pick["source_model"].alias("model"))


SQL_ASSIGN = """mn AS (SELECT source_model, count(*) AS n FROM samples WHERE source_model IS NOT NULL GROUP BY ALL),
mc AS (SELECT source_model, sum(n) OVER (ORDER BY source_model) / (sum(n) OVER ())::DOUBLE AS hi FROM mn),
gu AS (SELECT file_id, CAST(('0x' || substr(md5('assign|' || file_id), 1, 8))::UBIGINT AS DOUBLE) / 4294967296 AS u FROM file_lists WHERE events IS NOT NULL)
SELECT file_id, (SELECT arg_min(source_model, hi) FROM mc WHERE gu.u < mc.hi) AS model FROM gu"""


def x_verified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates verified first, then sampled by their verified label; too few of one label are filled from the other."""
    s = logs.samples(spark, sf_dir, "completion", "label", "kto_bucket").filter("label IS NOT NULL")
    ok = text.valid_messages(F.col("completion"))
    v = s.withColumn("verified", F.col("label") & ok).select("sample_id", "verified")
    q = spark.createDataFrame([(True, 150), (False, 100)], "verified boolean, quota bigint")
    return sampling.round_robin_fill(v, q, ["verified"], "sample_id", SEED, 250).select("sample_id", "verified", "filled")


SQL_VERIFIED = f"""ver AS (SELECT sample_id, label AND coalesce(len(completion) > 0 AND len(list_filter(completion, lambda m: m.role IS NULL OR m.content IS NULL OR trim(m.content, ' ') = '')) = 0, false) AS verified FROM samples WHERE label IS NOT NULL),
vp AS (SELECT *, CASE WHEN verified THEN 150 ELSE 100 END AS quota, row_number() OVER (PARTITION BY verified ORDER BY md5('{SEED}|' || sample_id), sample_id) AS place FROM ver),
vs AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN place > quota THEN 1 ELSE 0 END, CASE WHEN place > quota THEN place - quota ELSE 0 END, verified, place) AS seat FROM vp)
SELECT sample_id, verified, place > quota AS filled FROM vs WHERE seat <= 250"""


def x_replaced_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task rows of a sample replaced by a build of their own: the rows of every action type, balanced by label."""
    b = _buckets(spark, sf_dir).select("sample_id", "bucket", "label")
    rest = b.filter("bucket <> 'task_action'").withColumn("part", F.lit("kept"))
    built = s_rebalance(spark, sf_dir).select("sample_id", F.lit("task_action").alias("bucket"), "label", F.lit("built").alias("part"))
    return rest.unionByName(built).groupBy("part", "bucket", "label").agg(F.count(F.lit(1)).alias("n"))


def x_label_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as text read by both rules: one knows true, false and neither, the other takes all but the words of false for true."""
    word = F.coalesce(F.upper(F.col("label").cast("string")), F.col("kto_bucket"))
    s = logs.samples(spark, sf_dir, "label", "kto_bucket").groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("samples"))
    return s.select("word", verdicts.label_or_null(F.col("word")).alias("strict"), verdicts.label_or_true(F.col("word")).alias("lenient"), "samples")


def x_prompt_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts without those that state a section, by game and language; the notes of traces whose prompt stays."""
    t = logs.traces(spark, sf_dir, "prompt", "phase", "note").filter(~F.col("prompt").contains("Game state"))
    return t.groupBy(F.coalesce(F.col("note").isNotNull(), F.lit(False)).alias("has_note"), F.col("prompt").rlike("号玩家").alias("chinese")).agg(F.count(F.lit(1)).alias("traces"), F.sum(F.length("note")).alias("note_chars"))


def x_roles_of_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role that a prompt gives its player, in either language, against the roster."""
    t = logs.traces(spark, sf_dir, "game_path", "player_id", "prompt")
    said = F.coalesce(text.unless_blank(F.regexp_extract("prompt", r"card (?:is|reads)? ?([A-Z][a-z]+)", 1)), text.unless_blank(F.regexp_extract("prompt", r"(?:身份|底牌是)([一-鿿]{2,3})[，,]", 1)))
    r = logs.roles(spark, sf_dir).select("game_path", F.col("id").alias("player_id"), role_fn.role(F.col("role")).alias("truth"))
    j = t.select("game_path", "player_id", role_fn.role(said).alias("said")).join(r, ["game_path", "player_id"])
    return j.groupBy("said", "truth").agg(F.count(F.lit(1)).alias("traces"))


def _role_case(col: str) -> str:
    from emberline.plans.games import _ROLE_SQL

    return _ROLE_SQL.format(col)


def x_entry_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by what they are: belief update, action, fallback, with belief or without, and their trigger."""
    e = agent_entries(spark, sf_dir)
    trigger = prompt_of("Belief Update Trigger")
    kind = F.when(F.coalesce(prompt_of("Action Repair Fallback", "boolean"), F.lit(False)), "fallback").when(F.col("type") == "role_prediction", "prediction").when(trigger.isNotNull(), "update").otherwise("action")
    point = F.when(prompt_of("Phase").contains("Meeting"), "meeting").when(prompt_of("Phase").contains("Task"), "task")
    timing = F.when(F.col("step") < 15, "early").when(F.col("step") < 35, "middle").otherwise("late")
    return e.groupBy(kind.alias("kind"), F.coalesce(prompt_of("Relational Belief Enabled", "boolean"), F.lit(False)).alias("belief"), point.alias("point"), timing.alias("timing")).agg(F.count(F.lit(1)).alias("entries"), F.max("ts").alias("last"))


SQL_KINDS = """SELECT CASE WHEN coalesce(TRY_CAST(prompt ->> '$."Action Repair Fallback"' AS BOOLEAN), false) THEN 'fallback' WHEN type = 'role_prediction' THEN 'prediction' WHEN prompt ->> '$."Belief Update Trigger"' IS NOT NULL THEN 'update' ELSE 'action' END AS kind,
  coalesce(TRY_CAST(prompt ->> '$."Relational Belief Enabled"' AS BOOLEAN), false) AS belief, CASE WHEN contains(prompt ->> '$.Phase', 'Meeting') THEN 'meeting' WHEN contains(prompt ->> '$.Phase', 'Task') THEN 'task' END AS point,
  CASE WHEN step < 15 THEN 'early' WHEN step < 35 THEN 'middle' ELSE 'late' END AS timing, count(*) AS entries, max(ts) AS last FROM entries GROUP BY ALL"""


def x_cached_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers found in a cache of verdicts on the texts of votes, the rest judged, one judgement per distinct text: does it hold JSON."""
    ok = F.max(text.json_or_fence(F.col("response")).isNotNull()).alias("ok")
    t = logs.traces(spark, sf_dir, "response", "phase").filter("response IS NOT NULL").withColumn("key", F.sha2("response", 256))
    cache = t.filter(F.col("phase").contains("_day_vote")).groupBy("key").agg(ok)
    hit, new = matching.cached_or_new(t, cache, "key")
    judged = new.groupBy("key").agg(ok)
    out = hit.select("trace_id", "ok", F.lit(True).alias("cached")).unionByName(new.join(judged, "key").select("trace_id", "ok", F.lit(False).alias("cached")))
    return out.groupBy("cached", "ok").agg(F.count(F.lit(1)).alias("traces"))


def _tail(sql: str) -> tuple[str, str]:
    head, end = sql.split("\nSELECT", 1)
    return head, "SELECT" + end


QUERIES = {
    f.__name__: f
    for f in (
        x_wolf_accusations, x_role_claims, x_interval_pairs, x_half_majority, x_group_cycle, x_balanced_batches, x_weighted_assignment, x_verified_sample, x_replaced_part, x_label_words, x_prompt_filter, x_roles_of_seats,
        x_entry_kinds, x_cached_verdicts,
    )
}
ORACLE = {
    "x_wolf_accusations": with_sql(SQL_ROSTER, SQL_CALLED, "SELECT a.file_id, count(*) AS accusations, CAST(coalesce(count_if(r.role = 'Werewolf'), 0) AS BIGINT) AS right FROM acc a LEFT JOIN roster r ON r.file_id = a.file_id AND r.player = a.target GROUP BY ALL"),
    "x_role_claims": with_sql(SQL_ROSTER, SQL_ROLE_CLAIMS, "SELECT claim, role, count(*) AS players FROM fc JOIN roster USING (file_id, player) GROUP BY ALL"),
    "x_interval_pairs": with_sql(*_tail(SQL_INTERVAL)),
    "x_half_majority": with_sql("vv AS (SELECT file_id, day, event, TRY_CAST(content ->> '$.vote_target' AS INT) AS t, count(*) AS n FROM game_events WHERE event IN ('vote', 'vote_pk') GROUP BY ALL)",
        "SELECT file_id, day, event, CAST(sum(n) AS BIGINT) AS votes, max(CASE WHEN t > 0 THEN n END) AS top, coalesce(max(CASE WHEN t > 0 THEN n END) * 2 > sum(n), false) AS decided FROM vv GROUP BY ALL"),
    "x_group_cycle": with_sql(SQL_QUOTA, *_tail(SQL_CYCLE)), "x_balanced_batches": with_sql(SQL_QUOTA, *_tail(SQL_BATCHES)), "x_weighted_assignment": with_sql(*_tail(SQL_ASSIGN)),
    "x_verified_sample": with_sql(*_tail(SQL_VERIFIED)),
    "x_replaced_part": with_sql(SQL_QUOTA, SQL_REBALANCE.split("\nSELECT", 1)[0], "reb AS (SELECT" + SQL_REBALANCE.split("\nSELECT", 1)[1] + ")",
        "SELECT part, bucket, label, count(*) AS n FROM (SELECT 'kept' AS part, bucket, label FROM buck WHERE bucket <> 'task_action' UNION ALL SELECT 'built', 'task_action', label FROM reb) GROUP BY ALL"),
    "x_label_words": with_sql("""SELECT coalesce(upper(CAST(label AS VARCHAR)), kto_bucket) AS word, label AS strict, CASE WHEN coalesce(upper(CAST(label AS VARCHAR)), kto_bucket) IS NOT NULL THEN coalesce(label, true) END AS lenient,
      count(*) AS samples FROM samples GROUP BY ALL"""),
    "x_prompt_filter": with_sql("SELECT note IS NOT NULL AS has_note, contains(prompt, '号玩家') AS chinese, count(*) AS traces, CAST(sum(length(note)) AS BIGINT) AS note_chars FROM traces WHERE NOT contains(prompt, 'Game state') GROUP BY ALL"),
    "x_roles_of_seats": with_sql(r"sa AS (SELECT game_path, player_id, coalesce(nullif(regexp_extract(prompt, 'card (?:is|reads)? ?([A-Z][a-z]+)', 1), ''), nullif(regexp_extract(prompt, '(?:身份|底牌是)([\x{4e00}-\x{9fff}]{2,3})[，,]', 1), '')) AS s FROM traces)",
        f"SELECT {_role_case('s')} AS said, {_role_case('r.role')} AS truth, count(*) AS traces FROM sa JOIN roles r ON r.game_path = sa.game_path AND r.id = sa.player_id GROUP BY ALL"),
    "x_entry_kinds": with_sql(SQL_KINDS),
    "x_cached_verdicts": with_sql("SELECT response IN (SELECT response FROM traces WHERE contains(phase, '_day_vote') AND response IS NOT NULL) AS cached, json_valid(response) OR coalesce(json_valid(nullif(regexp_extract(response, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1), '')), false) AS ok, count(*) AS traces FROM traces WHERE response IS NOT NULL GROUP BY ALL"),
}
