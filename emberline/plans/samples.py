"""Queries over preference samples, documents and the star tables: quotas, chance, splits, summaries, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.functions import phases
from emberline.operators import matching, ordered, sampling
from emberline.sources import logs
from emberline.sources.logs import with_sql
from emberline.sources.tables import table

SEED = "s-1"
# Chance to keep a sample of a kind and day, and the mean number of further copies.
KEEP = {("speech", 1): (0.9, 0.0), ("speech", 2): (0.9, 0.0), ("vote", 1): (0.4, 0.0), ("vote", 2): (0.8, 0.0), ("vote", 3): (1.0, 0.99), ("action", 1): (0.5, 0.0), ("action", 2): (1.0, 1.98)}


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, bucket, label) of labelled samples."""
    return logs.samples(spark, sf_dir, "kto_bucket", "label", "phase", "source_model", "actor_role").filter("label IS NOT NULL AND kto_bucket IS NOT NULL").withColumnRenamed("kto_bucket", "bucket")


def _quotas(spark: SparkSession, sf_dir: str, total: int) -> DataFrame:
    """Quotas of (bucket, label) in proportion to 3 for true and 2 for false, by largest remainder."""
    b = _buckets(spark, sf_dir).groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("available"))
    b = b.withColumn("w", F.when(F.col("label"), 3.0).otherwise(2.0)).withColumn("name", F.concat_ws("|", "bucket", F.col("label").cast("string")))
    return sampling.largest_remainder(b, F.lit(total), "w", "name").select("bucket", "label", "available", "quota")


def s_quota_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest-remainder quotas of 300 rows, and the largest total that keeps the shares exactly."""
    q = _quotas(spark, sf_dir, 300)
    whole = q.agg(F.sum(F.when(F.col("label"), 3.0).otherwise(2.0)).alias("w")).scalar()
    feasible = q.agg(F.min(F.floor(F.col("available") * whole / F.when(F.col("label"), 3.0).otherwise(2.0)))).scalar()
    return q.withColumn("feasible", feasible)


SQL_QUOTA = """buck AS (SELECT sample_id, kto_bucket AS bucket, label, phase, source_model, actor_role FROM samples WHERE label IS NOT NULL AND kto_bucket IS NOT NULL),
avail AS (SELECT bucket, label, count(*) AS available, CASE WHEN label THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END AS w, bucket || '|' || CAST(label AS VARCHAR) AS name FROM buck GROUP BY ALL),
shares AS (SELECT *, w / sum(w) OVER () * 300 AS share FROM avail),
floors AS (SELECT *, CAST(floor(share) AS BIGINT) AS fl, round(share - floor(share), 9) AS rest FROM shares),
quotas AS (SELECT bucket, label, available, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, w DESC, name) <= 300 - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM floors)"""


def s_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quota sample, and what fills the shortage of scarce buckets in turn."""
    b = _buckets(spark, sf_dir).select("sample_id", "bucket", "label")
    q = _quotas(spark, sf_dir, 300).select("bucket", "label", "quota")
    return sampling.round_robin_fill(b, q, ["bucket", "label"], "sample_id", SEED, 300).select("sample_id", "bucket", "label", "place", "filled")


SQL_STRATIFIED = f"""placed AS (SELECT b.sample_id, b.bucket, b.label, q.quota, row_number() OVER (PARTITION BY b.bucket, b.label ORDER BY md5('{SEED}|' || b.sample_id), b.sample_id) AS place FROM buck b JOIN quotas q ON q.bucket = b.bucket AND q.label = b.label),
seated AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN place > quota THEN 1 ELSE 0 END, CASE WHEN place > quota THEN place - quota ELSE 0 END, bucket, label, place) AS seat FROM placed)
SELECT sample_id, bucket, label, place, place > quota AS filled FROM seated WHERE seat <= 300"""


def s_keep_or_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples kept by chance and copied, by kind and day of their phase; kinds without an entry are kept once."""
    s = _buckets(spark, sf_dir).withColumn("kind", phases.sample_type(F.lower("phase"))).withColumn("day", phases.phase_day(F.col("phase")))
    keep, extra = F.lit(1.0), F.lit(0.0)
    for (kind, day), (p, more) in KEEP.items():
        here = (F.col("kind") == kind) & (F.col("day") == day)
        keep, extra = F.when(here, p).otherwise(keep), F.when(here, more).otherwise(extra)
    return sampling.keep_or_copy(s, SEED, "sample_id", keep, extra).select("sample_id", "kind", "day", "copy_no")


_U = "CAST(('0x' || substr(md5({0}), 1, 8))::UBIGINT AS DOUBLE) / 4294967296"
_CASE = lambda i: "CASE " + " ".join(f"WHEN kind = '{k}' AND day = {d} THEN {v[i]}::DOUBLE" for (k, d), v in KEEP.items())
SQL_KEEP = f"""kinds AS (SELECT sample_id, CASE WHEN contains(lower(phase), '_day_speech') THEN 'speech' WHEN contains(lower(phase), '_day_vote') THEN 'vote' WHEN contains(lower(phase), 'night_skill') THEN 'action'
  WHEN contains(lower(phase), 'state_reconstruction') THEN 'state_recon' END AS kind, TRY_CAST(split_part(phase, '_', 1) AS INT) AS day FROM buck),
chances AS (SELECT *, {_CASE(0)} ELSE 1.0::DOUBLE END AS keep, {_CASE(1)} ELSE 0.0::DOUBLE END AS extra FROM kinds),
ns AS (SELECT *, CASE WHEN {_U.format(f"'{SEED}|' || sample_id")} < keep THEN 1 + CAST(floor(extra) AS INT) + CASE WHEN {_U.format(f"'{SEED}+|' || sample_id")} < extra - floor(extra) THEN 1 ELSE 0 END ELSE 0 END AS n FROM chances)
SELECT sample_id, kind, day, CAST(unnest(generate_series(1, n)) AS INT) AS copy_no FROM ns WHERE n > 0"""


def s_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test by place in digest order."""
    return sampling.split_by_digest(_buckets(spark, sf_dir).select("sample_id", "bucket"), "sample_id", SEED, 0.85)


SQL_SPLIT = f"SELECT sample_id, bucket, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}|' || sample_id), sample_id) <= floor((SELECT count(*) FROM buck) * 0.85::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM buck"


def s_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False samples of some phases again with label true, beside the original rows."""
    b = _buckets(spark, sf_dir).select("sample_id", "phase", "label").withColumn("origin", F.lit("original"))
    again = b.filter(~F.col("label") & (F.lower("phase").contains("night_skill") | F.lower("phase").contains("_day_vote"))).withColumn("label", F.lit(True)).withColumn("origin", F.lit("relabelled"))
    return b.unionByName(again).groupBy("origin", "label").agg(F.count(F.lit(1)).alias("samples"))


def s_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per task action type equally many true and false rows, as many as the rarer label has; types with one label stay out."""
    s = logs.samples(spark, sf_dir, "task_action_type", "label").filter("label IS NOT NULL AND task_action_type IS NOT NULL AND task_action_type <> ''")
    n = s.groupBy("task_action_type", "label").agg(F.count(F.lit(1)).alias("n"))
    q = n.groupBy("task_action_type").agg(F.min("n").alias("quota"), F.count(F.lit(1)).alias("labels")).filter("labels = 2").drop("labels")
    quotas = n.select("task_action_type", "label").join(q, "task_action_type")
    return sampling.quota_sample(s, quotas, ["task_action_type", "label"], "sample_id", SEED).select("sample_id", "task_action_type", "label")


SQL_REBALANCE = f"""typed AS (SELECT sample_id, task_action_type, label FROM samples WHERE label IS NOT NULL AND task_action_type IS NOT NULL AND task_action_type <> ''),
tn AS (SELECT task_action_type, label, count(*) AS n FROM typed GROUP BY ALL), tq AS (SELECT task_action_type, min(n) AS quota FROM tn GROUP BY ALL HAVING count(*) = 2)
SELECT sample_id, task_action_type, label FROM (SELECT t.*, q.quota, row_number() OVER (PARTITION BY task_action_type, label ORDER BY md5('{SEED}|' || sample_id), sample_id) AS place FROM typed t JOIN tq q USING (task_action_type)) WHERE place <= quota"""


def s_model_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models that play in the games at equal shares, restricted to those with samples, times bucket weights; other sources under one name."""
    known = logs.roles(spark, sf_dir).filter("model IS NOT NULL").select(F.col("model").alias("source_model")).distinct().withColumn("wanted", F.lit(True))
    n = _buckets(spark, sf_dir).groupBy("source_model", "bucket").agg(F.count(F.lit(1)).alias("n")).join(known, "source_model", "left")
    n = n.groupBy(F.when(F.col("wanted"), F.col("source_model")).otherwise("__unmatched_model__").alias("model"), "bucket").agg(F.sum("n").alias("available"))
    models = n.filter("model <> '__unmatched_model__'").agg(F.count_distinct("model")).scalar()
    return n.withColumn("weight", F.when(F.col("model") == "__unmatched_model__", 0.0).otherwise(1.0 / models))


def s_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by phase, by phase and label, by model, by role, by bucket and in total, in one pass."""
    b = _buckets(spark, sf_dir)
    b.createOrReplaceTempView("emberline_buckets")
    return spark.sql(
        """SELECT phase, label, source_model, actor_role, bucket, grouping_id() AS level, count(*) AS n FROM emberline_buckets
        GROUP BY GROUPING SETS ((phase), (phase, label), (source_model), (actor_role), (bucket, label), ())"""
    ).withColumn("label", F.col("label").cast("int")).withColumn("level", F.col("level").cast("int"))


SQL_SUMMARY = """SELECT phase, CAST(label AS INT) AS label, source_model, actor_role, bucket, CAST(grouping_id(phase, label, source_model, actor_role, bucket) AS INT) AS level, count(*) AS n FROM buck
  GROUP BY GROUPING SETS ((phase), (phase, label), (source_model), (actor_role), (bucket, label), ())"""


def s_auto_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss weights from label counts per bucket: the rarer label gets the ratio, the other 1; null without both."""
    n = _buckets(spark, sf_dir).groupBy("bucket").agg(F.count_if("label").alias("good"), F.count_if(~F.col("label")).alias("bad"))
    ok = (F.col("good") > 0) & (F.col("bad") > 0)
    return n.select("bucket", "good", "bad", F.when(ok, F.greatest(F.lit(1.0), F.col("bad") / F.col("good"))).alias("good_weight"), F.when(ok, F.greatest(F.lit(1.0), F.col("good") / F.col("bad"))).alias("bad_weight"))


def s_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text, and how many repeat it."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL AND text <> ''").select(F.md5("text").alias("k"), "doc_id", "source")
    first = ordered.first_wins(d, ["k"], F.col("doc_id"), "doc_id", "source")
    return first.join(d.groupBy("k").agg(F.count(F.lit(1)).alias("copies")), "k").select("doc_id", "source", "copies")


def s_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sample sources united: all columns with gaps filled, and common columns only."""
    a = logs.samples(spark, sf_dir, "phase", "lang").select(F.col("sample_id").alias("id"), "phase", "lang")
    b = logs.traces(spark, sf_dir, "phase", "role").select(F.col("trace_id").alias("id"), "phase", "role")
    filled, common = matching.union_filling([a, b]), matching.union_common([a, b])
    n = filled.groupBy("phase").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("lang") == "").alias("no_lang"), F.count_if(F.col("role") == "").alias("no_role"))
    return n.join(common.groupBy(F.coalesce("phase", F.lit("")).alias("phase")).agg(F.sum("id").alias("id_sum")), "phase")


SQL_UNIONS = """uni AS (SELECT sample_id AS id, coalesce(phase, '') AS phase, coalesce(lang, '') AS lang, '' AS role FROM samples UNION ALL SELECT trace_id, coalesce(phase, ''), '', coalesce(role, '') FROM traces)
SELECT phase, count(*) AS rows, count_if(lang = '') AS no_lang, count_if(role = '') AS no_role, CAST(sum(id) AS BIGINT) AS id_sum FROM uni GROUP BY phase"""


def s_columnar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays per game turned back into rows. A game's samples are bounded by its log."""
    s = logs.samples(spark, sf_dir, "game_path", "phase").filter("game_path IS NOT NULL").groupBy("game_path").agg(F.sort_array(F.collect_list(F.struct("sample_id", "phase"))).alias("l"))
    cols = s.select("game_path", F.col("l.sample_id").alias("ids"), F.col("l.phase").alias("phases"))
    return cols.select("game_path", F.inline(F.arrays_zip("ids", "phases"))).select("game_path", F.col("ids").alias("sample_id"), F.col("phases").alias("phase"))


SQL_COLUMNAR = "SELECT game_path, sample_id, phase FROM samples WHERE game_path IS NOT NULL"


def s_orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact table with its dimensions: shares of finished orders per nation and segment."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("finished"))


def s_event_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type: events whose user had an error earlier the same day, and the value of their JSON property."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    e = ordered.latest_before(e, ["user_id", "day"], ["ts", "event_id"], F.when(F.col("event_type") == "error", F.col("event_id")), "error_before")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count("error_before").alias("after_error"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k_sum"))


SQL_FUNNEL = """SELECT event_type, count(*) AS events, count(error_before) AS after_error, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS k_sum FROM (SELECT *, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS error_before FROM events) GROUP BY ALL"""


def s_line_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier with most lines of a part, null on a tie."""
    from emberline.operators import votes

    counts = votes.tally(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), ["l_partkey"], "l_suppkey")
    return votes.plurality(counts, ["l_partkey"], "l_suppkey")


SQL_LINES = """n AS (SELECT l_partkey, l_suppkey, count(*) AS v FROM lineitem GROUP BY ALL), t AS (SELECT l_partkey, max(v) AS top_votes FROM n GROUP BY ALL)
SELECT t.l_partkey, t.top_votes, CAST(count(*) AS INT) AS tied, CASE WHEN count(*) = 1 THEN max(n.l_suppkey) END AS winner FROM t JOIN n ON n.l_partkey = t.l_partkey AND n.v = t.top_votes GROUP BY ALL"""


def _tail(sql: str) -> tuple[str, str]:
    head, end = sql.split("\nSELECT", 1)
    return head, "SELECT" + end


QUERIES = {
    f.__name__: f
    for f in (
        s_quota_allocation, s_stratified, s_keep_or_copy, s_split, s_relabel, s_rebalance, s_model_ratios, s_summary, s_auto_weights, s_dedup_first, s_unions, s_columnar_rows, s_orders_by_nation,
        s_event_funnel, s_line_tally,
    )
}
ORACLE = {
    "s_quota_allocation": with_sql(SQL_QUOTA, "SELECT bucket, label, available, quota, CAST((SELECT min(floor(available * (SELECT sum(w) FROM avail) / w)) FROM avail) AS BIGINT) AS feasible FROM quotas"),
    "s_stratified": with_sql(SQL_QUOTA, *_tail(SQL_STRATIFIED)), "s_keep_or_copy": with_sql(SQL_QUOTA, *_tail(SQL_KEEP)), "s_split": with_sql(SQL_QUOTA, SQL_SPLIT),
    "s_relabel": with_sql(SQL_QUOTA, "SELECT origin, label, count(*) AS samples FROM (SELECT 'original' AS origin, label FROM buck UNION ALL SELECT 'relabelled', true FROM buck WHERE NOT label AND (contains(lower(phase), 'night_skill') OR contains(lower(phase), '_day_vote'))) GROUP BY ALL"),
    "s_rebalance": with_sql(*_tail(SQL_REBALANCE)),
    "s_model_ratios": with_sql(SQL_QUOTA, "mm AS (SELECT CASE WHEN source_model IN (SELECT model FROM roles WHERE model IS NOT NULL) THEN source_model ELSE '__unmatched_model__' END AS model, bucket FROM buck)",
        "SELECT model, bucket, count(*) AS available, CASE WHEN model = '__unmatched_model__' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (SELECT count(DISTINCT model) FROM mm WHERE model <> '__unmatched_model__') END AS weight FROM mm GROUP BY ALL"),
    "s_summary": with_sql(SQL_QUOTA, SQL_SUMMARY),
    "s_auto_weights": with_sql(SQL_QUOTA, "SELECT bucket, good, bad, CASE WHEN good > 0 AND bad > 0 THEN greatest(1.0::DOUBLE, bad / good) END AS good_weight, CASE WHEN good > 0 AND bad > 0 THEN greatest(1.0::DOUBLE, good / bad) END AS bad_weight FROM (SELECT bucket, count_if(label) AS good, count_if(NOT label) AS bad FROM buck GROUP BY bucket)"),
    "s_dedup_first": "SELECT min(doc_id) AS doc_id, arg_min(struct_pack(s := source), doc_id).s AS source, count(*) AS copies FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY md5(text)",
    "s_unions": with_sql(*_tail(SQL_UNIONS)), "s_columnar_rows": with_sql(SQL_COLUMNAR),
    "s_orders_by_nation": "SELECT n_name, c_mktsegment, count(*) AS orders, avg(CAST(o_orderstatus = 'F' AS DOUBLE)) AS finished FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "s_event_funnel": SQL_FUNNEL, "s_line_tally": "WITH " + SQL_LINES,
}
