"""Queries of the training-data problems, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.llm import budget, cutoff, encoding, mixing, mojibake, packing, pairs, proportions
from emberline.session import staged
from emberline.sources.tables import spread, table


# -- problems 1 and 4 --------------------------------------------------------------------------------------------------
def _pairs(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """(tab, row_id, prompt, response) of both tables; redelivered rows repeat. ``deal``: rows of few splits are dealt out to all cores."""

    def read(name: str, key: str, *columns: str) -> DataFrame:
        rows = table(spark, sf_dir, name).select(key, *columns)
        return spread(rows, key) if deal else rows

    traces = read("player_trace", "trace_id", "prompt", "response").select(F.lit("player_trace").alias("tab"), F.col("trace_id").alias("row_id"), "prompt", "response")
    contents = lambda c: F.array_join(cutoff.completion_texts(F.col(c)), "\n")
    kto = read("kto_dataset", "sample_id", "prompt", "completion").select(
        F.lit("kto_dataset").alias("tab"), F.col("sample_id").alias("row_id"), contents("prompt").alias("prompt"), contents("completion").alias("response")
    )
    return traces.unionByName(kto)


def _labelled_prompts(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "kto_dataset").select("sample_id", "prompt", "lang")
    return (spread(rows, "sample_id") if deal else rows).select(F.array_join(cutoff.completion_texts(F.col("prompt")), "\n").alias("text"), "lang")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defective pairs with their defects. Rows are judged where they are read; only keys and defects are shuffled."""
    dealt = _pairs(spark, sf_dir, deal=True)
    model = pairs.PairModel.fit([], [], pairs.count_pairs(dealt, _labelled_prompts(spark, sf_dir, deal=True)))
    return pairs.find_all_defects(dealt, model, ["tab", "row_id"]).distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, defect, pairs)."""
    return p1_found(spark, sf_dir).groupBy("tab", "defect").agg(F.count(F.lit(1)).alias("pairs"))


def _cut_scores(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(tab, row_id, source columns..., probability) of every value."""
    rows = _pairs(spark, sf_dir)
    sample = pairs.sample_pairs(rows, cutoff.SAMPLE_VALUES)
    model = cutoff.CutModel.fit([r for _, r in sample], [p for p, _ in sample])
    traces = spread(table(spark, sf_dir, "player_trace").select("trace_id", "game_path", "player_id", "response", "prompt"), "trace_id").select(
        F.lit("player_trace").alias("tab"), F.col("trace_id").alias("row_id"), "game_path", "player_id", F.lit(None).cast("string").alias("source_model"), F.col("response").alias("text"), "prompt"
    )
    kto = spread(table(spark, sf_dir, "kto_dataset").select("sample_id", "source_model", "completion", "prompt"), "sample_id").select(
        F.lit("kto_dataset").alias("tab"), F.col("sample_id").alias("row_id"), F.lit(None).cast("string").alias("game_path"), F.lit(None).cast("int").alias("player_id"), "source_model",
        F.explode_outer(cutoff.completion_texts(F.col("completion"))).alias("text"), F.array_join(cutoff.completion_texts(F.col("prompt")), "\n").alias("prompt"),
    )
    return cutoff.score_values(traces.unionByName(kto), model, ["tab", "row_id", *more])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that were cut off."""
    return _cut_scores(spark, sf_dir).filter(F.col("probability") >= cutoff.LIMIT).select("tab", "row_id").distinct()


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, source_model, records, cut, share): how often each source's values are cut. A record counts once."""
    scored = _cut_scores(spark, sf_dir, "game_path", "player_id", "source_model")
    records = scored.groupBy("tab", "row_id", "game_path", "player_id", "source_model").agg((F.max("probability") >= cutoff.LIMIT).alias("cut"))
    players = table(spark, sf_dir, "role_model").groupBy("game_path", F.col("id").alias("player_id")).agg(F.max("model").alias("model"))
    # counted per player before the join, so that a game or a source with most of the rows is no hot key
    counts = records.groupBy("tab", "game_path", "player_id", "source_model").agg(F.count(F.lit(1)).alias("records"), F.count_if("cut").alias("cut"))
    known = counts.join(players, ["game_path", "player_id"], "left").withColumn("source_model", F.coalesce("source_model", "model"))
    out = known.groupBy("tab", "source_model").agg(F.sum("records").alias("records"), F.sum("cut").alias("cut"))
    return out.withColumn("share", F.col("cut") / F.col("records"))


# -- problem 2 ---------------------------------------------------------------------------------------------------------
def _draw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    samples = staged(proportions.usable_samples(table(spark, sf_dir, "kto_dataset")), "samples")
    targets = table(spark, sf_dir, "sample_target")
    ranked = proportions.rank_samples(samples)
    return samples, targets, proportions.draw(samples, targets, ranked=ranked), ranked


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target rows that the draw leaves short and that no further sample can fill."""
    return proportions.draw_report(*_draw(spark, sf_dir)).filter("unmet").select("draw_id", "phase", "label").distinct()


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every draw."""
    drawn = _draw(spark, sf_dir)[2]
    return drawn.select("draw_id", "sample_id", "category", F.col("label").cast("int").alias("label"), "place")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted, available and drawn rows of every target row."""
    return proportions.draw_report(*_draw(spark, sf_dir))


_SQL_SAMPLES = r"""samples AS (
  SELECT DISTINCT sample_id, lower(regexp_replace(phase, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS category, label
  FROM kto_dataset WHERE sample_id IS NOT NULL AND label IS NOT NULL AND regexp_replace(phase, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') <> ''),
sizes AS (SELECT draw_id, max(draw_permille) * (SELECT count(*) FROM samples) // 1000 AS size FROM sample_target GROUP BY draw_id),
asked AS (SELECT DISTINCT t.draw_id, t.phase, lower(trim(t.phase)) AS category, t.label, t.target_permille, t.min_rows, s.size
  FROM sample_target t JOIN sizes s USING (draw_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY md5('draw-1|' || sample_id), sample_id) AS place FROM samples),
seated AS (SELECT a.draw_id, a.size, r.sample_id, r.category, r.label, r.place, row_number() OVER (PARTITION BY a.draw_id
    ORDER BY CASE WHEN r.place <= a.min_rows THEN 0 ELSE 1 END, (r.place - 0.5::DOUBLE) / a.target_permille, r.category, r.label, r.place) AS seat
  FROM ranked r JOIN asked a ON r.category = a.category AND r.label = a.label WHERE a.target_permille > 0),
drawn AS (SELECT * FROM seated WHERE seat <= size),
report AS (SELECT a.draw_id, a.phase, CAST(a.label AS INT) AS label, a.target_permille, a.min_rows, a.size,
    coalesce(h.n, 0) AS available, coalesce(d.n, 0) AS drawn, coalesce(d.n, 0) * 1000.0::DOUBLE / a.size AS actual_permille,
    coalesce(h.n, 0) * 1000 < a.target_permille * a.size OR coalesce(h.n, 0) < a.min_rows AS unmet
  FROM asked a LEFT JOIN (SELECT category, label, count(*) AS n FROM samples GROUP BY ALL) h ON h.category = a.category AND h.label = a.label
  LEFT JOIN (SELECT draw_id, category, label, count(*) AS n FROM drawn GROUP BY ALL) d
    ON d.draw_id = a.draw_id AND d.category = a.category AND d.label = a.label)"""


# -- problem 5 ---------------------------------------------------------------------------------------------------------
def p5_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of prompts and completions per source model, language and phase."""
    texts = budget.kto_texts(table(spark, sf_dir, "kto_dataset"))
    slices = budget.token_budget(texts, ["source_model", "lang", "phase", "part"], ["sample_id", "part", "place"])
    side = lambda c, part: F.coalesce(F.sum(F.when(F.col("part") == part, F.col(c))), F.lit(0)).alias(f"{part}_{c}")
    return slices.groupBy("source_model", "lang", "phase").agg(
        F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"), side("tokens", "prompt"), side("tokens", "completion")
    )


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same summed over every subset of source model, language and phase; ``level`` tells which are summed over."""
    whole = staged(p5_budget(spark, sf_dir), "budget")
    return whole.cube("source_model", "lang", "phase").agg(
        F.grouping_id().alias("level"), F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )


# -- problem 6 ---------------------------------------------------------------------------------------------------------
def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.kto_items(table(spark, sf_dir, "kto_dataset")), table(spark, sf_dir, "packing_spec"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples that no container of a spec holds whole."""
    return packing.oversized(_packed(spark, sf_dir)).withColumnRenamed("item_id", "sample_id")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's container."""
    return _packed(spark, sf_dir).withColumnRenamed("item_id", "sample_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of every spec are."""
    return packing.fill_report(_packed(spark, sf_dir))


# -- problem 7 ---------------------------------------------------------------------------------------------------------
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encoding.encode_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


# -- problem 8 ---------------------------------------------------------------------------------------------------------
def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tokens = staged(mixing.document_tokens(table(spark, sf_dir, "documents")), "tokens")
    # kept as a table: its files' size shows Spark that it is small, so the hot source's documents aren't shuffled to meet it
    rates = staged(mixing.mix_rates(tokens, table(spark, sf_dir, "mix_target")), "rates")
    return mixing.mix(tokens, rates), rates


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a document in a mix."""
    return mixing.emitted(_mix(spark, sf_dir)[0])


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and actual shares of every source."""
    return mixing.mix_report(*_mix(spark, sf_dir))


# -- problem 9 ---------------------------------------------------------------------------------------------------------
def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find_garbled(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a garbled passage."""
    return _garbled(spark, sf_dir).select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents with the chain of decodings and the original text, null where bytes were lost."""
    return _garbled(spark, sf_dir)


QUERIES = {
    "p1_found": p1_found, "p1_report": p1_report, "p4_found": p4_found, "p4_rates": p4_rates,
    "p2_found": p2_found, "p2_sample": p2_sample, "p2_report": p2_report, "p5_budget": p5_budget, "p5_totals": p5_totals, "p6_found": p6_found,
    "p6_containers": p6_containers, "p6_fill": p6_fill, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_report": p8_report,
    "p9_found": p9_found, "p9_restored": p9_restored,
}

ORACLE = {
    "p2_found": f"WITH {_SQL_SAMPLES} SELECT DISTINCT draw_id, phase, label FROM report WHERE unmet",
    "p2_sample": f"WITH {_SQL_SAMPLES} SELECT draw_id, sample_id, category, CAST(label AS INT) AS label, place FROM drawn",
    "p2_report": f"WITH {_SQL_SAMPLES} SELECT * FROM report",
    "p6_found": """SELECT DISTINCT p.spec_id, k.sample_id FROM packing_spec p JOIN (SELECT sample_id,
        coalesce(list_sum(list_transform(prompt, lambda m: coalesce(length(m.content), 0))), 0)
        + coalesce(list_sum(list_transform(completion, lambda m: coalesce(length(m.content), 0))), 0) AS n FROM kto_dataset) k ON k.n > p.capacity_chars""",
}
