"""Mixes of sources with target shares (problem 8).

A mix has a size in tokens and gives each source a share of it. A source's rate is its share of the size over the tokens
it has, at most the number of times a document may be used. Each document is emitted floor(rate) times, and once more
where its seeded hash, a number in [0, 1), is below the rest.

Defined cases: null and empty texts have no tokens and are never emitted; sources compare exactly as written (null
matches nothing); a source of the target without documents, or of the documents without target, gives nothing and the
former is reported with 0; repeated texts under other ids are documents of their own; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm import tokenizers
from emberline.llm.budget import count_tokens, digest
from emberline.operators.matching import small_side


#: Parts into which the documents of one text are spread for the join with its token count.
SALTS = 32


def document_tokens(documents: DataFrame, tokenizer: str = tokenizers.DEFAULT, folder: str = tokenizers.TOKENIZER_DIR) -> DataFrame:
    """(doc_id, source, tokens) of every distinct document with a text; each distinct text is tokenized once.

    One text may stand in any share of the documents: its documents are spread over ``SALTS`` parts, and each part that
    occurs meets one copy of the count. A text that stands once occurs in one part, so the counts are hardly multiplied.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("__salt")
    rows = documents.filter("text IS NOT NULL AND text <> ''").select("doc_id", "source", "text", digest(F.col("text")).alias("__d"), salt)
    per_text = rows.groupBy("__d").agg(F.any_value("text").alias("text"), F.expr("bit_or(shiftleft(1L, __salt))").alias("__salts"))
    counted = count_tokens(per_text, "text", tokenizer, folder)
    parts = F.expr(f"filter(sequence(0, {SALTS - 1}), x -> (__salts & shiftleft(1L, x)) <> 0)")
    counted = counted.withColumn("__salt", F.explode(parts)).drop("__salts")
    return rows.select("doc_id", "source", "__d", "__salt").distinct().join(counted, ["__d", "__salt"]).select("doc_id", "source", "tokens")


def hash_unit(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), key)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix_rates(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_permille, size_tokens, wanted_tokens, have_tokens, rate) of each row of ``targets``."""
    per_source = tokens.groupBy("source").agg(F.sum("tokens").alias("have_tokens"))
    total = tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    asked = targets.distinct().withColumn("all_tokens", total)
    asked = asked.withColumn("size_tokens", F.col("size_permille") * F.col("all_tokens") / 1000.0)
    asked = asked.withColumn("wanted_tokens", F.col("size_tokens") * F.col("target_permille") / 1000.0)
    asked = asked.join(per_source, "source", "left").withColumn("have_tokens", F.coalesce("have_tokens", F.lit(0)))
    rate = F.least(F.col("max_repeats").cast("double"), F.expr("try_divide(wanted_tokens, CAST(have_tokens AS DOUBLE))"))
    return asked.select(
        "mix_id", "source", "target_permille", "max_repeats", "size_tokens", "wanted_tokens", "have_tokens",
        F.when(F.col("have_tokens") > 0, rate).otherwise(0.0).alias("rate"),
    )


def mix(tokens: DataFrame, rates: DataFrame, seed: str = "mix-1") -> DataFrame:
    """(mix_id, source, doc_id, tokens, copies): how often each document is used, documents not used left out.

    The rates are one row per mix and source of the target table; they are counted, and while they are few the join needs no
    shuffle of the documents.
    """
    rows = tokens.join(small_side(rates.filter("rate > 0").select("mix_id", "source", "rate", "max_repeats")), "source")
    extra = (hash_unit(F.concat_ws("|", F.col("mix_id"), F.col("doc_id")), seed) < F.col("rate") - F.floor("rate")).cast("bigint")
    copies = F.least(F.floor("rate") + extra, F.col("max_repeats").cast("bigint"))
    return rows.select("mix_id", "source", "doc_id", "tokens", copies.alias("copies")).filter("copies > 0")


def emitted(mixed: DataFrame) -> DataFrame:
    """A row per use: (mix_id, source, doc_id, copy_no, tokens)."""
    return mixed.select("mix_id", "source", "doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy_no"), "tokens")


def mix_report(mixed: DataFrame, rates: DataFrame) -> DataFrame:
    """One row per row of the target table: wanted and given tokens, the actual share of the mix, and whether the cap binds."""
    given = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("given_tokens"), F.sum("copies").alias("uses"), F.max("copies").alias("most_uses"))
    out = rates.join(given, ["mix_id", "source"], "left")
    all_given = given.groupBy("mix_id").agg(F.sum("given_tokens").alias("mix_tokens"))
    out = out.join(all_given, "mix_id", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "mix_id", "source", "target_permille", "max_repeats", "size_tokens", "wanted_tokens", "have_tokens", "rate",
        F.coalesce("given_tokens", zero).alias("given_tokens"), F.coalesce("uses", zero).alias("uses"), F.coalesce("most_uses", zero).alias("most_uses"),
        (F.coalesce("given_tokens", zero) * 1000.0 / F.col("size_tokens")).alias("permille_of_size"),
        (F.coalesce("given_tokens", zero) * 1000.0 / F.col("mix_tokens")).alias("permille_of_mix"),
        (F.col("wanted_tokens") > F.col("have_tokens") * F.col("max_repeats")).alias("capped"),
    )
