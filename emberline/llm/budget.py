"""Tokens per source, language and domain (problem 5), and token counts for other operators.

Every distinct text is tokenized once: texts are keyed by a 128-bit digest, the counts of their occurrences per slice
are summed before the shuffle, and the token counts are joined back by digest, where they multiply the occurrences.

Defined cases: null and empty texts count 0 tokens but stay in the number of texts; a sample delivered several times
counts once; slices with a null source, language or domain form groups of their own; language variants fold to their
base code; domains fold case and outer white space; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm import tokenizers
from emberline.llm.proportions import folded


def base_language(col: Column) -> Column:
    """A language code without region, case and white space (``zh-CN`` -> ``zh``); null where nothing is left."""
    code = F.lower(F.regexp_extract(col, r"^[\s\p{Z}]*([A-Za-z]+)", 1))
    return F.when(code != "", code)


def digest(col: Column) -> Column:
    """The key of a text."""
    return F.unhex(F.md5(col))


def count_tokens(texts: DataFrame, text: str = "text", tokenizer: str = tokenizers.DEFAULT, folder: str = tokenizers.TOKENIZER_DIR) -> DataFrame:
    """Add ``tokens`` to rows of texts that should be distinct; the texts themselves don't leave the Python worker."""
    keep = [f for f in texts.schema.fields if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", tokens bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = tokenizers.token_counts(pdf[text], tokenizer, folder)
            yield pdf.drop(columns=[text]).assign(tokens=pd.Series(counts, index=pdf.index, dtype="int64"))

    return texts.mapInPandas(run, schema)


def token_budget(
    texts: DataFrame, slices: list[str], key: list[str], text: str = "text", tokenizer: str = tokenizers.DEFAULT, folder: str = tokenizers.TOKENIZER_DIR
) -> DataFrame:
    """(slices..., texts, distinct_texts, tokens): what every slice holds.

    ``texts`` has a row per occurrence and ``key`` tells occurrences apart; a repeated key counts once. Copies of a text
    meet only as narrow rows and then as counts, after map-side sums, so a text that makes up a third of all rows is no
    hot group. The texts themselves are shuffled once, after map-side removal of copies.
    """
    rows = texts.select(*key, *slices, F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__d", digest(F.col("__text")))
    counts = rows.select(*key, *slices, "__d").distinct().groupBy("__d", *slices).agg(F.count(F.lit(1)).alias("__n"))
    distinct = rows.select("__d", "__text").dropDuplicates(["__d"])
    tokens = count_tokens(distinct, "__text", tokenizer, folder)
    joined = counts.join(tokens, "__d")
    return joined.groupBy(*slices).agg(
        F.sum("__n").alias("texts"), F.count(F.lit(1)).alias("distinct_texts"), F.sum(F.col("__n") * F.col("tokens")).alias("tokens")
    )


def kto_texts(kto: DataFrame) -> DataFrame:
    """(sample_id, part, place, source_model, lang, phase, text): a row per content of each sample's prompt and completion.

    Samples delivered several times give repeated rows, which agree in (sample_id, part, place).
    """
    def side(name: str) -> Column:
        messages = F.coalesce(F.col(name), F.array())
        return F.transform(messages, lambda m, i: F.struct(F.lit(name).alias("part"), i.alias("place"), m["content"].alias("text")))

    sides = [side("prompt"), side("completion")]
    rows = kto.select(
        "sample_id", "source_model", base_language(F.col("lang")).alias("lang"), folded(F.col("phase")).alias("phase"), F.explode(F.concat(*sides)).alias("p")
    )
    return rows.select("sample_id", "p.part", "p.place", "source_model", "lang", "phase", "p.text")
