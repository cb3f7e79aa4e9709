"""Texts that were decoded with the wrong encoding, and their originals (problem 9).

``garble.Classifier`` is trained on a bounded sample of the corpus, garbled by every chain it knows. Each text is scored
whole, first by a bound for all chains over a whole batch, then class by class where the bound allows a passage. The best
passage of the likeliest chains is inverted, and counts as restored if every byte decodes strictly, the way back gives the
passage again, and the result reads as intact text; then the rest of the text is searched. A passage that can't be inverted
because bytes were lost is still found, by its score alone, with a null restoration of the text.

Defined cases: null, empty and plain ASCII texts are intact; correct rare characters (other scripts, box lines, signs,
emoji) are intact as far as the sample or the verification shows them so; very long texts are scored whole, class by
class; a corpus without text beyond ASCII gives no classes and no rows; repeated rows give repeated rows; empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberline.llm.budget import base_language
from emberline.llm.garble import Classifier, surely_intact

#: Texts the classifier is fitted on, and the length up to which texts are taken for it.
SAMPLE_TEXTS, SAMPLE_CHARS = 3000, 20_000


def sample_texts(documents: DataFrame, text: str = "text", lang: str = "lang", n: int = SAMPLE_TEXTS) -> list[tuple[str, str]]:
    """A sample of at most ``n`` distinct texts with their languages, the same on every run: those with the smallest hashes.

    Copies of a text count once, whatever their ids. Only texts whose hash is small enough that about 2n remain are sorted.
    """
    rows = documents.filter(F.col(text).isNotNull() & (F.length(text) <= SAMPLE_CHARS) & F.col(text).rlike(r"[^\x00-\x7F]"))
    place = F.shiftrightunsigned(F.xxhash64(text), 1)  # 63 bits: fine enough for a sample of any number of rows
    rows = rows.select(F.col(text).alias("t"), F.coalesce(base_language(F.col(lang)), F.lit("xx")).alias("l"), place.alias("h"))
    distinct = rows.select(F.approx_count_distinct("h", 0.02)).first()[0]
    if 2 * n < distinct:
        rows = rows.filter(F.col("h") < int(2 * n / distinct * 2**63))
    rows = rows.groupBy("t", "h").agg(F.min("l").alias("l")).orderBy("h", "t").limit(n)
    return [(r.t, r.l) for r in rows.select("t", "l", "h").collect()]


def find_garbled(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", n: int = SAMPLE_TEXTS) -> DataFrame:
    """(key, chain, restored, log_odds) of the garbled texts; no shuffle besides the sample's."""
    model = Classifier.train([x for x in sample_texts(documents, text, lang, n) if surely_intact(x[0])])
    shared = documents.sparkSession.sparkContext.broadcast(model)  # some MB: bins seen in the sample x chains x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [(i, *found) for i in np.flatnonzero(model.may_hold(texts)) if (found := model.find(texts[i], True))]
            cols = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))]
            cols += [pa.array([r[j] for r in rows], kind) for j, kind in ((1, pa.string()), (2, pa.string()), (3, pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, [key, "chain", "restored", "log_odds"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.filter(F.col(text).rlike(r"[^\x00-\x7F]")).select(key, text).mapInArrow(run, f"`{key}` {kind}, chain string, restored string, log_odds double")
