"""Token ids of whole texts by a public tokenizer (problem 7).

Words (the pieces into which the tokenizer's pattern cuts a text) are counted over all documents; the frequent ones are
compiled with their ids into a minimal acyclic transducer that workers memory-map from the shared folder, or from their
executor's own copy where that folder can't be mapped. A word the
transducer doesn't hold is merged exactly. How many words are compiled changes the speed only, never the result.

Defined cases: null and empty texts have an empty list; strings that look like special tokens are ordinary text; lone
surrogates, which UTF-8 can't hold, count as the replacement character; very long texts are encoded whole; extra columns
are ignored; repeated keys give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from emberline.llm import tokenizers
from emberline.llm.transducer import Transducer
from emberline.session import remove_at_exit, shared_dir

#: Words compiled into the transducer: a bound of its size (some MB), not of what is encoded.
LEXICON_WORDS = 60_000
#: A worker's table of words met is begun anew at this size.
MEMO_WORDS = 200_000
#: Distinct words counted in a task before they are handed on; keeps the counting in bounded memory.
COUNTED_WORDS = 200_000


@functools.lru_cache(maxsize=4)
def _splitter(folder: str):
    import regex

    return regex.compile(tokenizers.split_pattern(folder))


def word_counts(documents: DataFrame, text: str = "text", folder: str = tokenizers.TOKENIZER_DIR) -> DataFrame:
    """(word, n) over all documents, summed in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

        split = _splitter(folder)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update(split.findall(tokenizers.clean(t)))
                if len(counts) >= COUNTED_WORDS:
                    yield flush()
                    counts.clear()
        yield flush()

    return documents.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(documents: DataFrame, text: str, tokenizer: str, folder: str, words: int = LEXICON_WORDS) -> tuple[str, str]:
    """Compile the most frequent words; returns the folder of the arrays and the beginning of their files' names.

    Where the shared folder isn't a file system that workers can map, the files are handed to every executor, also to those
    that come later, and mapped from the executor's own copy: the folder is then the empty text.
    """
    top = word_counts(documents, text, folder).orderBy(F.desc("n"), "word").limit(words).select("word").collect()
    merge = tokenizers.byte_bpe(tokenizer, folder)._encode_single_piece
    lexicon = {r.word.encode("utf-8"): merge(r.word.encode("utf-8")) for r in top}
    transducer = Transducer.compile(lexicon)
    spark = documents.sparkSession
    url, name = urlparse(shared_dir(spark)), f"lexicon-{uuid.uuid4().hex}"
    if url.scheme in ("", "file"):
        place = f"{url.path}/{name}"
        transducer.save(place)
        remove_at_exit(spark, "file://" + place)
        return place, ""
    served = tempfile.mkdtemp(prefix="emberline-lexicon-")  # on the driver only, which serves the files until it ends
    atexit.register(shutil.rmtree, served, True)
    transducer.save(served, name + "-")
    for file in sorted(os.listdir(served)):
        spark.sparkContext.addFile(os.path.join(served, file))
    return "", name + "-"


@functools.lru_cache(maxsize=2)
def _mapped(place: str, prefix: str) -> Transducer:
    return Transducer.load(place or SparkFiles.getRootDirectory(), prefix)


class Encoder:
    """Encodes texts in a worker: memo of words met, then the transducer, then an exact merge."""

    def __init__(self, transducer: Transducer, tokenizer: str, folder: str) -> None:
        self.transducer, self.memo = transducer, {}
        self.split = _splitter(folder).findall
        self.merge = tokenizers.byte_bpe(tokenizer, folder)._encode_single_piece

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        cut = [self.split(tokenizers.clean(t)) if t else [] for t in texts]
        new = list({w for words in cut for w in words if w not in memo})
        coded = [w.encode("utf-8") for w in new]
        for word, raw, place in zip(new, coded, self.transducer.places(coded).tolist()):
            memo[word] = self.transducer.ids_of(place) if place >= 0 else self.merge(raw)
        out = []
        for words in cut:
            ids: list[int] = []
            for w in words:
                ids.extend(memo[w])
            out.append(ids)
        return out


def encode_texts(
    documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = tokenizers.DEFAULT, folder: str = tokenizers.TOKENIZER_DIR,
    words: int = LEXICON_WORDS,
) -> DataFrame:
    """(key, ids): one row per row of ``documents``, without a shuffle of texts."""
    place, prefix = build_lexicon(documents, text, tokenizer, folder, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_mapped(place, prefix), tokenizer, folder)
        for batch in batches:
            ids = encoder.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
