"""What differs on a cluster: the lexicon away from a file system, hot texts, the draw behind the report."""

import pytest

from emberline.llm import encoding, mixing, proportions, queries
from conftest import SMALL


def test_lexicon_without_a_shared_file_system(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Player 3 waits."), (2, None), (3, "Player 3 waits.")], "doc_id bigint, text string")
    want = {r.doc_id: r.ids for r in encoding.encode_texts(docs).collect()}
    monkeypatch.setattr(encoding, "shared_dir", lambda _: "hdfs://name/folder")
    place, _ = encoding.build_lexicon(docs, "text", encoding.tokenizers.DEFAULT, encoding.tokenizers.TOKENIZER_DIR)
    assert place == ""
    assert {r.doc_id: r.ids for r in encoding.encode_texts(docs).collect()} == want


def test_one_text_in_most_documents(spark):
    rows = [(i, "a", "the same text") for i in range(500)] + [(1000, "b", "another"), (1001, None, "x"), (1002, "b", None), (1003, "b", ""), (0, "a", "the same text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    out = mixing.document_tokens(docs).collect()
    assert len(out) == 502 and len({r.doc_id for r in out}) == 502
    assert len({r.tokens for r in out if r.source == "a"}) == 1
    assert mixing.document_tokens(docs.limit(0)).count() == 0


def test_found_targets_come_from_the_draw(spark):
    plan = queries.p2_found(spark, SMALL)._jdf.queryExecution().toString().split("== Physical Plan ==")[-1]
    assert plan.count("rank-") >= 4  # the ranking by category and the seats of the draw, rows and slices of each


def test_small_sides_are_counted(spark):
    from emberline.operators.matching import small_side

    df = spark.range(10)
    assert "broadcast" in small_side(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small_side(df, 5)._jdf.queryExecution().logical().toString().lower()


def test_more_specs_than_fit_one_pass(spark, monkeypatch):
    from emberline.llm import packing

    items = spark.createDataFrame([(1, 5), (2, 12)], "item_id bigint, length int")
    specs = spark.createDataFrame([(i, "s", 10) for i in range(7)], "spec_id int, spec_name string, capacity_chars int")
    want = sorted(map(tuple, packing.pack(items, specs).collect()))
    monkeypatch.setattr(packing, "SPECS_AT_ONCE", 3)
    assert sorted(map(tuple, packing.pack(items, specs).collect())) == want and len(want) == 21
