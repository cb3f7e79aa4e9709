import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import MIDDLE
from emberline.llm import encoding, garble, mojibake, queries, tokenizers
from emberline.llm.transducer import Transducer


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokenizers.TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(max_size=6), st.lists(st.integers(0, 99), min_size=1, max_size=3), max_size=40), st.lists(st.binary(max_size=6), max_size=20))
def test_transducer_holds_exactly_its_words(lexicon, others):
    t = Transducer.compile(lexicon)
    words = list(lexicon) + others
    for word, place in zip(words, t.places(words).tolist()):
        assert (place >= 0) == (word in lexicon)
        if place >= 0:
            assert t.ids_of(place) == lexicon[word]


def test_transducer_shares_suffixes_and_maps(tmp_path):
    words = {p + b"ation": [i] for i, p in enumerate([b"n", b"st", b"rel", b"form"])}
    t = Transducer.compile(words)
    assert len(t.final) < sum(map(len, words)) - 10  # the ends are one chain
    t.save(str(tmp_path / "x"))
    back = Transducer.load(str(tmp_path / "x"))
    assert [back.ids_of(p) for p in back.places(list(words)).tolist()] == list(words.values())
    assert Transducer.compile({}).places([b"a", b""]).tolist() == [-1, -1]


TEXTS = ["", None, "hello  world\n\n", "<|endoftext|> and <|endoftext|>", "狼人杀 — “ok”…", "​﻿ ", "a" * 5000, "é́🐺👩‍🔧", " \t \n ", "'s 't 're It's", "١٢٣ ½ Ⅷ"]


def test_ids_equal_the_public_tokenizer(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").selectExpr("*", "'x' AS ids")
    for words in (1, 60_000):
        got = {r.doc_id: r.ids for r in encoding.encode_texts(df, words=words).collect()}
        assert got == {i: (reference.encode(t, add_special_tokens=False).ids if t else []) for i, t in enumerate(TEXTS)}
    assert encoding.encode_texts(df.limit(0)).count() == 0


def test_ids_of_the_table(spark, reference):
    out = queries.p7_ids(spark, MIDDLE)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = {r.doc_id: r.ids for r in out.collect()}
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id] == reference.encode(r.text or "", add_special_tokens=False).ids for r in rows)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    return garble.Classifier.train([x for x in mojibake.sample_texts(docs) if garble.surely_intact(x[0])])


@pytest.mark.parametrize("chain", garble.CHAINS)
def test_chains_round_trip(chain):
    for text in ("plain", "Après avoir écouté", "Если вспомнить", "回头看第三天"):
        bad = garble.garble(text, chain)
        if bad is not None and "�" not in bad:
            back = garble.invert(bad, chain)
            assert back in (text, None) or bad == text or garble.garble(back, chain) == bad


FRENCH = "Après avoir écouté la tablée, le joueur 5 a changé de côté en un seul tour, et la nuit paisible désigne le rôle de sorcière."
RUSSIAN = "Если вспомнить день 3, игрок 9 за один круг сменил сторону, потому что игрок 2 проголосовал слишком поздно."
CHINESE = "站在我的位置上，3号玩家的发言更像狼人，因为5号玩家的票跟得太晚。"


@pytest.mark.parametrize(
    "text,chain",
    [(FRENCH, (("utf-8", "cp1252"),)), (FRENCH, (("utf-8", "latin-1"),)), (FRENCH, (("utf-8", "cp1251"),)), (RUSSIAN, (("utf-8", "cp1252"),)), (RUSSIAN, (("cp1251", "koi8-r"),)), (RUSSIAN, (("koi8-r", "cp1251"),)),
     (CHINESE, (("utf-8", "cp1252"),)), (CHINESE, (("gbk", "latin-1"),)), (FRENCH, (("utf-8", "cp1252"), ("utf-8", "cp1252")))],
)
def test_garbled_passages_are_found_and_restored(model, text, chain):
    bad = garble.garble(text, chain)
    for before, after in (("", ""), ("Player 3 waited. ", " Then all was quiet.")):
        found = model.find(before + bad + after)
        assert found is not None
        assert found[1] == before + text + after


def test_lost_bytes_are_found_without_restoration(model):
    found = model.find(garble.garble(CHINESE, (("utf-8", "gbk"),)))
    assert found is not None and found[1] is None


@pytest.mark.parametrize("text", [None, "", "plain ascii", FRENCH, RUSSIAN, CHINESE, "┌────┬────┐\n| 1 | a |", "Ω ≈ 3, √2, ½, ±3°, µ", "👩‍🔧 👍🏽", "NÃO, ATENÇÃO!", "مرحبا שלום", FRENCH * 2000])
def test_intact_texts(model, text):
    assert model.find(text) is None


def test_runs_over_chunks_equal_runs_over_bytes(spark, model):
    """For every class that reaches its limit in a text of the table, and none other."""
    import numpy as np

    limits = model.limits
    texts = [r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("text").collect() if r.text and not r.text.isascii()]
    try:
        model.limits = np.full(len(model.classes), 4.0)
        for text in [FRENCH, RUSSIAN, CHINESE, garble.garble(FRENCH, (("utf-8", "cp1251"),)), "a b é\u00a0è", *texts]:
            best = model._best(model._columns(text)[1])
            likely, sums = model._likely(text)
            assert set(np.flatnonzero(best >= 4.05)) <= set(likely)
            assert np.allclose(best[likely], sums, atol=0.05, rtol=1e-3)
    finally:
        model.limits = limits


def test_no_training_text_and_empty_tables(spark):
    assert garble.Classifier.train([]).find("Ã©Ã¨") is None
    df = spark.createDataFrame([(1, "only ascii", None), (2, None, "x")], "doc_id bigint, text string, lang string")
    assert mojibake.find_garbled(df).count() == 0 and mojibake.find_garbled(df.limit(0)).count() == 0
    assert queries.p9_found(spark, MIDDLE).columns == ["doc_id"]
