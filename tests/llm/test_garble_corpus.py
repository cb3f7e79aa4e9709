"""Limits and usages come from all distinct texts."""

from conftest import MIDDLE
from emberline.llm import garble, mojibake

RUSSIAN = "Если вспомнить день 3, игрок 9 за один круг сменил сторону, потому что игрок 2 проголосовал слишком поздно."


def test_copies_of_a_garbled_text_are_no_usage(spark):
    bad = garble.garble(RUSSIAN, (("cp1251", "koi8-r"),))
    assert garble.surely_intact(bad)
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**9 + i, bad, "ru") for i in range(4)], docs.schema)
    found = {r.doc_id: r.restored for r in mojibake.find_garbled(docs.unionByName(more)).collect()}
    assert [found.get(10**9 + i) for i in range(4)] == [RUSSIAN] * 4


def test_sample_holds_distinct_texts(spark):
    docs = spark.createDataFrame([(i, f"é{i % 3}", ["fr", "de"][i % 2]) for i in range(30)], "doc_id bigint, text string, lang string")
    assert sorted(t for t, _ in mojibake.sample_texts(docs)) == ["é0", "é1", "é2"]


def test_weaker_passage_behind_one_that_is_correct(spark, monkeypatch):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = garble.Classifier.train([x for x in mojibake.sample_texts(docs) if garble.surely_intact(x[0])])
    bad = garble.garble(RUSSIAN[:40], (("utf-8", "cp1252"),))
    text = "ÐÑÐÑ ÐÑÐÑ" + " Player 3 waited and said nothing for a long time." * 3 + " " + bad
    passages, restore, first = model.passages, model._restore, "ÐÑÐÑ ÐÑÐÑ".encode()
    end = len(first)
    strong = lambda t: [(model.limits[0] * 1.5, 0, 0, end)] if t.startswith("ÐÑ") else passages(t)
    monkeypatch.setattr(model, "passages", strong)
    monkeypatch.setattr(model, "_restore", lambda p, *more: None if "ÐÑÐÑ ÐÑÐÑ" in p else restore(p, *more))
    found = model.find(text)
    assert found is not None and found[1].endswith(RUSSIAN[:40])


FRENCH = "Après avoir écouté la tablée, le joueur 5 a changé de côté en un seul tour, et la nuit paisible désigne le rôle de sorcière."


def test_garbled_sentences_that_recur_are_found(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    sample = [x for x in mojibake.sample_texts(docs) if garble.surely_intact(x[0])]
    for chain in ((("cp1251", "cp1252"),), (("koi8-r", "cp1251"),)):
        bad = garble.garble(RUSSIAN, chain)
        for copies in (3, 50):
            model = garble.Classifier.train([(f"{t} {bad}" if i < copies else t, lang) for i, (t, lang) in enumerate(sample)])
            assert model.find(f"Player 3 waited. {bad} Then all.")[1] == f"Player 3 waited. {RUSSIAN} Then all."


def test_every_passage_is_restored_and_bounds_lose_nothing(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = garble.Classifier.train([x for x in mojibake.sample_texts(docs) if garble.surely_intact(x[0])])
    bad = [garble.garble(FRENCH, (("utf-8", "cp1252"),)), garble.garble(RUSSIAN, (("cp1251", "cp1252"),))]
    chains, restored, _ = model.find(f"{bad[0]} Then all was quiet. {bad[1]}")
    assert restored == f"{FRENCH} Then all was quiet. {RUSSIAN}" and " | " in chains
    texts = [r.text for r in docs.select("text").collect() if r.text] + bad + ["", "plain", "é"]
    mask = model.may_hold(texts)
    for text, maybe in zip(texts, mask):
        assert maybe or text.isascii() or not len(model._likely(text)[0])
    assert list(mask) == [bool(model.may_hold([t])[0]) for t in texts]


def test_sample_of_very_many_texts_is_not_empty(spark):
    docs = spark.createDataFrame([(i, f"é{i}", "fr") for i in range(5000)], "doc_id bigint, text string, lang string")
    assert len(mojibake.sample_texts(docs, n=5)) == 5


def test_garbled_training_texts_make_no_class_of_correct_text(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    sample = [x for x in mojibake.sample_texts(docs) if garble.surely_intact(x[0])]
    chains = ((("cp1251", "cp1252"),), (("cp1251", "latin-1"),), (("gbk", "cp1252"),))
    bad = [(b, lang) for t, lang in sample for chain in chains if lang in ("ru", "zh") and (b := garble.garble(t, chain)) and b != t and garble.surely_intact(b)]
    model = garble.Classifier.train(sample + bad[:8])
    texts = [t for t, lang in sample if lang in ("ru", "zh")]
    assert sum(model.find(t) is not None for t in texts) <= 0.02 * len(texts)


def test_signs_in_their_places_are_correct(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    sample = [x for x in mojibake.sample_texts(docs) if garble.surely_intact(x[0])]
    model = garble.Classifier.train([x for x in sample if "n’t" not in x[0] and "—" not in x[0]])
    for text in ("Before we vote, I won’t help Player 3 push that vote.", "He sounds like a Villager — which fits a pack of 4.", "GROẞ ÄÖÜ ÅÆØ NÃO SÃO Ângulo"):
        assert model.find(text) is None, text
    assert model.find(garble.garble(FRENCH, (("cp1252", "mac-roman"),)))[1] == FRENCH
