import pytest
from pyspark.sql import functions as F

from conftest import MIDDLE
from emberline.llm import cutoff, pairs, queries
from emberline.llm.answers import has_content, is_running, read_answer, read_end
from emberline.llm.language import LanguageModel


@pytest.fixture(scope="module")
def model(spark):
    rows = queries._pairs(spark, MIDDLE)
    return pairs.PairModel.fit(pairs.sample_prompts(queries._labelled_prompts(spark, MIDDLE)), pairs.sample_pairs(rows))


@pytest.mark.parametrize("text", [None, "", "  \n", "​", "  ", "-", "...", "{}", "[]", "null", "N/A", '""', "```json\n```", '{"notes": "", "voting reason": " "}', "<answer></answer>", "[Thinking Process]\n\n[Action] \n"])
def test_empty(text, model):
    assert not has_content(read_answer(text))
    assert model.defect("Say who.", text) == "empty"
    assert model.cuts.probability(text) < 0.5


@pytest.mark.parametrize("text", ["3", "pass", "abstain", '{"Vote": "4"}', "[Action] CALL MEETING"])
def test_short_complete_answers_are_sound(text, model):
    assert model.defect("Name one player to expel today.", text) is None


def test_structure():
    assert read_answer('{"a": {"b": ["x", 1]}}').texts == [("b", "x"), ("b", "1")]
    assert read_answer('Mine:\n```json\n{"a": "x"}\n```').kind == "json"
    assert read_answer('```json\n{"a": "x').open_fence
    assert read_answer('{"a": "x').kind == "open"
    assert [k for k, _ in read_answer("[Condensed Memory]\nx\n[Action] VOTE").texts] == ["Condensed Memory", "Action"]


@pytest.mark.parametrize(
    "text,core,mark",
    [("It is done. \U0001f642", "It is done.", True), ("It is done", "It is done", False), ('He said "so."', 'He said "so.', True), ("It is done.\nPlayer 9", "It is done.", True), ("and then...", "and then", False), ("so it [...]", "so it", False)],
)
def test_ends(text, core, mark):
    end = read_end(text)
    assert (end.core, end.mark) == (core, mark)


def test_very_long_tail_is_cut_back():
    assert read_end("It is done." + " \n" * 500).core == "It is done."


LONG = "To be frank, the second ballot made Player 3 look nervous. Put plainly, my vote goes to Player 4 because the ballot against Player 2 came far too late."


@pytest.mark.parametrize("cut", [LONG[:70], LONG[:-9], LONG[:-30] + "…", '{"Speech": "' + LONG[:-9] + '", "Vote": "4"}', '```json\n{"Speech": "' + LONG[:60], LONG[:100] + " [...]"])
def test_cut_answers(cut, model):
    assert model.cuts.probability(cut) >= 0.5
    assert model.defect("Name one player to expel today and explain how the ballot against Player 2 influenced you.", cut) == "truncated"


@pytest.mark.parametrize("whole", [LONG, LONG[:-1], LONG + " \U0001f642", '{"Speech": "' + LONG + '", "Vote": "4"}', "```json\n" + '{"Speech": "' + LONG + '"}\n```', LONG * 400])
def test_whole_answers(whole, model):
    assert model.cuts.probability(whole) < 0.5


def test_cut_model_on_held_out_cuts(spark):
    """Accuracy on artificially cut values that the model was not fitted on."""
    values = [r for _, r in pairs.sample_pairs(queries._pairs(spark, MIDDLE))]
    fit, held = values[: len(values) * 2 // 3], values[len(values) * 2 // 3 :]
    m = cutoff.CutModel.fit(fit)
    examples, labels = cutoff.make_examples(held, seed=99)
    right = sum((m.weights[e].sum() > 0) == bool(y) for e, y in zip(examples, labels))
    assert right / len(labels) > 0.95


def test_refusals_and_played_apologies(model):
    prompt = "Give your speech for this round; mention Player 5."
    assert model.defect(prompt, "Sorry, this request falls outside what I can assist with.") == "refusal"
    assert model.defect(prompt, '{"Speech": "I have to decline. Producing persuasive lies for a vote is against my guidelines.", "Vote": "abstain"}') == "refusal"
    assert model.defect("请完成本轮发言。", "很抱歉，我无法协助完成这个请求。") == "refusal"
    assert model.defect(prompt, "I am sorry, but Player 3 is lying about the Seer claim, so a tie would only help the other camp.") is None


def test_copies(model):
    prompt = "You are Player 5 and your hidden card is Witch. It is day 1.\n* Player 2: Put plainly, my vote goes to Player 4.\nState openly whom you suspect on day 1 and what Player 3 did to earn it."
    for answer in ("State openly whom you suspect on day 1 and what Player 3 did to earn it.", "STATE OPENLY WHOM YOU SUSPECT ON DAY 1 AND WHAT PLAYER 3 DID TO EARN IT.", '{"Speech": "' + prompt.split("\n")[-1] + '"}', prompt):
        assert model.defect(prompt, answer) == "copy"
    assert model.defect(prompt, "“" + prompt.split("\n")[-1] + "” " + LONG) is None
    assert pairs.copied_share([], ["a"]) == 0.0 and pairs.copied_share("a b c d e".split(), "b c d e".split()) == 1.0


def test_languages(model):
    prompt = "Seat 1, card Villager, day 2. The table has just gone quiet.\nName one player to expel today and explain how the ballot against Player 1 influenced you."
    german = "Ehrlich gesagt, Spieler 6 klingt für mich nach Hexe, denn nur zwei wussten vom Gegengift."
    assert model.defect(prompt, german) == "language"
    assert model.defect(prompt + " Please answer in German.", german) is None
    assert model.defect("", german) is None and model.defect(None, german) is None
    assert model.defect(prompt, LONG) is None


def test_language_model_on_held_out_prompts(spark):
    rows = pairs.sample_prompts(queries._labelled_prompts(spark, MIDDLE))
    m = LanguageModel.fit(rows[::2])
    held = [(t, lang) for t, lang in rows[1::2] if lang in m.languages]
    # whole prompts, their English titles included
    assert sum(m.best(t) == lang for t, lang in held) / len(held) > 0.85


def test_no_training_text(spark):
    empty = pairs.PairModel.fit([], [])
    assert empty.defect("a prompt", "An answer that nobody can judge.") is None
    assert empty.defect("a prompt", " ") == "empty"


def test_nulls_clashing_columns_and_repeats(spark, model):
    df = spark.createDataFrame([("t", 1, None, None, 7), ("t", 1, None, None, 7), ("t", 2, "Say it.", LONG, 8)], "tab string, row_id bigint, prompt string, response string, defect int")
    out = pairs.find_defects(df, model, ["tab", "row_id"])
    assert out.columns == ["tab", "row_id", "defect"]
    assert sorted(map(tuple, out.distinct().collect())) == [("t", 1, "empty")]
    assert pairs.find_defects(df.limit(0), model, ["tab", "row_id"]).count() == 0


def test_found_columns_and_agreement(spark):
    p1, p4 = queries.p1_found(spark, MIDDLE), queries.p4_found(spark, MIDDLE)
    assert p1.columns == ["tab", "row_id", "defect"] and p4.columns == ["tab", "row_id"]
    cut = {(r.tab, r.row_id) for r in p4.collect()}
    rows = p1.collect()
    assert len({(r.tab, r.row_id) for r in rows}) == len(rows)
    truncated = {(r.tab, r.row_id) for r in rows if r.defect == "truncated"}
    assert len(cut ^ truncated) <= 0.05 * len(cut)


def test_rates_add_up(spark):
    rates = queries.p4_rates(spark, MIDDLE)
    total = rates.groupBy("tab").agg(F.sum("records").alias("n")).collect()
    assert {r.tab: r.n for r in total} == {"player_trace": 2000, "kto_dataset": 1000}
    assert all(0 <= r.cut <= r.records for r in rates.collect())


def test_is_running():
    assert is_running("four words are enough") and is_running("六个汉字就够了") and not is_running("Player 3") and not is_running("")
