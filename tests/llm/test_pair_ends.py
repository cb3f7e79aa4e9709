"""The ends of texts are counted over all rows, not over a sample."""

import random

import numpy as np
import pytest

from emberline.llm import pairs, queries
from emberline.llm.language import EndCounts, EndModel


def brute_force(rows):
    """The end model of all distinct pairs and prompt lines, without Spark and without a choice of suffixes."""
    texts = [t for _, r in sorted({(p or "", r) for p, r in rows if r is not None}) for t in pairs.complete_texts(r)]
    return EndModel.fit(texts + sorted({x for p, _ in rows for x in pairs._lines(p or "")}))


def rare_ends(n=13_000, kinds=60):
    """Answers with full sentences, and kinds of closing words without mark that three answers each share."""
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("mor", "tal", "ven", "kis", "lur", "dan") for b in ("ta", "rel", "on", "ish", "uk")]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    ends = [f"vexing zu{chr(97 + i % 26)}{chr(97 + i // 26)}q harbours" for i in range(kinds)]
    rows = [(f"Speak on {say(3)} in turn {i}.", f"{say(6)}. Vexing harbours of {say(4)}. The {say(2)} are vexing harbours beyond {say(3)}.") for i in range(n)]
    return rows + [(f"Close turn {j} with {say(2)}.", f"{say(5)}. In the end {say(3)} {end}") for end in ends for j in range(3)]


def test_ends_of_all_rows(spark, tmp_path):
    rows = rare_ends()
    traces = [(i, *x) for i, x in enumerate(rows)]
    spark.createDataFrame(traces, "trace_id bigint, prompt string, response string").write.parquet(f"{tmp_path}/player_trace.parquet")
    message = "array<struct<role string, content string>>".replace(" string", ":string")
    spark.createDataFrame([], f"sample_id string, prompt {message}, completion {message}, lang string").write.parquet(f"{tmp_path}/kto_dataset.parquet")
    found = {int(r.row_id) for r in queries.p1_found(spark, str(tmp_path)).collect() if r.defect == "truncated"}
    model = pairs.PairModel.fit([], [], pairs.count_pairs(spark.createDataFrame(rows, "prompt string, response string"), spark.createDataFrame([], "text string, lang string")))
    model.ends = brute_force(rows)
    want = {i for i, x in enumerate(model.defects([p for p, _ in rows], [r for _, r in rows])) if x == "truncated"}
    assert found == want
    assert not any(i >= len(rows) - 180 for i in found)  # ends that three answers share are complete ones


def test_slices_and_copies_change_nothing(spark, monkeypatch):
    rows = [(p, r[: 20 + i % 90]) for i, (p, r) in enumerate(rare_ends(600, 20))]
    df = lambda x: spark.createDataFrame([(i, *r) for i, r in enumerate(x)], "row_id int, prompt string, response string")
    model = pairs.PairModel.fit([], rows)
    one = {tuple(r) for r in pairs.find_all_defects(df(rows), model, ["row_id"]).collect()}
    assert any(x == "truncated" for _, x in one)
    monkeypatch.setattr(pairs, "TAILS", 40)
    assert {tuple(r) for r in pairs.find_all_defects(df(rows * 3).repartition(5), model, ["row_id"]).collect() if r.row_id < len(rows)} == one


@pytest.mark.parametrize("size", [1, 60, 10**6])
def test_end_counts_agree_with_the_fitted_model(size, monkeypatch):
    monkeypatch.setattr("emberline.llm.language.END_BLOCK_CHARS", size)
    rows = rare_ends(300, 20)
    tails = sorted({r[-24 - i % 40 :][:24] for i, (_, r) in enumerate(rows)} | {"", "x", "不在", "harbours\nof"})
    counts = EndCounts(tails)
    for _, r in rows:
        counts.put([r])
    keys, closing, size = counts.rows()
    whole = EndModel.of_counts(keys, closing, size)
    fitted = EndModel.fit([r for _, r in rows])
    assert len(whole.keys) > 100 and len(whole.keys) < len(fitted.keys)
    assert np.allclose(whole.tail_odds(tails), fitted.tail_odds(tails))


def test_no_tails_no_rows(spark):
    model = pairs.PairModel.fit([], [])
    empty = spark.createDataFrame([], "row_id int, prompt string, response string")
    assert pairs.find_all_defects(empty, model, ["row_id"]).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, "Say it.", "It is said.")], "row_id int, prompt string, response string")
    assert [tuple(r) for r in pairs.find_all_defects(none, model, ["row_id"]).collect()] == [(1, "empty")]
    assert EndCounts([]).rows()[0].size == 0
