import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import MIDDLE
from emberline.llm import budget, mixing, packing, proportions, queries, tokenizers
from emberline.llm.packing import best_fit_rounds

TARGETS = "draw_id int, draw_permille int, phase string, label boolean, target_permille int, min_rows int"


def kto(spark, rows):
    return spark.createDataFrame(rows, "sample_id bigint, phase string, label boolean, draw_id int")


def test_draw_redistributes_and_keeps_floors(spark):
    rows = [(i, "A", True, 0) for i in range(100)] + [(200 + i, " b ", False, 0) for i in range(3)] + [(300 + i, "C", True, 0) for i in range(40)] + [(0, "a ", True, 0), (900, None, True, 0), (901, "A", None, 0), (None, "A", True, 0)]
    samples = proportions.usable_samples(kto(spark, rows))
    assert samples.count() == 143
    targets = spark.createDataFrame([(1, 500, "A", True, 600, 1), (1, 500, "B", False, 300, 5), (1, 500, "C", True, 100, 10), (1, 500, "none", True, 0, 1)], TARGETS)
    drawn = proportions.draw(samples, targets)
    report = {r.phase: r for r in proportions.draw_report(samples, targets, drawn).collect()}
    assert report["A"].size == 71 and sum(r.drawn for r in report.values()) == 71
    assert report["B"].drawn == 3 and report["B"].unmet and report["C"].drawn >= 10 and not report["C"].unmet
    assert report["none"].available == 0 and report["none"].unmet and report["none"].drawn == 0
    assert abs(report["A"].drawn / report["C"].drawn - 6) < 1.5 or report["C"].drawn == 10
    assert drawn.select("sample_id").distinct().count() == 71


def test_draw_of_empty_tables(spark):
    empty = proportions.usable_samples(kto(spark, []))
    targets = spark.createDataFrame([(1, 500, "A", True, 1000, 1)], TARGETS)
    drawn = proportions.draw(empty, targets)
    assert drawn.count() == 0
    assert [(r.available, r.drawn, r.unmet) for r in proportions.draw_report(empty, targets, drawn).collect()] == [(0, 0, True)]
    assert proportions.draw(empty, targets.limit(0)).count() == 0


def test_draw_is_the_same_for_any_partitions(spark):
    rows = [(i, "A" if i % 3 else "B", i % 2 == 0, 0) for i in range(600)]
    targets = spark.createDataFrame([(1, 300, "A", True, 500, 1), (1, 300, "B", False, 500, 2)], TARGETS)
    got = [sorted(r.sample_id for r in proportions.draw(proportions.usable_samples(kto(spark, rows).repartition(n)), targets).collect()) for n in (1, 11)]
    assert got[0] == got[1] and len(got[0]) == 180


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(0, 60), max_size=80))
def test_rounds_fill_without_overflow(capacity, lengths):
    lengths = [x for x in lengths if x <= capacity]
    counts = {x: lengths.count(x) for x in set(lengths)}
    placed, fill = [], {}
    for length, first_rank, first_bin, n, wrap in best_fit_rounds(capacity, counts):
        for i in range(n):
            placed.append((length, first_rank + i))
            fill[first_bin + i % wrap] = fill.get(first_bin + i % wrap, 0) + length
    assert sorted(placed) == sorted((x, k) for x, n in counts.items() for k in range(1, n + 1))
    assert all(v <= capacity for v in fill.values())


def best_fit_decreasing(capacity, lengths):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            g = min(fits)
            gaps.remove(g)
            gaps.append(g - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


def test_rounds_are_close_to_sequential_best_fit():
    rng = random.Random(5)
    for capacity in (100, 1000):
        lengths = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(1500)]
        counts = {x: lengths.count(x) for x in set(lengths)}
        used = max(b + min(n, w) - 1 for _, _, b, n, w in best_fit_rounds(capacity, counts))
        assert used <= 1.02 * best_fit_decreasing(capacity, lengths) + 1


def message(text):
    return [("user", text)]


def test_packing_of_odd_samples(spark):
    schema = "sample_id bigint, prompt array<struct<role string, content string>>, completion array<struct<role string, content string>>, capacity int, rank int"
    rows = [(1, message("x" * 25), None, 1, 1), (1, message("x" * 25), None, 1, 1), (2, None, None, 1, 1), (3, message(None), message("yy"), 1, 1), (4, message("é" * 10), [], 1, 1), (5, message(""), message(""), 1, 1)]
    items = packing.kto_items(spark.createDataFrame(rows, schema))
    assert {r.item_id: r.length for r in items.collect()} == {1: 25, 2: 0, 3: 2, 4: 10, 5: 0}
    specs = spark.createDataFrame([(1, "a", 10), (2, "b", 100), (3, "c", None), (4, "d", 0)], "spec_id int, spec_name string, capacity_chars int")
    packed = packing.pack(items, specs)
    got = sorted((r.spec_id, r.item_id, r.piece_no, r.piece_length) for r in packed.collect())
    assert [g for g in got if g[1] == 1] == [(1, 1, 1, 10), (1, 1, 2, 10), (1, 1, 3, 5), (2, 1, 1, 25)]
    assert len(got) == 12
    assert all(r.most_used <= r.capacity for r in packing.fill_report(packed).collect())
    assert [tuple(r) for r in packing.oversized(packed).collect()] == [(1, 1)]
    assert packing.pack(items.limit(0), specs).count() == 0 and packing.pack(items, specs.limit(0)).count() == 0


def test_containers_of_the_table(spark):
    packed = queries.p6_containers(spark, MIDDLE).cache()
    fill = {r.spec_id: r for r in packing.fill_report(packed.withColumnRenamed("sample_id", "item_id")).collect()}
    assert all(r.fill > 0.98 and r.most_used <= r.capacity for r in fill.values())
    assert packed.groupBy("spec_id").agg(F.count_distinct("sample_id").alias("n")).select("n").distinct().first().n == 1000
    whole = packed.filter("length <= capacity").groupBy("spec_id", "sample_id").count().filter("count > 1").count()
    assert whole == 0
    packed.unpersist()


def test_budget_counts_copies_once_per_occurrence(spark):
    df = spark.createDataFrame([(1, "a", "hello there"), (1, "a", "hello there"), (2, "a", "hello there"), (3, "b", None), (4, "b", ""), (5, None, "x")], "id int, s string, text string")
    got = {r.s: (r.texts, r.distinct_texts, r.tokens) for r in budget.token_budget(df, ["s"], ["id"]).collect()}
    n = tokenizers.token_counts(["hello there"])[0]
    assert got == {"a": (2, 1, 2 * n), "b": (2, 1, 0), None: (1, 1, 1)}
    assert budget.token_budget(df.limit(0), ["s"], ["id"]).count() == 0


def test_budget_equals_plain_counting(spark):
    total = queries.p5_budget(spark, MIDDLE).agg(F.sum("tokens"), F.sum("prompt_tokens") + F.sum("completion_tokens")).first()
    texts = {}
    for r in spark.read.parquet(f"{MIDDLE}/kto_dataset.parquet").collect():
        texts[r.sample_id] = [m.content for m in (r.prompt or []) + (r.completion or [])]
    want = sum(tokenizers.token_counts([t for x in texts.values() for t in x]))
    assert total[0] == total[1] == want


def test_mix_follows_rates(spark):
    docs = spark.createDataFrame([(i, "s1" if i < 800 else "s2" if i < 1000 else None, "word " * 20, 5) for i in range(1100)] + [(5000, "s1", None, 5), (5001, "s1", "", 5)], "doc_id bigint, source string, text string, copies int")
    tokens = mixing.document_tokens(docs)
    targets = spark.createDataFrame([(1, 1000, "s1", 500, 1), (1, 1000, "s2", 500, 2), (1, 1000, "gone", 100, 3)], "mix_id int, size_permille int, source string, target_permille int, max_repeats int")
    rates = mixing.mix_rates(tokens, targets)
    mixed = mixing.mix(tokens, rates)
    got = {r.source: r for r in mixing.mix_report(mixed, rates).collect()}
    assert got["gone"].given_tokens == 0 and got["gone"].rate == 0
    assert got["s2"].capped and got["s2"].most_uses == 2 and got["s2"].uses == 400
    assert abs(got["s1"].given_tokens - got["s1"].wanted_tokens) / got["s1"].wanted_tokens < 0.06
    assert mixing.emitted(mixed).count() == got["s1"].uses + 400
    assert mixing.emitted(mixing.mix(tokens.limit(0), rates)).count() == 0
