import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from emberline.functions import verdicts
from emberline.sinks import outputs
from emberline.sources import files


@pytest.fixture
def games(tmp_path):
    for n, matchup in enumerate(["w-a_vs_v-b", "w-b_vs_v-b"], 1):
        folder = tmp_path / matchup / f"game_{n}"
        folder.mkdir(parents=True)
        (folder / "game_log.json").write_text(json.dumps([{"event": "vote", "day": n}, {"event": "end_game"}]))
        (folder / "Player_1.jsonl").write_text('{"phase": "1_day_vote"}\n\n{bad\n{"phase": "2_day_vote"}\n')
    (tmp_path / "w-a_vs_v-b" / "game_9").mkdir()
    (tmp_path / "w-a_vs_v-b" / "game_9" / "game_log.json").write_text("[{")
    return tmp_path


def test_game_folders(spark, games):
    rows = files.read_game_logs(spark, str(games))
    got = sorted((r.matchup, r.seq, r.e) for r in rows.select("matchup", "seq", F.try_variant_get("event", "$.event", "string").alias("e")).collect())
    assert got == [("w-a_vs_v-b", 1, "vote"), ("w-a_vs_v-b", 2, "end_game"), ("w-b_vs_v-b", 1, "vote"), ("w-b_vs_v-b", 2, "end_game")]
    traces = files.read_player_traces(spark, str(games))
    assert traces.count() == 4 and {r.player_id for r in traces.collect()} == {1}


def test_entries_strict_and_tolerant(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "sorted").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"n": 1}\n{bad\n')
    (tmp_path / "sorted" / "x.json").write_text('{"n": 2}\n')
    paths = [str(tmp_path / "a" / "x.json"), str(tmp_path / "sorted" / "x.json")]
    assert files.read_entries(spark, paths, strict=False).count() == 2
    assert files.read_entries(spark, paths, strict=False, without="sorted").count() == 1
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        files.read_entries(spark, paths).collect()


def test_records_of_any_layout(spark, tmp_path):
    for name, content in (("array", '[{"a": 1}, {"a": 2}]'), ("object", '{"a": 3}'), ("lines", '{"a": 4}\n\n{"a": 5}\nbad\n')):
        (tmp_path / f"{name}.json").write_text(content)
    rows = files.read_records(spark, str(tmp_path / "*.json")).select(F.try_variant_get("record", "$.a", "int").alias("a"))
    assert sorted(r.a for r in rows.collect()) == [1, 2, 3, 4, 5]


def test_short_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3], ["x", "y"])], "a array<int>, b array<string>")
    assert [tuple(r) for r in files.columns_to_rows(df, ["a", "b"], "pad").collect()] == [(1, "x"), (2, "y"), (3, None)]
    assert [tuple(r) for r in files.columns_to_rows(df, ["a", "b"], "repeat").collect()] == [("1", '["x","y"]'), ("2", '["x","y"]'), ("3", '["x","y"]')]
    with pytest.raises(Exception, match="different lengths"):
        files.columns_to_rows(df, ["a", "b"]).collect()


def test_parquets_and_absent_sources(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "p"))
    spark.range(3).withColumn("x", F.lit("v")).write.parquet(str(tmp_path / "q"))
    out = files.read_parquets(spark, [str(tmp_path / "p"), str(tmp_path / "q")])
    assert out.count() == 5 and out.filter("x IS NULL").count() == 2
    assert files.or_empty(spark, str(tmp_path / "none"), "id bigint").count() == 0


def test_phase_maps_and_guarded_writes(spark, tmp_path):
    rows = [("vote", True, "g1", 2, "2_day_vote"), ("vote", True, "g1", 2, "1_day_vote"), ("vote", True, "g1", 2, "1_day_vote"), ("vote", False, "g1", 10, "1_day_vote")]
    df = spark.createDataFrame(rows, "category string, label boolean, game_path string, player_id int, phase string")
    got = {(r.label, r.game_path): r.players for r in outputs.phase_map(df).collect()}
    assert got == {(True, "g1"): {"2": ["1_day_vote", "2_day_vote"]}, (False, "g1"): {"10": ["1_day_vote"]}}
    outputs.write_phase_maps(df, str(tmp_path / "maps"))
    assert spark.read.json(str(tmp_path / "maps")).count() == 2
    outputs.write_rows(df, str(tmp_path / "rows"))
    with pytest.raises(AnalysisException):
        outputs.write_rows(df, str(tmp_path / "rows"))
    outputs.write_rows(df, str(tmp_path / "rows"), overwrite=True)
    outputs.append_json(df.limit(1), str(tmp_path / "log"))
    outputs.append_json(df.limit(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_columnar_round_trip(spark, tmp_path):
    df = spark.range(25).withColumn("v", F.concat(F.lit("x"), "id"))
    outputs.write_columnar(df, str(tmp_path / "c"), "id", 4)
    back = files.columns_to_rows(spark.read.json(str(tmp_path / "c")), ["id", "v"])
    assert sorted((r.id, r.v) for r in back.collect()) == [(i, f"x{i}") for i in range(25)]


def test_paths_by_family():
    assert outputs.scoped_path("/out/", ["Tern-13b", "tern-7b", "Orchid Lite"]) == "/out/orchid_lite+tern"


@pytest.mark.parametrize(
    "said,want",
    [
        ("contradiction: yes, off topic: no", (True, None, False)), ("<contradiction>false</contradiction><hallucination>true</hallucination>", (False, True, None)),
        ('ok ```json\n{"result": {"contradiction": false, "hallucination": "no", "off topic": "no"}}\n```', (False, False, False)), ('contradiction: yes {"contradiction": false}', (False, None, None)), (None, (None, None, None)), ("nothing", (None, None, None)),
    ],
)
def test_verdicts(spark, said, want):
    assert tuple(verdicts.read_verdict(said)[k] for k in verdicts.ASKED) == want
    row = spark.createDataFrame([(said,)], "t string").select(verdicts.parse_verdict("t").alias("v")).select(
        "v.*", verdicts.accepted(F.col("v"), False).alias("lenient"), verdicts.accepted(F.col("v"), True).alias("strict")
    ).first()
    assert tuple(row)[:3] == want
    assert row.lenient == (want[0] is False) and row.strict == (want == (False, False, False))


def test_first_games_speech_files_and_summaries(spark, tmp_path):
    df = spark.createDataFrame([("g2", 1), ("g1", 2), ("g1", 3), ("g3", 4)], "game_path string, x int")
    assert sorted(r.x for r in files.first_games(df, 2).collect()) == [1, 2, 3]
    names = spark.createDataFrame([("/a/good_speech.jsonl",), ("/a/verified_speech.json",), ("/a/votes.json",), ("/speech/x.txt",)], "p string")
    assert [r.p for r in names.filter(files.is_speech_file(F.col("p"))).collect()] == ["/a/good_speech.jsonl"]
    (tmp_path / "summary.json").write_text('{"Game 1": {"winner": 1, "winner_reason": "r"}}\n{"Game 2": {"winner": 3}}\nbad\n')
    rows = files.read_summaries(spark, str(tmp_path / "summary.json")).collect()
    assert sorted((r.game, r.winner, r.reason) for r in rows) == [("Game 1", "impostors", "r"), ("Game 2", "crew", None)]


def test_rendering(spark):
    from emberline.functions import render

    row = spark.createDataFrame([(" Player  3 :teal", {"Player 3": "Seer", "4": "Witch"}, "x\n[Action] OLD\nmore", "no block")], "n string, m map<string,string>, a string, b string").select(
        render.tidy_name(F.col("n")), render.lookup_player(F.col("m"), F.lit(3)), render.lookup_player(F.col("m"), F.lit(4)), render.lookup_player(F.col("m"), F.lit(5)),
        render.with_action(F.col("a"), F.lit("NEW")), render.with_action(F.col("b"), F.lit("NEW")), render.english_roles(F.lit("女巫和守卫")),
    ).first()
    assert tuple(row) == ("Player 3: teal", "Seer", "Witch", None, "x\n[Action] NEW", "no block\n[Action] NEW", "Witch和Guard")
