"""Which logs a folder has, and what paths say."""

from pyspark.sql import functions as F

from emberline.sources import files


def test_nearest_logs_win(spark, tmp_path):
    for p in ("a/x.json", "a/one/x.json", "b/one/x.json", "b/two/x.json", "b/one/deep/x.json", "c/one/deep/x.json", "c/one/deep/er/x.json", "c/other.json"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("{}")
    paths = files.listing(spark, str(tmp_path))
    assert paths.count() == 8 and files.listing(spark, str(tmp_path), "other*").count() == 1
    roots = spark.createDataFrame([(f"{tmp_path}/{r}",) for r in ("a", "b", "c", "absent", "a")], "root string")
    got = sorted(r.path.removeprefix(f"{tmp_path}/") for r in files.resolve_logs(paths, roots, "x.json").collect())
    assert got == ["a/x.json", "b/one/x.json", "b/two/x.json", "c/one/deep/er/x.json", "c/one/deep/x.json"]


def test_paths(spark):
    rows = ["r/w-A_tmp0.5_vs_v-A/game_3/sub/f.json", "game_1", "r/game_2/game_5", "r/none/f", None]
    df = spark.createDataFrame([(p,) for p in rows], "p string").select("p", files.game_dir(F.col("p")).alias("g"), files.sides(F.col("p")).alias("s"))
    got = {r.p: (r.g, r.s.wolf, r.s.good, r.s.self_play) for r in df.collect()}
    assert got["r/w-A_tmp0.5_vs_v-A/game_3/sub/f.json"] == ("r/w-A_tmp0.5_vs_v-A/game_3", "A", "A", True)
    assert got["game_1"][0] == "game_1" and got["r/game_2/game_5"][0] == "r/game_2/game_5" and got["r/none/f"][0] is None and got[None][0] is None
