"""What speeches say of players, against the reference's rules written out in plain Python."""

import re

import pytest

from conftest import MIDDLE
from emberline.plans import extras
from emberline.sources.logs import content_of, game_events


def called(said):
    out = set()
    for pattern in (r"Player\s*(\d+)[^\n]{0,80}?(?:werewolf|wolf|狼人)", r"(\d+)号[^\n]{0,40}?狼人"):
        for m in re.finditer(pattern, said or "", flags=re.IGNORECASE):
            if not re.search(r"not\s+(?:a\s+)?(?:werewolf|wolf)|不是.{0,6}狼人", m.group(0).lower()) and int(m.group(1)):
                out.add(int(m.group(1)))
    return out


@pytest.mark.parametrize(
    "said,whom",
    [("3号玩家的发言更像狼人。", {3}), ("Player 4 IS THE WOLF", {4}), ("Player 2 is not a werewolf.", set()), ("我认为5号不是一张狼人牌", set()), ("Player 6\nwolf", set()), ("Player 0 is a wolf", set()),
     ("Player 7 and Player 8 sound like a Werewolf; 1号是狼人", {7, 1}), ("Player 99999999999 is a wolf", set()), (None, set()), ("", set())],
)
def test_called_wolves(spark, said, whom):
    df = spark.createDataFrame([(said,)], "said string")
    assert set(df.select(extras.called_wolves(df.said)).first()[0] or []) == whom


def test_accusations_of_the_table(spark):
    s = game_events(spark, MIDDLE).filter("event IN ('speech', 'speech_pk')").select("file_id", "source", content_of("speech_content").alias("said"))
    want = {}
    for file_id, source, t in {(r.file_id, r.source, t) for r in s.collect() for t in called(r.said)}:
        want[file_id] = want.get(file_id, 0) + 1
    assert {r.file_id: r.accusations for r in extras.x_wolf_accusations(spark, MIDDLE).collect()} == want
    english = {(r.file_id, r.source, n) for r in s.collect() for n in re.findall(r"Player (\d+) sounds like a Werewolf", r.said or "")}
    assert sum(want.values()) > len(english) > 0  # other wordings and the Chinese ones count as well


@pytest.mark.parametrize(
    "said,claim",
    [("我拿的是预言家，昨晚看了3号玩家。", "Seer"), ("I hold the Witch card.", "Witch"), ("i hold the ordinary villager card", "Villager"), ("我拿的是狼人。I hold the Seer card.", "Werewolf"), ("I hold the winning card", None), ("3号玩家像女巫", None), (None, None)],
)
def test_claimed_role(spark, said, claim):
    df = spark.createDataFrame([(said,)], "said string")
    assert df.select(extras.claimed_role(df.said)).first()[0] == claim


def test_claims_of_chinese_speakers_count(spark):
    total = lambda q: q(spark, MIDDLE).agg({"players": "sum"}).first()[0]
    s = game_events(spark, MIDDLE).filter("event IN ('speech', 'speech_pk')").select("file_id", "source", content_of("speech_content").alias("said"))
    english = s.filter("said rlike 'I hold the [A-Za-z]+ card'").select("file_id", "source").distinct().count()
    assert total(extras.x_role_claims) > english > 0
