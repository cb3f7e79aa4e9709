"""Accusations and Chinese notes, against the reference's rules written out in plain Python."""

import re

import pytest

from conftest import MIDDLE
from emberline.functions import notes
from emberline.plans import entries


def accused(speech, names):
    out = set()
    for name in names:
        tokens = [f"player {int(m.group(1))}"] if (m := re.search(r"Player\s+(\d+)", name, re.I)) else []
        if ":" in name and name.split(":", 1)[1].strip():
            tokens.append(name.split(":", 1)[1].strip().lower())
        t = "(?:%s)" % "|".join(map(re.escape, tokens))
        patterns = (
            rf"\b(?:vote|eject|suspect|accuse|accusing|saw|seen|watched|caught)\s+{t}\b", rf"\b(?:it's|it is|impostor is|imposter is)\s+{t}\b",
            rf"\b{t}\s+(?:is|was|seems|looks|acted|killed|kill|vented|vent|lied|lying|deflect|faked|fake)\b", rf"\b{t}\s+.*?\b(?:suspicious|sus|impostor|imposter)\b",
        )
        if tokens and any(re.search(p, speech.lower()) for p in patterns):
            out.add(name)
    return out


NAMES = ["Player 1: red", "Player 2: dark (blue)", "Player 12: teal", "Guest"]


@pytest.mark.parametrize("speech", ["I saw RED in the vent", "Player 12 killed him", "It's Player 2.", "player 1 was quiet and player 12 is sus", "dark (blue) lied", "teal did nothing wrong", "vote player 1, I mean it", ""])
def test_accuses(spark, speech):
    df = spark.createDataFrame([(speech, n) for n in NAMES], "speech string, name string")
    assert {r.name for r in df.filter(notes.accuses(df.speech, df.name)).collect()} == accused(speech, NAMES)


def test_accused_of_the_table(spark):
    e = entries._ordered_entries(spark, MIDDLE).select("log_path", "game", "line_id", "action", "player", "identity").collect()
    names = {}
    for r in e:
        if r.player and r.identity in ("Crewmate", "Impostor"):
            names.setdefault((r.log_path, r.game), set()).add(re.sub(r"\s*:\s*", ": ", re.sub(r"\s+", " ", r.player.strip())))
    want = {(r.line_id, a) for r in e if r.action and r.action.startswith("SPEAK") for a in accused(re.sub(r"^SPEAK[: ]*", "", r.action), names.get((r.log_path, r.game), ()))}
    got = entries.e_accused(spark, MIDDLE).collect()
    assert want and len(got) == len(want) and {(r.line_id, r.accused) for r in got} == want


NOTE = "总结： **局势**：3号可疑 **站边**：站5号 **局势**：2号可疑 #投票原因：根据上述观察，可以做出如下分析：3号说谎。\n基于上述分析，可以预测玩家身份为：3号玩家是狼人。5号玩家是预言家。3号玩家是女巫。。\n综上，投3号。\n主观身份判断： 3号狼人 \n"


def test_notes(spark):
    df = spark.createDataFrame([(NOTE,), ("总结：一句话\n综上",), ("nothing marked",), (None,)], "t string")
    c = df.t
    rows = df.select(notes.summary(c).alias("s"), notes.topics(c).alias("t"), notes.noted_roles(c).alias("n"), notes.vote_reason(c).alias("v"), notes.predicted_roles(c).alias("p")).collect()
    assert rows[0].s.startswith("**局势**") and {x.name: x.said for x in rows[0].t} == {"局势": "2号可疑", "站边": "站5号"}
    assert rows[0].n == "3号狼人" and rows[0].v == "3号说谎"
    assert {x.name: x.said for x in rows[0].p} == {3: "女巫", 5: "预言家"}
    assert [r.s for r in rows[1:]] == ["一句话", "nothing marked", None]
    assert rows[1].t is None and rows[2].v == "nothing marked" and rows[2].p == [] and rows[3].n is None


def test_prompt_digest(spark):
    df = spark.createDataFrame([("第1天总结： 平安。第1天投票记录 # 我的投票： 3号;昨晚发生：2号死亡;本轮在你之前的玩家发言：\n1号：过。请根据上述内容形成你本轮的发言。",), ("none",)], "t string")
    assert [r[0] for r in df.select(notes.prompt_digest(df.t)).collect()] == ["第1天总结：平安。\n我的投票：3号\n昨晚发生：2号死亡\n前置位发言：\n\n1号：过。\n", ""]
