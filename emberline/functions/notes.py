"""Texts of players taken apart: whom a speech accuses, and what Chinese notes, summaries and prompts state."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from emberline.functions.text import unless_blank


# -- accusations in meetings -------------------------------------------------------------------------------------------
#: Ways of accusing, with {} for the names of a player.
ACCUSING = (
    r"\b(?:vote|eject|suspect|accuse|accusing|saw|seen|watched|caught)\s+{}\b",
    r"\b(?:it's|it is|impostor is|imposter is)\s+{}\b",
    r"\b{}\s+(?:is|was|seems|looks|acted|killed|kill|vented|vent|lied|lying|deflect|faked|fake)\b",
    r"\b{}\s+[^\n]*?\b(?:suspicious|sus|impostor|imposter)\b",
)


def player_name(name: Column) -> Column:
    """``Player 1: red`` however it is spaced."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"\s+", " "), r"\s*:\s*", ": ")


def accuses(speech: Column, name: Column) -> Column:
    """Whether the speech accuses the player of a ``player_name``, by number or by colour; false for a name with neither."""
    number = F.concat(F.lit("player "), unless_blank(F.regexp_extract(name, r"(?i)Player\s+(\d+)", 1).try_cast("int").cast("string")))
    colour = unless_blank(F.lower(F.trim(F.regexp_extract(name, r"^[^:]*:(.*)$", 1))))
    either = F.array_join(F.transform(F.filter(F.array(number, colour), lambda x: x.isNotNull()), lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), "|")
    names = F.concat(F.lit("(?:"), unless_blank(either), F.lit(")"))
    parts = [x for p in ACCUSING for x in (F.lit("|"), F.lit(p.split("{}")[0]), names, F.lit(p.split("{}")[1]))][1:]
    return F.coalesce(F.rlike(F.lower(speech), F.concat(*parts)), F.lit(False))


# -- notes, summaries and prompts in Chinese ---------------------------------------------------------------------------
def _strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+\z", "")


def _inside(col: Column, pattern: str) -> Column:
    """The first group in the whole text, null where the pattern isn't met."""
    return F.when(col.rlike("(?sU)" + pattern), F.regexp_extract(col, "(?sU)" + pattern, 1))


def _whole_summary(note: Column) -> Column:
    return _inside(F.replace(note, F.lit("#投票原因"), F.lit("投票原因")), r"总结：\s*(.*?)(?=投票原因)")


def summary(note: Column) -> Column:
    """The summary that a note holds; the note itself where it marks none."""
    return F.coalesce(_whole_summary(note), _inside(note, r"总结：\s*(.*?)\n综上"), note)


def _last_of_each(pairs: Column) -> Column:
    return F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["name"] == x["name"]))


def _pairs(text: Column, pattern: str, kind: str) -> Column:
    both = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2)]
    return _last_of_each(F.transform(F.arrays_zip(*[b.alias(n) for b, n in zip(both, "ab")]), lambda x: F.struct(x["a"].try_cast(kind).alias("name"), _strip(x["b"]).alias("said"))))


def topics(note: Column) -> Column:
    """(name, said) of the ``**name**：said`` parts of a marked summary, the last of each name; null without one."""
    return _pairs(_whole_summary(note), r"(?sU)\*\*(.*?)\*\*：(.*?)(?=\*\*|#|$)", "string")


def noted_roles(note: Column) -> Column:
    return _strip(_inside(F.concat(note, F.lit("\n")), r"主观身份判断：\s*(.*?)\n"))


def vote_reason(text: Column) -> Column:
    """The reason for a vote; the text itself where it marks none."""
    found = _strip(_inside(F.replace(text, F.lit("# 综上，"), F.lit("综上，")), r"投票原因：\s*(.*?)。\n基于上述"))
    return F.replace(F.coalesce(found, text), F.lit("根据上述观察，可以做出如下分析："), F.lit(""))


def predicted_roles(text: Column) -> Column:
    """(name, said): player number and role of every prediction, the last of each player."""
    part = F.coalesce(_strip(_inside(text, r"基于上述分析，可以预测玩家身份为：\s*(.*?)\s*。\n综上")), text)
    return _pairs(part, r"(?U)(\d+)号玩家是([^\n]*?)。", "int")


# What is taken from a prompt, how it is called and where it stands.
PROMPT_PARTS = (
    ("第1天总结：", r"第1天总结：\s*(.*?)第1天投票记录"), ("第2天总结：", r"第2天总结：\s*(.*?)第2天投票记录"), ("我的投票：", r"# 我的投票：\s*(.*?);"),
    ("昨晚发生：", r"昨晚发生：\s*(.*?);"), ("昨晚行动：", r"昨晚行动：\s*(.*?);"), ("前置位发言：\n", r"本轮在你之前的玩家发言：(.*?)请根据上述内容形成你本轮的发言。"),
)


def prompt_digest(prompt: Column) -> Column:
    """What a prompt tells of earlier days, the night, the vote and earlier speeches; empty where it tells nothing."""
    return F.concat(*[F.coalesce(F.concat(F.lit(name), _inside(prompt, p), F.lit("\n")), F.lit("")) for name, p in PROMPT_PARTS])


#: Speeches in a prompt: bold names, "N said at ...", and lines of a list; the first wording that is found counts.
SPEECHES = (
    r"(?is)\*\*Player\s*(\d+)\*\*[:：]\s*(.*?)(?=\n\*\*Player\s*\d+\*\*[:：]|\n\nYou are currently|$)",
    r"(?is)(\d+)\s+said\s+at\s+.*?:\s*(.*?)(?=\d+\s+said\s+at|Please analyze|$)",
    r"(?m)^[-*•]\s+[^\d\n:：]{0,20}(\d{1,4})[^\d\n:：]{0,6}[:：]\s*(\S.*)$",
)


def speeches(prompt: Column) -> Column:
    """Player number -> the last speech of theirs that the prompt tells."""
    found = None
    for pattern in SPEECHES:
        pairs = F.arrays_zip(F.regexp_extract_all(prompt, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(prompt, F.lit(pattern), F.lit(2)).alias("v"))
        pairs = F.transform(pairs, lambda x: F.struct(x["k"].try_cast("int").alias("k"), F.regexp_replace(x["v"], r"^\s+|\s+$", "").alias("v")))
        pairs = F.filter(pairs, lambda x: x["k"].isNotNull() & (x["v"] != ""))
        found = pairs if found is None else F.when(F.size(found) > 0, found).otherwise(pairs)
    return F.map_from_entries(found)


def fact_conflicts(said: Column, info: Column, memory: Column, tasks: Column) -> Column:
    """Which rules a speech breaks: where one is, tasks claimed as done, deaths denied, and witness claims without evidence."""
    quoted = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    low, facts = F.lower(said), F.lower(F.concat_ws("\n", info, memory))
    here = F.nullif(F.regexp_extract(info, r"Current Location: ([^\n]+)", 1), F.lit(""))
    claimed = F.nullif(F.regexp_extract(said, r"\b(?i:I am|I'm) (?:currently )?(?:in|at) (?:the )?([A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*)*) right now\b", 1), F.lit(""))
    claimed = F.coalesce(claimed, F.nullif(F.regexp_extract(said, r"\b(?i:currently) (?:in|at) (?:the )?([A-Z][A-Za-z]*(?: [A-Z][A-Za-z]*)*)", 1), F.lit("")))
    elsewhere = claimed.isNotNull() & here.isNotNull() & (claimed != F.trim(here))
    undone = F.exists(tasks, lambda t: ~t["done"] & F.regexp_like(low, F.concat(F.lit(r"\b(?:completed|finished|did)\b[^.?!\n]*"), quoted(F.lower(t["name"])))))
    nobody = low.rlike("no one died|nobody died|no deaths|no dead bodies") & facts.rlike(r"\(dead\)|dead body|was voted out")
    history = F.lower(F.concat_ws("\n", F.regexp_extract(info, r"(?s)Observation history:\n(.*?)(?:\n\n|$)", 1), F.regexp_extract(info, r"(?s)Action history:\n(.*?)(?:\n\n|$)", 1), memory))
    unseen = low.rlike(r"\b(?:i saw|i witnessed)\b[^.?!\n]*(?:kill|vent)") & ~history.rlike("kill|vent")
    rules = [(elsewhere, "location"), (undone, "task"), (nobody, "death"), (unseen, "witness")]
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), name) for broken, name in rules]))
