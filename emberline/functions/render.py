"""Texts and records written back: names tidied, roles in English, actions put into answers, chat messages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from emberline.functions.roles import CHINESE


def tidy_name(name: Column) -> Column:
    """Blanks as single spaces, and ``: `` between number and colour."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"\s+", " "), r"\s*:\s*", ": ")


def lookup_player(roles: Column, key: Column) -> Column:
    """A player's entry in a map keyed ``3`` or ``Player 3``."""
    k = key.cast("string")
    return F.coalesce(F.try_element_at(roles, k), F.try_element_at(roles, F.concat(F.lit("Player "), k)))


def english_roles(text: Column) -> Column:
    """The text with Chinese role names in English, one after the other."""
    for zh, en in CHINESE.items():
        text = F.replace(text, F.lit(zh), F.lit(en))
    return text


def with_action(answer: Column, action: Column) -> Column:
    """The answer with the applied action in its ``[Action]`` block, or with such a block added."""
    block = F.concat(F.lit("[Action] "), action)
    has = answer.rlike(r"(?i)\[action\]")
    head = F.regexp_replace(answer, r"(?is)\[action\].*$", "")
    return F.when(has, F.concat(head, block)).otherwise(F.concat_ws("\n", answer, block))


def user_prompt(phase: Column, info: Column, memory: Column) -> Column:
    """The sections of a prompt that are there, in order."""
    part = lambda title, c: F.when(F.trim(c) != "", F.concat(F.lit(title + "\n"), F.trim(c)))
    return F.concat_ws("\n\n", part("[Phase]", phase), part("[State]", info), part("[Memory]", memory))


def to_messages(prompt: Column, completion: Column) -> Column:
    """Chat messages of a sample: those of the prompt, then those of the completion, blank ones and unknown roles left out."""
    both = F.concat(F.coalesce(prompt, F.array()), F.coalesce(completion, F.array()))
    known = F.filter(both, lambda m: m["role"].isin("system", "user", "assistant") & (F.trim(m["content"]) != ""))
    return F.transform(known, lambda m: F.struct(m["role"].alias("role"), F.trim(m["content"]).alias("content")))


def wolf_candidates(beliefs: Column) -> Column:
    """Players that a belief map calls werewolves, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(beliefs, lambda k, v: v == "Werewolf")))


def game_type(path: Column) -> Column:
    """Which game a path belongs to."""
    return F.when(path.rlike("night_day|werewolf|/w-"), "night_day").when(path.rlike("task_meeting|agent-logs"), "task_meeting")
