"""Texts with structure inside: fences, JSON, literals, targets, sections."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from emberline.sources.game_text import fenced_object


def unless_blank(col: Column) -> Column:
    return F.when(col != "", col)


def strip_fence(text: Column) -> Column:
    """What the first fence of three backticks holds, or the text itself; trimmed."""
    inside = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    return F.trim(F.when(inside != "", inside).otherwise(text))


def json_or_fence(text: Column) -> Column:
    """VARIANT of the text, or of what its first fence holds."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(strip_fence(text)))


def first_number(text: Column) -> Column:
    return unless_blank(F.regexp_extract(text, r"(\d+)", 1)).try_cast("int")


def all_digits(text: Column) -> Column:
    """All digits of the text as one number: ``1 and 2`` gives 12."""
    return unless_blank(F.regexp_replace(text, r"[^0-9]", "")).try_cast("bigint")


# What stands for no target.
NO_TARGET = ["", "0", "-1", "none", "null", "pass", "abstain", "no one", "nobody"]


def target_number(text: Column) -> Column:
    """The first number, null for the names of no target."""
    return F.when(~F.lower(F.trim(text)).isin(NO_TARGET), first_number(text))


def target_or_zero(text: Column) -> Column:
    """As ``target_number``, with 0 where somebody chose nobody and null where nothing was said."""
    return F.when(text.isNull(), None).when(F.lower(F.trim(text)).isin(NO_TARGET), 0).otherwise(first_number(text))


@F.pandas_udf(StringType())
def literal_json(texts: pd.Series) -> pd.Series:
    """JSON of a text that is JSON or a Python literal; null where it is neither or isn't an object."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        for parse in (json.loads, ast.literal_eval):
            try:
                value = parse(text)
            except (ValueError, SyntaxError, RecursionError, MemoryError):
                continue
            return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None
        return None

    return texts.map(one)


def object_of(text: Column) -> Column:
    """VARIANT of an object given as JSON, or as a Python literal; only the texts that aren't JSON go through Python."""
    direct = F.try_parse_json(text)
    return F.coalesce(direct, F.try_parse_json(literal_json(F.when(direct.isNull(), text))))


@F.pandas_udf(StringType())
def balanced_object(texts: pd.Series) -> pd.Series:
    """The first balanced {...} of each text that is JSON, strings respected; the fenced object first."""

    def one(text: str | None) -> str | None:
        if not text:
            return None
        fenced = fenced_object(text)
        if fenced is not None:
            return json.dumps(fenced, ensure_ascii=False)
        decoder, at = json.JSONDecoder(), text.find("{")
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(text, at)
                return json.dumps(value, ensure_ascii=False)
            except (ValueError, RecursionError):
                at = text.find("{", at + 1)
        return None

    return texts.map(one)


def canonical_map(pairs: Column) -> Column:
    """A map as text that doesn't depend on the order of its entries."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def message_text(messages: Column, sep: str = "\n") -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), sep)


def valid_messages(messages: Column) -> Column:
    """At least one message, and every one with a role and a content that isn't blank."""
    return F.coalesce(
        (F.size(messages) > 0) & F.forall(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull() & (F.trim(m["content"]) != "")), F.lit(False)
    )


# The actions of the task/meeting game.
ACTIONS = ["COMPLETE FAKE TASK", "COMPLETE TASK", "REPORT DEAD BODY", "CALL MEETING", "VIEW MONITOR", "KILL", "VENT", "MOVE", "VOTE", "SPEAK"]


def action_category(action: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in reversed(ACTIONS):
        out = F.when(F.upper(F.trim(action)).startswith(name), name).otherwise(out)
    return out


def room_players(info: Column) -> Column:
    """Players named in the line ``Players in <room>: ...``, as written."""
    line = F.regexp_extract(info, r"Players in [^:\n]+: ([^\n]*)", 1)
    return F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x)), lambda x: x != "")


def available_actions(info: Column) -> Column:
    """The numbered lines below ``Available actions:``."""
    block = F.regexp_extract(info, r"(?s)Available actions:\n(.*?)(?:\n\n|$)", 1)
    return F.filter(F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"^\d+\. ", "")), lambda x: x != "")


def tasks(info: Column) -> Column:
    """``name`` and ``done`` of the lines below ``Your Assigned Tasks:``."""
    block = F.regexp_extract(info, r"(?s)Your Assigned Tasks:\n(.*?)(?:\n\n|$)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^\d+\. "))
    return F.transform(
        lines, lambda x: F.struct(F.trim(F.regexp_replace(F.regexp_replace(x, r"^\d+\. ", ""), r"\[completed\]", "")).alias("name"), x.contains("[completed]").alias("done"))
    )


def normalised_action(raw: Column, available: Column) -> Column:
    """The first available action, speaking left out, that the raw text contains; else the raw text."""
    hits = F.filter(available, lambda a: raw.contains(a) & ~a.startswith("SPEAK:"))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), raw)


def belief_map(text: Column) -> Column:
    """Player number -> role of the lines ``Player N: Role=R``; the last line of a player counts."""
    numbers = F.regexp_extract_all(text, F.lit(r"Player (\d+): Role=(?:Crewmate|Impostor|unknown)"), F.lit(1))
    found = F.regexp_extract_all(text, F.lit(r"Player \d+: Role=(Crewmate|Impostor|unknown)"), F.lit(1))
    return F.map_from_arrays(F.transform(numbers, lambda x: x.cast("int")), found)
