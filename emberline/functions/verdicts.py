"""Verdicts of a judge as text: tags, JSON (nested or fenced), or plain words; and the judgement they lead to."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from emberline.sources.game_text import fenced_object

# What a judge is asked about; each is bad where true.
ASKED = ("contradiction", "hallucination", "off_topic")
_YES, _NO = re.compile(r"^(true|yes|1|y|是|有)$", re.I), re.compile(r"^(false|no|0|n|否|无)$", re.I)
VERDICT = StructType([StructField(k, BooleanType()) for k in ASKED])


def truth(value: object) -> bool | None:
    if isinstance(value, bool):
        return value
    text = str(value).strip().strip("\"'.").lower()
    return True if _YES.match(text) else False if _NO.match(text) else None


def _search(value: object, key: str) -> object:
    """The first member called ``key`` anywhere inside, outer ones first."""
    level = [value]
    while level:
        below = []
        for v in level:
            if isinstance(v, dict):
                for k, x in v.items():
                    if str(k).lower().replace(" ", "_") == key:
                        return x
                below += list(v.values())
            elif isinstance(v, list):
                below += v
        level = below
    return None


def read_verdict(text: str | None) -> dict[str, bool | None]:
    """Plain words first, then tags, then JSON: what is more explicit overwrites what is less."""
    out: dict[str, bool | None] = dict.fromkeys(ASKED)
    if not text:
        return out
    value = fenced_object(text)
    if value is None:
        at = text.find("{")
        while at >= 0 and value is None:
            try:
                value = json.JSONDecoder().raw_decode(text, at)[0]
            except (ValueError, RecursionError):
                at = text.find("{", at + 1)
    for key in ASKED:
        word = key.replace("_", "[ _-]?")
        for pattern in (rf"{word}\s*[:=]\s*([^\s,;.<]+)", rf"<{word}>\s*([^<]+?)\s*</{word}>"):
            m = re.search(pattern, text, re.I)
            if m and truth(m.group(1)) is not None:
                out[key] = truth(m.group(1))
        found = truth(_search(value, key)) if value is not None else None
        if found is not None:
            out[key] = found
    return out


@F.pandas_udf(VERDICT)
def parse_verdict(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_verdict(t) for t in texts], columns=list(ASKED)).astype(object)


def accepted(verdict: Column, strict: bool) -> Column:
    """Lenient: no contradiction. Strict: none of the three. What the judge doesn't say counts as bad."""
    bad = [F.coalesce(verdict[k], F.lit(True)) for k in (ASKED if strict else ASKED[:1])]
    out = ~bad[0]
    for b in bad[1:]:
        out = out & ~b
    return out


# Spellings of labels.
TRUE_WORDS = ["true", "1", "yes", "y", "good", "positive", "desirable"]
FALSE_WORDS = ["false", "0", "no", "n", "bad", "negative", "undesirable"]


def label_or_null(text: Column) -> Column:
    """True, false, or null for what is neither."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(TRUE_WORDS), True).when(t.isin(FALSE_WORDS), False)


def label_or_true(text: Column) -> Column:
    """False only for the words of false, as truthiness has it; null stays null."""
    t = F.lower(F.trim(text))
    return F.when(text.isNull(), None).otherwise(~(t.isin(FALSE_WORDS) | (t == "")))
