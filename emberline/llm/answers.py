"""The parts of an answer: its structure, the running texts in it, and whether anything is in it at all."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from emberline.sources.game_text import loads

#: Marks that end a sentence.
END_MARKS = ".!?。！？"
_BLANK = re.compile(r"[\s ​-‏ - ⁠　﻿]+")
_FENCE = re.compile(r"```[ \t]*(?:json|JSON)?[ \t]*\r?\n?")
#: What may follow the end of a text without belonging to it: blanks, quotes, closing marks, emoji and other symbols.
_TRAIL = re.compile(r"(?:[\s ​-‏⁠﻿\"'”’»›“‘)\]」』*_~←-⯿\U0001f000-\U0001faff️])+$")
_MARKER = re.compile(r"(?:\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|\.\.\.|…+))+$")
#: A last line that names a speaker and says nothing.
_SIGNATURE = re.compile(r"(?<=[.!?。！？])[\"”’]?\s*\n\s*[^\n.!?。！？,，:：]{0,14}\d[^\n.!?。！？,，:：]{0,6}$")
_SECTION = re.compile(r"^\[([A-Z][A-Za-z ]{2,30})\][ \t]*", re.M)
_TAG = re.compile(r"<[^<>]{0,40}>")
_RUNNING = re.compile(r"\S\s+\S+\s+\S+\s+\S|(?:[\u3400-\u9fff][^\u3400-\u9fff]*){6}")
#: How much of the end of a text is looked at to find what follows its last sentence.
_TAIL = 200
# Contents that stand for no content.
PLACEHOLDERS = {"", "-", "--", "...", "…", "n/a", "na", "none", "null", "nil", "empty", "tbd", "todo", "undefined", "空", "无", "\"\"", "''", "[]", "{}", "()", "<>"}

_LONGEST = max(map(len, PLACEHOLDERS))


def strip_blank(text: str) -> str:
    """Without blanks of any kind at either end."""
    start = _BLANK.match(text)
    text = text[start.end() :] if start else text
    end = len(text)
    while end and _BLANK.fullmatch(text[end - 1]):
        end -= 1
    return text[:end]


@dataclass
class Answer:
    """``kind``: empty, json, open (a structure that doesn't parse), sections or prose.

    ``texts``: (key, text) of the strings inside; the whole text under the key "" for prose. ``open_fence``: a fence that isn't closed.
    """

    kind: str
    texts: list[tuple[str, str]] = field(default_factory=list)
    open_fence: bool = False
    value: object = None


def _leaves(key: str, value: object) -> list[tuple[str, str]]:
    out, todo = [], [(key, value)]
    while todo:
        k, v = todo.pop()
        if isinstance(v, dict):
            todo.extend(reversed([(str(a), b) for a, b in v.items()]))
        elif isinstance(v, list):
            todo.extend(reversed([(k, b) for b in v]))
        elif v is not None:
            out.append((k, v if isinstance(v, str) else json.dumps(v)))
    return out


def read_answer(text: str | None) -> Answer:
    if text is None:
        return Answer("empty")
    s = strip_blank(text)
    fence, body, open_fence = _FENCE.search(s), s, False
    if fence and len(_BLANK.sub(" ", s[: fence.start()])) <= 80:
        body = s[fence.end() :]
        close = body.find("```")
        open_fence = close < 0
        body = strip_blank(body if open_fence else body[:close])
    if body[:1] in "{[\"" and body and not _SECTION.match(body):
        value = loads(body)
        if value is not None:
            return Answer("json", _leaves("", value), open_fence, value)
        if body[0] != '"':
            return Answer("open", [("", body)], open_fence)
    if _SECTION.search(body):
        heads = list(_SECTION.finditer(body))
        texts = [("", body[: heads[0].start()])] if strip_blank(body[: heads[0].start()]) else []
        for h, nxt in zip(heads, [*heads[1:], None]):
            texts.append((h.group(1), body[h.end() : nxt.start() if nxt else len(body)]))
        return Answer("sections", texts, open_fence)
    return Answer("prose", [("", body)], open_fence)


def is_placeholder(text: str) -> bool:
    text = strip_blank(_TAG.sub("", text) if "<" in text else text)
    return len(text) <= _LONGEST and text.lower() in PLACEHOLDERS


def has_content(answer: Answer) -> bool:
    """Whether any string inside is more than blanks, placeholders or structure; numbers and bare choices are content."""
    return answer.kind != "empty" and any(not is_placeholder(t) for _, t in answer.texts)


@dataclass
class End:
    """The end of a text: ``core`` without what may follow it, whether a mark ends it, and whether a marker of omission follows."""

    core: str
    mark: bool
    marker: bool


def read_end(text: str) -> End:
    if text[-1:] in END_MARKS and text and text[-2:-1] not in ".…":
        return End(text, True, False)
    text = strip_blank(text)
    head, tail = text[:-_TAIL], text[-_TAIL:]
    core, marker = _cut_trail(tail)
    if head and len(core) < 20:  # what is cut off may reach beyond the window; where it doesn't, the window changes nothing
        core, marker = _cut_trail(text)
        head = ""
    core = head + core
    return End(core, bool(core) and core[-1] in END_MARKS, marker)


def _cut_trail(text: str) -> tuple[str, bool]:
    t, marker = text, False
    while True:
        m = _MARKER.search(t)
        shorter = t if m else _TRAIL.sub("", t)
        m = _MARKER.search(shorter)
        if m and m.start() > 0:
            marker, shorter = True, shorter[: m.start()]
        s = _SIGNATURE.search(shorter)
        if s:
            shorter = shorter[: s.start()]
        if shorter == t or not shorter:
            return t, marker
        t = shorter


def is_running(text: str) -> bool:
    """Whether a string is running text (four words, or six Han characters) rather than a name, a number or a choice."""
    return bool(_RUNNING.search(text))
