"""Reading the JSON texts of the two games' logs; see ``operators.nested`` for what becomes of them."""

from __future__ import annotations

import json
import re

from emberline.operators.nested import Reader

_FENCE = re.compile(r"```(?:json)?(.*?)```", re.S | re.I)
_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = json.JSONDecoder()
_PLAYER = re.compile(r"^Player (\d{1,9})$")


def loads(text: object) -> object:
    """The JSON value of a text, None if it isn't one."""
    if not isinstance(text, str):
        return None
    try:
        return json.loads(text)
    except RecursionError:
        return loads_deep(text)
    except ValueError:
        return None


def loads_deep(text: str) -> object:
    """The same without recursion, for texts nested deeper than the standard parser goes."""
    end, at, stack, key = len(text), 0, [], None
    done, value = False, None
    while True:
        at = _SPACE.match(text, at).end()
        if not done:
            # a value begins here
            c = text[at : at + 1]
            if c in ("{", "["):
                stack.append((c, {} if c == "{" else [], key))
                at, key = _SPACE.match(text, at + 1).end(), None
                if text[at : at + 1] == ("}" if c == "{" else "]"):
                    at, done = at + 1, True
                    _, value, key = stack.pop()
                elif c == "{":
                    key, at = _key_at(text, at)
                    if key is None:
                        return None
                continue
            try:
                value, at = _SCALAR.raw_decode(text, at)
            except ValueError:
                return None
            done = True
            continue
        # a value is complete: it goes into what holds it
        if not stack:
            return value if at == end else None
        kind, holder, outer = stack[-1]
        if kind == "{":
            holder[key] = value
        else:
            holder.append(value)
        c = text[at : at + 1]
        at += 1
        if c == ",":
            done = False
            if kind == "{":
                key, at = _key_at(text, _SPACE.match(text, at).end())
                if key is None:
                    return None
        elif c == ("}" if kind == "{" else "]"):
            stack.pop()
            value, key = holder, outer
        else:
            return None


def _key_at(text: str, at: int) -> tuple[str | None, int]:
    """The member name at a place and the place behind its colon; None where there is none."""
    if text[at : at + 1] != '"':
        return None, at
    try:
        key, at = _SCALAR.raw_decode(text, at)
    except ValueError:
        return None, at
    at = _SPACE.match(text, at).end()
    return (key, at + 1) if text[at : at + 1] == ":" else (None, at)


def fenced_object(text: object) -> dict | None:
    """The JSON object that a text is, or holds in its first fence."""
    value = loads(text)
    if isinstance(value, dict):
        return value
    fence = _FENCE.search(text) if isinstance(text, str) else None
    value = loads(fence.group(1)) if fence else None
    return value if isinstance(value, dict) else None


def player_labels(obj: dict) -> dict[str, str]:
    """The members ``Player k`` with text values of ``Identity Labels`` where that is an object, else of the object itself."""
    inner = obj.get("Identity Labels")
    labels = inner if isinstance(inner, dict) else obj
    return {k: v for k, v in labels.items() if _PLAYER.match(k) and isinstance(v, str)}


def game_events(payload: str) -> dict | None:
    """A game file as ``{"events": [...]}`` from any of its three layouts; None if it can't be read.

    ``content`` that is the text of an object becomes the object; label texts inside it become label objects.
    """
    value = loads(payload)
    if isinstance(value, dict) and isinstance(value.get("game_log"), list):
        events = value["game_log"]
    elif isinstance(value, list):
        events = value
    else:
        lines = [x for x in payload.split("\n") if x.strip()] if isinstance(payload, str) else []
        events = [loads(x) for x in lines]
        if not events or any(e is None for e in events):
            return None
    out = []
    for event in events:
        if not isinstance(event, dict):
            out.append(event)
            continue
        content = event.get("content")
        if isinstance(content, str):
            inner = loads(content)
            content = inner if isinstance(inner, dict) else content
        if isinstance(content, dict) and "identity_labels" in content:
            labels = content["identity_labels"]
            labels = labels if isinstance(labels, dict) else fenced_object(labels)
            content = {**content, "identity_labels": player_labels(labels) if labels is not None else None}
        out.append({**event, "content": content})
    return {"events": out}


def agent_record(line: str) -> dict | None:
    """A log line's object; a prompt that is the text of an object becomes the object."""
    value = loads(line)
    if not isinstance(value, dict):
        return None
    inner = value.get("interaction")
    if isinstance(inner, dict) and isinstance(inner.get("prompt"), str):
        prompt = loads(inner["prompt"])
        if isinstance(prompt, dict):
            value = {**value, "interaction": {**inner, "prompt": prompt}}
    return value


def response_record(text: str) -> dict | None:
    """A response's object, with its labels under ``identity_labels``."""
    value = fenced_object(text)
    if value is None:
        return None
    rest = {k: v for k, v in value.items() if not _PLAYER.match(k) and k != "Identity Labels"}
    return {**rest, "identity_labels": player_labels(value)}


GAME_LOG = Reader(game_events, {"content": "event"})
AGENT_LOG = Reader(agent_record)
RESPONSE = Reader(response_record)
