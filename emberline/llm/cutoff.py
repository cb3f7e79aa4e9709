"""Texts that were cut off (problem 4).

Hashed logistic regression. Intact values of the corpus are cut artificially, at any place that doesn't end a sentence,
with and without something put after the cut; the intact values, also without their end marks, are the negatives. The
features are what stands last (characters, words), end marks, the state of brackets and fences, and the length of the
value against the lengths at which fields are usually cut. Every text inside a value is scored, the value as a whole too.

Defined cases: null, blank and placeholder values aren't cut; a bare choice or number isn't cut; a complete text without
end mark isn't cut; emoji, quotes and a line with the speaker's name may follow an end; a marker of omission doesn't
count as an end; very long values are scored whole; repeated rows give one row; empty tables give empty results.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberline.llm.answers import END_MARKS, Answer, End, has_content, is_running, read_answer, read_end, strip_blank

DIMS = 1 << 18
#: Values the model is fitted on.
SAMPLE_VALUES = 6000
#: Probability from which a text counts as cut.
LIMIT = 0.5
# Lengths at which fields are commonly cut.
FIELD_LIMITS = (64, 100, 128, 200, 250, 255, 256, 300, 400, 500, 512, 600, 800, 1000, 1024, 1200, 1500, 2000, 2048, 4000, 4096, 8000, 8192)
#: Sections that hold a choice, not running text.
CHOICES = {"action", "vote", "actions"}
BARE_CHOICE = re.compile(r"none|pass|abstain|skip|no action|\d+", re.I)
_DIGITS = re.compile(r"\d+")
_SUFFIXES = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20)
_WORDS = re.compile(r"\S+")


def _bin(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) & (DIMS - 1)


def end_features(end: End, key: str, length: int) -> list[int]:
    """Of the end of a text that stands under ``key`` in a value of ``length`` characters."""
    core = end.core[-60:]
    near = min((abs(length - limit) for limit in FIELD_LIMITS), default=99)
    out = ["bias", f"limit {min(near, 2)}", f"marker {end.marker}", f"mark {end.mark}"]
    if not end.mark:
        t = _DIGITS.sub("9", core)
        styled = any(c in END_MARKS for c in end.core)
        out += [f"styled {styled}", f"last {t[-1:]!r} {styled}", f"short {min(len(t) // 8, 6)}", f"key {_DIGITS.sub('#', key)}"]
        out += [f"{n}:{t[-n:]}" for n in _SUFFIXES if len(t) >= n]
        words = _WORDS.findall(t)
        for n in (1, 2, 3):
            if len(words) >= n:
                out.append(f"w{n}:{' '.join(words[-n:])}")
        out.append(f"line:{t.rsplit(chr(10), 1)[-1]}")
    return [_bin(x) for x in out]


def last_head(answer: Answer) -> str:
    return answer.texts[-1][0] if answer.kind == "sections" else ""


def structure_features(answer: Answer, text: str) -> list[int]:
    """Of the value as a whole."""
    depth = text.count("{") - text.count("}")
    last = strip_blank(text)[-1:]
    out = ["whole", f"whole kind {answer.kind}", f"whole fence {answer.open_fence}", f"whole {answer.kind} {answer.open_fence} {min(max(depth, -1), 2)}", f"whole last {last!r}"]
    if answer.kind == "sections":
        out.append("whole last head " + answer.texts[-1][0])
    return [_bin(x) for x in out]


def scored_parts(text: str, answer: Answer | None = None) -> list[list[int]]:
    """The feature lists of a value: of the whole and of each running text in it."""
    answer = answer or read_answer(text)
    if not has_content(answer):
        return []
    out = [structure_features(answer, text)]
    n = len(text)
    if answer.kind == "json":
        out += [end_features(read_end(t), k, n) for k, t in answer.texts if is_running(t)]
    elif answer.kind in ("prose", "sections"):
        whole = strip_blank(text)
        if last_head(answer).lower() in CHOICES and BARE_CHOICE.fullmatch(strip_blank(answer.texts[-1][1])):
            return out
        if answer.kind == "sections" or is_running(whole) or len(whole) > 12:
            out.append(end_features(read_end(whole), answer.kind, n))
    return out


@dataclass
class CutModel:
    weights: np.ndarray

    def probability(self, text: str | None, answer: Answer | None = None) -> float:
        if text is None:
            return 0.0
        parts = scored_parts(text, answer)
        if not parts:
            return 0.0
        return max(1.0 / (1.0 + np.exp(-np.clip(self.weights[p].sum(), -30, 30))) for p in parts)

    @classmethod
    def fit(cls, values: list[str], prompts: list[str] | None = None, seed: int = 7, passes: int = 60) -> CutModel:
        """On artificially cut copies of the values that look intact; lines of prompts are further intact texts."""
        examples, labels = make_examples(values, seed)
        rng = random.Random(seed)
        for prompt in prompts or []:
            lines = prompt.split("\n")
            for _ in range(2):
                text = strip_blank("\n".join(lines[: rng.randrange(1, len(lines) + 1)]))
                if is_running(text):
                    examples.append(end_features(read_end(text), "prose", len(text)))
                    labels.append(0)
        if not examples:
            return cls(np.zeros(DIMS, np.float32))
        sizes = np.array([len(e) for e in examples])
        flat = np.array([b for e in examples for b in e])
        row = np.repeat(np.arange(len(examples)), sizes)
        y = np.array(labels, float)
        w, g2 = np.zeros(DIMS), np.full(DIMS, 1e-8)
        balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
        for _ in range(passes):
            z = np.bincount(row, w[flat], len(y))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
            grad = np.bincount(flat, error[row], DIMS) + 1e-7 * w
            g2 += grad * grad
            w -= 0.5 * grad / np.sqrt(g2)
        return cls(w.astype(np.float32))


def looks_intact(text: str, answer: Answer, known: Counter) -> bool:
    """Whether a value is taken for intact in training: it parses and its texts end with marks, or it ends in a way that recurs."""
    if not has_content(answer) or answer.open_fence or answer.kind == "open":
        return False
    if answer.kind == "json":
        return all(read_end(t).mark for _, t in answer.texts if is_running(t))
    end = read_end(text)
    return (end.mark and not end.marker) or any(known[x] >= 5 for x in closings(text, answer))


def closings(text: str, answer: Answer) -> list[str]:
    """What recurs at the end of intact values that end without mark: the last line; where it is a choice also its last two words."""
    line = _DIGITS.sub("9", strip_blank(text).rsplit("\n", 1)[-1])[-200:]
    words = line.split()
    return [line, "… " + " ".join(words[-2:])] if last_head(answer).lower() in CHOICES and len(words) > 3 else [line]


def _ends(text: str) -> list[int]:
    """Places after which a sentence is complete: before and after its mark."""
    return [i for i, c in enumerate(text) if c in END_MARKS and not text[i - 1 : i].isdigit() or c in END_MARKS and i == len(text) - 1]


def make_examples(values: list[str], seed: int) -> tuple[list[list[int]], list[int]]:
    rng = random.Random(seed)
    known = Counter(x for v in values for x in closings(v, read_answer(v)))
    examples: list[list[int]] = []
    labels: list[int] = []

    def add(features: list[int], label: int) -> None:
        examples.append(features)
        labels.append(label)

    after = ["", "", "", " ", "\n\n", "...", "…", " [...]", '"', "\n"]
    plain = str.maketrans("", "", END_MARKS + ",，;；:：、")
    for value in values:
        answer = read_answer(value)
        if not looks_intact(value, answer, known):
            continue
        n = len(value)
        add(structure_features(answer, value), 0)
        if answer.kind in ("json", "sections"):
            for _ in range(2):  # the structure itself is cut
                at = rng.randrange(max(2, n // 10), n) if n > 2 else n
                cut = value[:at] + rng.choice(after)
                broken = read_answer(cut)
                if broken.kind != answer.kind or broken.open_fence or last_head(broken) != last_head(answer):
                    add(structure_features(broken, cut), 1)
        texts = [(k, t) for k, t in answer.texts if is_running(t)] if answer.kind == "json" else [(answer.kind, strip_blank(value))]
        for key, text in texts:
            if answer.kind == "prose" and not is_running(text) and len(text) <= 12:
                continue
            add(end_features(read_end(text), key, n), 0)
            ends = _ends(text)
            core = read_end(text).core.rstrip(END_MARKS + " ")
            add(end_features(read_end(core + rng.choice(after[:7])), key, n), 0)
            for i in rng.sample(ends, min(2, len(ends))):  # complete sentences further up, without their marks
                add(end_features(read_end(text[:i] + rng.choice(after[:7])), key, n), 0)
            bare = text.translate(plain)
            if answer.kind != "sections":
                add(end_features(read_end(bare), key, n), 0)
                for i in rng.sample(ends, min(2, len(ends))):
                    add(end_features(read_end(text[:i].translate(plain)), key, i), 0)
            full = set(ends) | {i + 1 for i in ends} | {len(core), len(text)}
            places = [rng.randrange(1, len(text)) for _ in range(3)] + [len(text) - rng.randrange(1, min(40, len(text))) for _ in range(2)] if len(text) > 2 else []
            for at in places:
                if at in full or text[at - 1] in END_MARKS or not text[at:].strip(END_MARKS + "\"' \n"):
                    continue
                length = rng.choice([at, n, n - len(text) + at])
                add(end_features(read_end(text[:at] + rng.choice(after)), key, length), 1)
            if len(bare) > 8 and answer.kind != "sections":
                at = len(bare) - rng.randrange(2, min(30, len(bare)))
                add(end_features(read_end(bare[:at]), key, at), 1)
    return examples, labels


def ends_as_prompt(text: str, prompt: str | None) -> bool:
    """Whether the last line of an answer is a whole line of its prompt, such as an action of a list: a copy, not a cut."""
    last = strip_blank(text).rsplit("\n", 1)[-1].strip()
    return len(last) > 5 and bool(prompt) and last in prompt and last in (x.strip() for x in prompt.split("\n"))


def score_values(values: DataFrame, model: CutModel, keep: list[str], text: str = "text", prompt: str = "prompt") -> DataFrame:
    """(keep..., probability) of every value, given its prompt; no shuffle."""
    shared = values.sparkSession.sparkContext.broadcast(model.weights)  # 1 MB, whatever the data
    schema = ", ".join(f"`{c}` {values.schema[c].dataType.simpleString()}" for c in keep) + ", probability double"
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CutModel(shared.value)
        for batch in batches:
            scores = []
            for t, p in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist()):
                score = model.probability(t)
                scores.append(0.0 if score >= LIMIT and ends_as_prompt(t, p) else score)
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(scores, pa.float64())], [*keep, "probability"])

    return values.select(*keep, text, prompt).mapInArrow(run, schema)


def completion_texts(completion: Column) -> Column:
    """The contents of a message array, null ones left out."""
    return F.filter(F.transform(F.coalesce(completion, F.array()), lambda m: m["content"]), lambda c: c.isNotNull())
