"""A minimal acyclic transducer from words to lists of ids, held in flat arrays that can be memory-mapped.

Words are byte strings. Sorted words are added one by one; a suffix that can no longer change is looked up in a register
of finished states, so equal suffixes share their states (the automaton is minimal). Each arc carries a number; the sum
of the numbers along a word is its place in sorted order, and that place selects the word's ids in a table.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np

_ARRAYS = ("first", "label", "goal", "weight", "final", "ids_from", "ids")


class _Builder:
    """Finished states are tuples (final, ((label, state), ...)) in a register."""

    def __init__(self) -> None:
        self.register: dict[tuple, int] = {}
        self.states: list[tuple] = []

    def _finish(self, node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in self.register:
            self.register[key] = len(self.states)
            self.states.append(key)
        return self.register[key]

    def build(self, words: list[bytes]) -> int:
        path: list[list] = [[False, []]]  # open nodes of the last word: [final, finished arcs]
        last = b""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            self._close(path, last, same)
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            last = word
        self._close(path, last, 0)
        return self._finish(path[0])

    def _close(self, path: list[list], word: bytes, keep: int) -> None:
        while len(path) > keep + 1:
            state = self._finish(path.pop())
            path[-1][1].append((word[len(path) - 1], state))


@dataclass
class Transducer:
    """``first[s]``..``first[s+1]`` are the arcs of state s, sorted by label; the start is the last state."""

    first: np.ndarray
    label: np.ndarray
    goal: np.ndarray
    weight: np.ndarray
    final: np.ndarray
    ids_from: np.ndarray
    ids: np.ndarray

    @classmethod
    def compile(cls, lexicon: dict[bytes, list[int]]) -> Transducer:
        words = sorted(lexicon)
        builder = _Builder()
        builder.build(words)
        below = np.zeros(len(builder.states), dtype=np.int64)  # words accepted from a state; children come first
        first, label, goal, weight = [0], [], [], []
        for state, (final, arcs) in enumerate(builder.states):
            n = int(final)
            for byte, to in arcs:
                label.append(byte)
                goal.append(to)
                weight.append(n)
                n += int(below[to])
            below[state] = n
            first.append(len(label))
        lists = [lexicon[w] for w in words]
        ids_from = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]) if lists else np.zeros(1)
        return cls(
            np.array(first, np.int32), np.array(label, np.uint8), np.array(goal, np.int32), np.array(weight, np.int32),
            np.array([f for f, _ in builder.states], np.bool_), ids_from.astype(np.int32),
            np.array([i for x in lists for i in x], np.int32),
        )

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word among the compiled words, -1 for words that aren't compiled.

        All words step through the automaton together, one byte each per pass.
        """
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or len(self.final) == 0:
            return out
        lengths = np.fromiter((len(w) for w in words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state = np.full(n, len(self.final) - 1, np.int64)
        place = np.zeros(n, np.int64)
        live = np.arange(n)
        keys = self._keys()
        for depth in range(int(lengths.max()) + 1):
            ended = lengths[live] == depth
            done = live[ended]
            out[done] = np.where(self.final[state[done]], place[done], -1)
            live = live[~ended]
            if not len(live):
                break
            wanted = state[live] * 256 + flat[starts[live] + depth]
            at = np.searchsorted(keys, wanted)
            hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted) if len(keys) else np.zeros(len(live), bool)
            live, at = live[hit], at[hit]
            place[live] += self.weight[at]
            state[live] = self.goal[at]
        return out

    def _keys(self) -> np.ndarray:
        """(state, label) of every arc as one sorted number."""
        if not hasattr(self, "_arc_keys"):
            owner = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first))
            self._arc_keys = owner * 256 + self.label
        return self._arc_keys

    def ids_of(self, place: int) -> list[int]:
        return self.ids[self.ids_from[place] : self.ids_from[place + 1]].tolist()

    def save(self, folder: str, prefix: str = "") -> None:
        os.makedirs(folder, exist_ok=True)
        for name in _ARRAYS:
            np.save(os.path.join(folder, f"{prefix}{name}.npy"), getattr(self, name))

    @classmethod
    def load(cls, folder: str, prefix: str = "") -> Transducer:
        """Memory-mapped: workers of a machine share the pages."""
        return cls(*(np.load(os.path.join(folder, f"{prefix}{name}.npy"), mmap_mode="r") for name in _ARRAYS))
