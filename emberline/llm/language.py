"""The language of a text by naive Bayes over character n-grams, and how a text ends by n-gram likelihood."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import islice

import numpy as np

from emberline.llm.answers import END_MARKS, End, read_end

BINS = 1 << 16
#: Texts from which a language has a model.
LEAST_TEXTS = 5
#: Lines or pieces of lines of which a worker keeps what it found.
MEMO_LINES = 200_000
#: Characters of a block of texts that are scored at once, and of one whose ends are counted at once.
BLOCK_CHARS, END_BLOCK_CHARS = 30_000, 100_000
#: Occurrences from which a suffix speaks on the end of a text.
LEAST_MET = 3
#: Between two texts, so that no suffix of a tail reaches over it: a code point that stands for no character.
_BETWEEN = "\n\uffff\n"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_DIGITS = re.compile(r"\d+")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


@cache
def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    out = np.zeros(0x110000, bool)
    for run in re.finditer(r"[^\W\d_]+", "".join(map(chr, range(0x110000)))):
        out[run.start() : run.end()] = True
    return out


def normal(text: str) -> str:
    """The letters of a text, words apart."""
    return " " + _NOT_LETTERS.sub(" ", text.lower()) + " "


def normal_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the normal texts one behind the other, and where each begins."""
    low = [" " + x.lower() + " " for x in texts]
    p = code_points("".join(low))
    sizes = np.array([len(x) for x in low], np.int64)
    last = np.cumsum(sizes) - 1
    edge = np.zeros(len(p), bool)
    edge[last] = edge[last - sizes + 1] = True
    between = ~_letters()[p]
    kept = ~between | edge
    kept[1:] |= ~(between & ~edge)[:-1]  # the first sign of a run stands for it
    begins = np.cumsum(kept)[last - sizes + 1] - 1
    return np.where(between, np.uint32(32), p)[kept], begins


def point_grams(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the n-grams, n = 1, 2, 3, that begin at each place. Products wrap around; the high bits are the bin."""
    one = p * np.uint32(2654435761)
    two = p[:-1] * np.uint32(2246822519) + p[1:] * np.uint32(3266489917)
    three = two[:-1] * np.uint32(668265263) + p[2:] * np.uint32(374761393)
    return one >> np.uint32(16), two >> np.uint32(16), three >> np.uint32(16)


def grams(t: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a normal text."""
    return point_grams(code_points(t))


def words_of(line: str) -> str:
    """The letters of a line, words apart; a blank at either end stands for signs there."""
    return _NOT_LETTERS.sub(" ", line.lower())


def pieces(words: list[str]) -> list[str]:
    """The normal text of lines, given their ``words_of``, in pieces, each but the last with the two characters that follow it.

    So every n-gram begins in one piece and lies in it; pieces recur where lines do. Only the last one ends with a blank.
    """
    out = [" " + x for w in words if (x := w.strip(" "))]
    if not out:
        return ["   " if any(words) else "  "]
    if words[0][:1] == " ":
        out[0] = " " + out[0]
    return [x + y[:2] for x, y in zip(out, [*out[1:], "  " if words[-1][-1:] == " " else " "])]


@dataclass
class LanguageModel:
    """``logs[b, l]``: log probability of bin b in language l."""

    languages: list[str]
    logs: np.ndarray

    @classmethod
    def of_counts(cls, languages: list[str], counts: list[np.ndarray]) -> LanguageModel:
        """From the counts of the bins in each language."""
        logs = [np.log((c + 0.05) / (c.sum() + 0.05 * BINS)) for c in counts]
        return cls(languages, np.stack(logs, axis=1).astype(np.float32) if logs else np.zeros((BINS, 0), np.float32))

    @classmethod
    def fit(cls, texts: list[tuple[str, str]], least: int = LEAST_TEXTS) -> LanguageModel:
        """``texts``: (text, language). Languages with fewer than ``least`` texts are left out."""
        n = Counter(lang for _, lang in texts)
        languages = sorted(lang for lang in n if n[lang] >= least)
        counts = {lang: np.zeros(BINS) for lang in languages}
        for text, lang in texts:
            if lang in counts:
                for bins in grams(normal(text)):
                    counts[lang] += np.bincount(bins, minlength=BINS)
        return cls.of_counts(languages, list(counts.values()))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log likelihood of each text in each language: equal priors, so differences are log posterior odds.

        Texts are scored in blocks, all n-grams of a block at once; those across two texts don't count.
        """
        out = np.zeros((len(texts), len(self.languages)))
        first = 0
        while first < len(texts):
            block, size = [], 0
            while first + len(block) < len(texts) and (not block or size < BLOCK_CHARS):
                block.append(texts[first + len(block)])
                size += len(block[-1])
            points, starts = normal_points(block)
            total = np.zeros((len(points), len(self.languages)), np.float32)
            for n, bins in enumerate(point_grams(points)):
                rows = np.take(self.logs, bins, axis=0)
                for back in range(1, n + 1):
                    rows[starts[1:] - back] = 0
                total[: len(rows)] += rows
            out[first : first + len(block)] = np.add.reduceat(total, starts, axis=0, dtype=np.float64)
            first += len(block)
        return out

    def piece_scores(self, texts: list[list[str]]) -> np.ndarray:
        """The same of texts in pieces; pieces met before aren't scored again."""
        if len(self.__dict__.setdefault("_memo", {})) > MEMO_LINES or not self._memo:
            self._memo, self._rows = {}, np.zeros((0, len(self.languages)))
        if not texts:
            return np.zeros((0, len(self.languages)))
        new = [x for x in dict.fromkeys(x for t in texts for x in t) if x not in self._memo]
        for last in (False, True):
            of = [x for x in new if (x[-1] == " ") == last]
            self._memo.update(zip(of, range(len(self._memo), len(self._memo) + len(of))))
            self._rows = np.concatenate([self._rows, *(self._piece_rows(of[at : at + 500], last) for at in range(0, len(of), 500))])
        met = np.array([self._memo[x] for t in texts for x in t])
        return np.add.reduceat(self._rows[met], np.cumsum([0, *map(len, texts)])[:-1], axis=0)

    def _piece_rows(self, block: list[str], last: bool) -> np.ndarray:
        ends = np.cumsum([len(x) for x in block])
        t = "".join(block)
        total = np.zeros((len(t), len(self.languages)), np.float32)
        for n, bins in enumerate(grams(t)):
            rows = np.take(self.logs, bins, axis=0)
            for back in range(1, (n if last else 2) + 1):
                cut = ends - back
                rows[cut[cut < len(rows)]] = 0
            total[: len(rows)] += rows
        return np.add.reduceat(total, np.concatenate([[0], ends[:-1]]), axis=0, dtype=np.float64)

    def best(self, text: str) -> str | None:
        return self.languages[int(np.argmax(self.scores([text])[0]))] if self.languages else None


@dataclass
class EndModel:
    """Log odds that a text is complete after the n characters that stand last, backing off to shorter n.

    By suffix: how often it closes a sentence, a line or a text, and how often it goes on. The longest suffix that was met
    often enough speaks. ``keys``: the sorted hashes of the suffixes, ``odds`` in the same order.
    """

    keys: np.ndarray
    odds: np.ndarray

    LONGEST = 24
    #: Sizes of suffixes, and those of which each is put together: the a characters before the b last ones.
    PARTS = {2: (1, 1), 3: (1, 2), 4: (2, 2), 5: (1, 4), 7: (3, 4), 9: (4, 5), 12: (5, 7), 16: (7, 9), 24: (12, 12)}

    @staticmethod
    def _hashes(t: str) -> Iterator[tuple[int, np.ndarray]]:
        """(n, hash of the n characters that end at each place from n - 1 on), shorter ones first. Products wrap around."""
        p = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        p = (p + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out = {1: p ^ (p >> np.uint64(29))}
        yield 1, out[1]
        # arrays that no longer size needs are let go
        for n, done in ((2, ()), (3, ()), (4, (2,)), (5, (1,)), (7, (3,)), (9, (4,)), (12, (5,)), (16, (7, 9)), (24, (12,))):
            a, b = EndModel.PARTS[n]
            size = len(t) - n + 1
            if size <= 0:
                return
            out[n] = x = EndModel._joined(out[a][:size], out[b][len(out[b]) - size :])
            for k in done:
                del out[k]
            yield n, x

    @staticmethod
    def _joined(before: np.ndarray, last: np.ndarray) -> np.ndarray:
        x = before * np.uint64(0xBF58476D1CE4E5B9)
        x += last * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x

    @classmethod
    def _hash_at(cls, n: int, start: np.ndarray, whole: dict[int, np.ndarray]) -> np.ndarray:
        """Hashes of the n characters from each start on, given those of short suffixes at every place."""
        if n in whole:
            return whole[n][start]
        a, b = cls.PARTS[n]
        return cls._joined(cls._hash_at(a, start, whole), cls._hash_at(b, start + a, whole))

    @staticmethod
    def _places(t: str) -> tuple[np.ndarray, np.ndarray]:
        """The places behind which a text goes on or ends, and whether it ends there; ``t`` ends with a line's end."""
        is_end = np.zeros(0x110000, bool)
        is_end[[ord(c) for c in END_MARKS + "\n"]] = True
        is_end = is_end[code_points(t)]
        at = np.flatnonzero(~is_end[:-1])
        return at, is_end[at + 1]

    @staticmethod
    def _odds(closing: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.log((closing + 0.1) / (size - closing + 0.1))

    @classmethod
    def of_counts(cls, keys: np.ndarray, closing: np.ndarray, size: np.ndarray, least: int = LEAST_MET) -> EndModel:
        """From the hashes of suffixes, how often each was met and how often it closed."""
        order = np.argsort(keys)
        order = order[size[order] >= least]
        return cls(keys[order], cls._odds(closing[order], size[order]).astype(np.float32))

    @classmethod
    def fit(cls, texts: list[str], least: int = LEAST_MET) -> EndModel:
        """On running texts and other texts whose lines are complete; an end is a mark, a line's end or the end of a text."""
        t = "\n" + "\n".join(_DIGITS.sub("9", x) for x in texts) + "\n"
        at, closes = cls._places(t)
        keys, odds = [np.zeros(0, np.uint64)], [np.zeros(0)]
        for n, h in cls._hashes(t):
            here = at >= n - 1
            # whether it closes goes into the lowest bit, so that one sort brings equal suffixes together
            met = np.sort(h[at[here] - (n - 1)] & ~np.uint64(1) | closes[here])
            suffix = met & ~np.uint64(1)
            first = np.flatnonzero(np.concatenate([[True], suffix[1:] != suffix[:-1]])) if len(met) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(met)))
            closing = np.add.reduceat((met & np.uint64(1)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            often = size >= least
            keys.append(suffix[first[often]])
            odds.append(cls._odds(closing[often], size[often]))
        keys, odds = np.concatenate(keys), np.concatenate(odds)
        order = np.argsort(keys)
        return cls(keys[order], odds[order].astype(np.float32))

    def complete(self, text: str) -> float:
        """Positive: a complete text; negative: one that stops inside a sentence."""
        return float(self.complete_all([text])[0])

    @classmethod
    def tail(cls, end: End) -> str:
        """What of an end without mark is looked up."""
        return _DIGITS.sub("9", end.core[-2 * cls.LONGEST - 40 :])[-cls.LONGEST :]

    def complete_all(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), 9.0)
        ends = [read_end(t) for t in texts]
        open_ = [i for i, end in enumerate(ends) if not end.mark]
        out[open_] = self.tail_odds([self.tail(ends[i]) for i in open_])
        return out

    def tail_odds(self, tails: list[str]) -> np.ndarray:
        out = np.full(len(tails), -1.0)
        for i, tail in enumerate(tails):
            wanted = np.array([h[-1] for _, h in self._hashes(tail) if len(h)][::-1], np.uint64) & ~np.uint64(1)
            if len(wanted) and len(self.keys):
                place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[place] == wanted)
                if len(hit):
                    out[i] = self.odds[place[hit[0]]]
        return out


class _Keys:
    """The places of sorted distinct hashes, found without a search: what shares its slot with others is in a further table."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.tables = keys, []
        self.shift = np.uint64(64 - max(12, len(keys).bit_length() + 1))
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            factor = np.array((0x9E3779B97F4A7C15 * (2 * len(self.tables) + 1)) % 2**64, np.uint64)
            slots = (keys[left] * factor) >> self.shift
            table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
            table[slots] = left
            self.tables.append((factor, table))
            left = left[table[slots] != left]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is none of the keys."""
        if not self.tables:
            return np.full(len(hashes), -1, np.int32)
        out, left = None, None
        for factor, table in self.tables:
            here = hashes if left is None else hashes[left]
            at = table[(here * factor) >> self.shift]
            miss = np.flatnonzero(self.keys[at] != here)  # a slot that is free here is free in all tables
            others = miss[at[miss] >= 0]
            at[miss] = -1
            if left is None:
                out, left = at, others
            else:
                out[left], left = at, left[others]
            if not len(left):
                break
        return out


class EndCounts:
    """How often the suffixes of given tails are met in texts, and how often they close them. The counts of parts add up.

    Only what will be looked up is counted, exactly, so a corpus of any size needs no more room than the tails.
    """

    def __init__(self, tails: list[str]) -> None:
        sizes = np.array([len(x) for x in tails], np.int64)
        last = np.cumsum(sizes) - 1
        self.keys = {n: _Keys(np.unique(h[last[sizes >= n] - (n - 1)] & ~np.uint64(1))) for n, h in EndModel._hashes("".join(tails))}
        self.size = {n: np.zeros(len(k.keys), np.int64) for n, k in self.keys.items()}
        self.closing = {n: np.zeros(len(k.keys), np.int64) for n, k in self.keys.items()}
        self.block, self.chars = [], 0

    def put(self, texts: list[str]) -> None:
        """Count the texts, as soon as a block of them is met."""
        self.block += texts
        self.chars += sum(map(len, texts))
        if self.chars >= END_BLOCK_CHARS:
            self._count()

    def _count(self) -> None:
        t = "\n" + _DIGITS.sub("9", _BETWEEN.join(self.block)) + "\n"
        self.block, self.chars = [], 0
        at, closes = EndModel._places(t)
        whole = dict(islice(EndModel._hashes(t), 5))
        for n, keys in self.keys.items():
            if at.size and at[0] < n - 1:
                here = at >= n - 1
                at, closes = at[here], closes[here]
            if not at.size:
                break
            place = keys.find(EndModel._hash_at(n, at - (n - 1), whole) & ~np.uint64(1))
            hit = np.flatnonzero(place >= 0)  # a suffix that no tail has is no part of a longer one that a tail has
            at, closes, place = at[hit], closes[hit], place[hit]
            np.add.at(self.size[n], place, 1)
            np.add.at(self.closing[n], place[closes], 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, closing, size) of the suffixes that were met."""
        self._count()
        parts = [(k.keys[met], self.closing[n][met], self.size[n][met]) for n, k in self.keys.items() for met in [self.size[n] > 0]]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
