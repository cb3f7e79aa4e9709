"""Chains of wrong decoding: making them, inverting them, and a classifier that tells them apart.

A chain is a list of steps (true, shown): the text's bytes in encoding ``true`` were decoded as ``shown``. The classifier
is multinomial over hashed bigrams of UTF-8 bytes, one class per chain and one for intact text, trained on intact texts
and on synthetically garbled copies of them. Its log odds against intact text add up over the bytes, so the passage that
a chain explains best is the run of bytes with the largest sum.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BINS = 1 << 16
#: Share of each class's mass that is spread over all bins; makes a bigram that no class has seen neutral.
SMOOTHING = 0.02
#: Most that one bigram can say.
CLIP = 5.0
#: Log odds from which a passage can count as garbled; more where both encodings take any byte, so that decoding proves nothing.
FOUND, FOUND_BYTES = 10.0, 15.0
#: Log odds from which a passage that can't be inverted counts as garbled; where lost bytes show it suffices that the class counts.
UNRESTORED = 60.0
#: Log odds from which a training text is left out unverified.
SUSPECT = 30.0
#: Classes below this share of the best class's log odds aren't looked at.
RIVAL = 0.4
#: How much more likely, in the mean over bigrams, the restored passage must be as intact text.
GAIN = 1.0
#: Bigrams of training text that a class must have.
LEAST_BIGRAMS = 10
#: How much more usual, in the mean log count of its bigrams, a garbled word may be than the word itself; beyond, the word was the garbled one.
USUAL = 1.0
#: Numbers held at once while all classes are scored on a text.
BLOCK = 4_000_000
#: Numbers held at once while bounds are computed: few enough to stay in a core's cache.
CACHED = 100_000
#: Chunks whose scores a worker keeps; a chunk takes 16 bytes for each class.
MEMO_CHUNKS = 4096

# Byte encodings that leave single bytes undefined; those bytes are shown as the code point of the same number.
_LOOSE = {"cp1252", "cp1251", "cp1250"}

# Fixed values: (true, shown) steps of every chain.
CHAINS: list[tuple[tuple[str, str], ...]] = [
    (("utf-8", "cp1252"),),
    (("utf-8", "latin-1"),),
    (("utf-8", "cp1251"),),
    (("utf-8", "cp1250"),),
    (("utf-8", "koi8-r"),),
    (("utf-8", "cp437"),),
    (("utf-8", "cp850"),),
    (("utf-8", "cp866"),),
    (("utf-8", "mac-roman"),),
    (("utf-8", "iso8859-5"),),
    (("utf-8", "gbk"),),
    (("utf-8", "big5"),),
    (("utf-8", "shift_jis"),),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    (("utf-8", "latin-1"), ("utf-8", "cp1252")),
    (("utf-8", "cp1251"), ("utf-8", "cp1251")),
    (("cp1251", "cp1252"),),
    (("cp1251", "latin-1"),),
    (("cp1251", "koi8-r"),),
    (("cp1251", "cp866"),),
    (("cp1251", "mac-roman"),),
    (("koi8-r", "cp1251"),),
    (("koi8-r", "cp1252"),),
    (("koi8-r", "cp866"),),
    (("cp866", "cp1251"),),
    (("cp866", "cp1252"),),
    (("cp866", "koi8-r"),),
    (("iso8859-5", "cp1251"),),
    (("cp1252", "mac-roman"),),
    (("cp1252", "latin-1"),),
    (("cp1252", "cp437"),),
    (("cp1252", "cp850"),),
    (("cp1252", "cp1251"),),
    (("cp1252", "koi8-r"),),
    (("cp1252", "cp866"),),
    (("cp1252", "gbk"),),
    (("mac-roman", "cp1252"),),
    (("cp437", "cp1252"),),
    (("cp850", "cp1252"),),
    (("gbk", "cp1252"),),
    (("gbk", "latin-1"),),
    (("gbk", "cp1251"),),
    (("gbk", "big5"),),
    (("gbk", "shift_jis"),),
    (("big5", "gbk"),),
    (("big5", "cp1252"),),
    (("cp1252", "utf-8"),),
    (("cp1251", "utf-8"),),
    (("gbk", "utf-8"),),
]
CLEAN = "intact"


_RUN = re.compile(r"[^\x00-\x7f]+")
_DIGIT = re.compile(r"[0-9]")
_NEAR = {i: "a" if chr(i).isalpha() else "0" if chr(i).isdigit() else " " for i in range(128) if chr(i).isalnum() or chr(i).isspace()} | {0xA0: "  "}
_CHUNK = re.compile(r"(?=([\x00-\x7f][^\x00-\x7f]+(?:[\x00-\x7f]|$)))")
_LOST = re.compile("\ufffd")
_WORD = re.compile(r"[^\W\d_]+")
#: Encodings in which each byte is a letter of its own.
_LETTERWISE = {"cp1252", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-roman", "cp437", "cp850"}
#: Letters beyond ASCII, and controls that no text has.
_LETTER = re.compile("[^\\W\\d_\x00-\x7f]|[\x80-\x9f]")
#: Characters outside the blocks of Latin and Cyrillic letters, Han characters and their punctuation.
_ODD = re.compile("[^\u0000-\u024f\u0300-\u036f\u0400-\u052f\u1e00-\u1eff\u2000-\u22ff\u2500-\u257f\u3000-\u30ff\u4e00-\u9fff\uff00-\uffef\U0001f000-\U0001ffff]")
#: Letters of two alphabets side by side, or a small accented letter among capitals.
_MIXED = re.compile("[A-Z]{2}[\u00df-\u00f6\u00f8-\u00ff]|[\u00df-\u00f6\u00f8-\u00ff][A-Z]|[A-Za-z\u00c0-\u024f][\u0400-\u052f]|[\u0400-\u052f][A-Za-z\u00c0-\u024f]")
#: Signs where correct text has them: an apostrophe behind a letter, quotes at the edges of words, dashes and dots between or behind words.
_IN_PLACE = re.compile("(?<=[^\\W\\d_])[\u2019\u02bc]|(?<!\\w)[\u2018\u201c\u201e\u00ab\u00bf\u00a1]|[\u2019\u201d\u201c\u00bb\u2026](?!\\w)|(?<!\\w)[\u2013\u2014\u2022](?!\\w)|(?<=[0-9])\u2013(?=[0-9])")
#: A sign inside a word that no word has there.
_SPLIT = re.compile("[^\\W\\d_][\u201c-\u2022\u2030\u20ac\u2122\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b6\u00bb-\u00bf\u02c6\u02dc\u2500-\u259f][^\\W\\d_]")


def chain_name(chain: tuple[tuple[str, str], ...]) -> str:
    return "; ".join(f"{true} as {shown}" for true, shown in chain)


def _tables(name: str) -> tuple[dict[int, int], list[str]]:
    """What each character is encoded to, a character that no byte stands for where there is none, and what each byte shows."""
    shown = []
    for byte in range(256):
        try:
            shown.append(bytes([byte]).decode(name))
        except UnicodeDecodeError:
            shown.append(chr(byte))
    return {**dict.fromkeys(range(256), 0xFFFF), **{ord(c): i for i, c in enumerate(shown)}}, shown


_LOOSE_TABLES = {name: _tables(name) for name in _LOOSE}


def encode(text: str, name: str) -> bytes:
    """Strict: raises UnicodeEncodeError."""
    if name in _LOOSE:
        return text.translate(_LOOSE_TABLES[name][0]).encode("latin-1")
    return codecs.encode(text, name)


def decode(raw: bytes, name: str, errors: str = "strict") -> str:
    if name in _LOOSE:
        table = _LOOSE_TABLES[name][1]
        return "".join([table[b] for b in raw])
    return raw.decode(name, errors)


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text as the chain shows it, None where an encoding lacks one of its characters. Lost bytes show as U+FFFD."""
    try:
        for true, shown in chain:
            text = decode(encode(text, true), shown, "replace")
    except UnicodeEncodeError:
        return None
    return text


def invert(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The original of a garbled text; None unless every step encodes and decodes strictly."""
    try:
        for true, shown in reversed(chain):
            text = decode(encode(text, shown), true)
    except UnicodeError:
        return None
    return text


# ASCII letters, digits and blanks count as one letter, one digit and one blank.
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[ord("a") : ord("z") + 1] = ord("a")
_FOLD[ord("A") : ord("Z") + 1] = ord("a")
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_FOLD[[9, 10, 11, 12, 13]] = ord(" ")


def bigrams(text: str) -> np.ndarray:
    """The bin of the bigram that ends at each byte; -1 where neither byte is beyond ASCII."""
    return _bigrams(text.encode("utf-8", "replace").replace(b"\xc2\xa0", b"  "))  # a wide blank is a blank


def _bigrams(encoded: bytes) -> np.ndarray:
    raw = np.frombuffer(b" " + encoded, np.uint8)
    a, b = _FOLD[raw[:-1]], _FOLD[raw[1:]]
    bins = (((a << 8) | b) * 40503) & (BINS - 1)
    bins[(raw[:-1] < 128) & (raw[1:] < 128)] = -1
    return bins


def best_run(values: np.ndarray) -> tuple[float, int, int]:
    """(sum, from, to) of the run with the largest sum."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    low = np.minimum.accumulate(total)
    gain = total - low
    end = int(np.argmax(gain))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return float(gain[end]), start, end


def _beyond(text: str) -> int:
    return sum(c > "\x7f" for c in text)


def _pieces(text: str) -> list[str]:
    return [" " + p + " " for p in _DIGIT.sub("0", text).split() if not p.isascii()]


def _chunks(text: str) -> list[str]:
    """The runs beyond ASCII with the character before and after, folded: bigrams beyond ASCII belong to one run each."""
    t = " " + text.translate(_NEAR)
    return _CHUNK.findall(t)


class _Counts:
    """Bins and their weights."""

    def __init__(self, bins: np.ndarray, weights: np.ndarray) -> None:
        sums = np.bincount(bins, weights, BINS)
        self.bins = np.flatnonzero(sums > 1e-6)
        self.weights = sums[self.bins]

    def minus(self, other: _Counts) -> _Counts:
        return _Counts(np.concatenate([self.bins, other.bins]), np.concatenate([self.weights, -other.weights]))

    def log_shares(self, columns: np.ndarray, n: int) -> np.ndarray:
        """By column; ``columns`` gives a bin's column, column 0 is for bins that nobody has seen."""
        out = np.zeros(n)
        out[columns[self.bins]] = self.weights
        return np.log((1 - SMOOTHING) * out / max(self.weights.sum(), 1) + SMOOTHING / BINS)


def _garbled_counts(weighed: dict[str, tuple[list[str], np.ndarray]], usual: np.ndarray) -> dict[tuple[int, str], _Counts]:
    """By (chain, language): the bigrams of the pieces, with their weights, as the chain shows those that it changes.

    ``usual``: by bin, the log count in all training texts. A garbled text among them gives words that the opposite chain
    shows as usual ones; these would make a class of correct text, so they are left out.
    """
    out = {}
    for lang, (pieces, weights) in weighed.items():
        own = _usualness(pieces, usual)
        for k, chain in enumerate(CHAINS):
            bad = garble_all(pieces, chain)
            some = np.array([i for i, (p, q) in enumerate(zip(pieces, bad)) if q is not None and p != q], np.int64)
            some = some[_usualness([bad[i] for i in some], usual) <= own[some] + USUAL]
            if len(some):
                out[k, lang] = _weighed([bad[i] for i in some], weights[some])
    return out


def _usualness(pieces: list[str], usual: np.ndarray) -> np.ndarray:
    """By piece: the mean log count of its bigrams beyond ASCII."""
    if not pieces:
        return np.zeros(0)
    encoded = [p.encode("utf-8", "replace").replace(b"\xc2\xa0", b"  ") for p in pieces]
    bins = _bigrams(b"\n".join(encoded) + b"\n")
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in encoded])[:-1]])
    n = np.add.reduceat((bins >= 0).astype(np.int64), starts)
    return np.add.reduceat(np.where(bins >= 0, usual[bins], 0.0), starts) / np.maximum(n, 1)


def _weighed(pieces: list[str], weights: np.ndarray) -> _Counts:
    """The bigrams beyond ASCII of all pieces, each with the weight of its piece."""
    encoded = [p.encode("utf-8", "replace").replace(b"\xc2\xa0", b"  ") for p in pieces]
    bins = _bigrams(b"\n".join(encoded))
    of = np.repeat(weights, [len(x) + 1 for x in encoded])[: len(bins)]
    return _Counts(bins[bins >= 0], of[bins >= 0])


def _blocks(rows: np.ndarray, raw: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The rows in blocks of about ``size`` bytes."""
    if len(rows):
        ends = np.cumsum([len(raw[i]) + 1 for i in rows])
        yield from np.split(rows, np.flatnonzero(np.diff(ends // max(1, size))) + 1)


def garble_all(pieces: list[str], chain: tuple[tuple[str, str], ...]) -> list[str | None]:
    """``garble`` of each piece, of all that can be encoded at once."""
    bad: list[str | None] = [None] * len(pieces)
    alphabet = {c for p in pieces for c in p}
    missing = {c for c in alphabet if not c.isascii() and garble(c, chain[:1]) is None}
    some = [i for i, p in enumerate(pieces) if not missing or missing.isdisjoint(p)]
    together = garble("\n".join(pieces[i] for i in some), chain) if some else None
    parts = together.split("\n") if together is not None else []
    if len(parts) != len(some):  # a later step lacks a character of a piece, or a decoder has taken a line end
        parts = [garble(pieces[i], chain) for i in some]
    for i, part in zip(some, parts):
        bad[i] = part
    return bad


@dataclass
class Classifier:
    """``odds[c, k]``: log odds of class k against intact text in column c; a class is a chain over texts of one language.

    ``columns``: the column of each bin, 0 for bins that training has not seen. ``intact[c, l]``: log shares of intact text
    of language l. ``limits[k]``: the log odds from which class k counts.
    """

    columns: np.ndarray
    odds: np.ndarray
    classes: list[tuple[tuple[tuple[str, str], ...], str]]
    intact: np.ndarray
    limits: np.ndarray

    def __getstate__(self) -> dict:
        """Without what is kept of chunks met: workers fill their own."""
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_") and k not in ("weighed", "garbled", "usual")}

    @classmethod
    def train(cls, texts: list[tuple[str, str]]) -> Classifier:
        """``texts``: (text, language) of texts taken for intact.

        Garbled ones among them are found by a first round and left out of the second. Limits are fixed: the same for every
        corpus, and at every size of it.
        """
        first = cls._fit(texts)
        mask = first.may_hold([t for t, _ in texts])
        kept = [x for x, maybe in zip(texts, mask) if not (maybe and first.suspects(x[0]))]
        return cls._fit(kept, first) if len(kept) < len(texts) else first

    def suspects(self, text: str) -> bool:
        """Whether a training text is left out: verified, or so likely garbled that intact texts may only look alike for being garbled too."""
        best = self._likely(text)[1]
        return bool(len(best)) and (best.max() >= SUSPECT or self.find(text, True) is not None)

    @classmethod
    def _fit(cls, texts: list[tuple[str, str]], first: Classifier | None = None) -> Classifier:
        """``first``: a model of these texts and others; what it counted in words that only the others have is taken back."""
        met: dict[str, Counter] = {}
        for text, lang in texts:
            met.setdefault(lang, Counter()).update(_pieces(text))
        # a word that is met n times counts 1 + ln n times, so that no sentence speaks louder for being repeated
        weighed = {lang: (list(words), 1 + np.log(np.fromiter(words.values(), float, len(words)))) for lang, words in met.items()}
        intact = {lang: _weighed(*x) for lang, x in weighed.items()}
        if first is None:
            usual = np.zeros(BINS)
            for c in intact.values():
                usual[c.bins] += c.weights
            usual = np.log1p(usual)
            garbled = _garbled_counts(weighed, usual)
        else:
            others = {lang: [i for i, p in enumerate(pieces) if p not in met.get(lang, ())] for lang, (pieces, _) in first.weighed.items()}
            usual = first.usual
            less = _garbled_counts({lang: ([first.weighed[lang][0][i] for i in at], first.weighed[lang][1][at]) for lang, at in others.items() if at}, usual)
            garbled = {x: c.minus(less[x]) if x in less else c for x, c in first.garbled.items()}
        kept = [x for x in sorted(garbled) if garbled[x].weights.sum() >= LEAST_BIGRAMS]
        seen = np.unique(np.concatenate([np.zeros(0, np.int64), *[c.bins for c in intact.values()], *[garbled[x].bins for x in kept]]))
        columns = np.zeros(BINS, np.int32)
        columns[seen] = np.arange(1, len(seen) + 1)
        n = len(seen) + 1
        empty = np.full((n, 1), np.log(SMOOTHING / BINS))
        logs = np.stack([c.log_shares(columns, n) for c in intact.values()], axis=1) if intact else empty
        odds = np.zeros((n, len(kept)), np.float32)
        base = logs.max(axis=1)
        for j, x in enumerate(kept):
            odds[:, j] = np.clip(garbled[x].log_shares(columns, n) - base, -CLIP, CLIP)
        odds[0] = 0
        limits = np.array([FOUND if CHAINS[k][0][0] == "utf-8" else FOUND_BYTES for k, _ in kept])
        model = cls(columns, odds, [(CHAINS[k], lang) for k, lang in kept], logs.astype(np.float32), limits)
        model.weighed, model.garbled, model.usual = weighed, garbled, usual
        model.words = frozenset(p for pieces, _ in weighed.values() for x in pieces for p in _WORD.findall(x.lower()))
        return model

    def may_hold(self, texts: list[str]) -> np.ndarray:
        """Which of the texts can hold a passage that reaches a limit: upper bounds for all classes, over all texts at once.

        No run of a class can sum up to more than the same run does if at each byte the class that says most speaks. First the
        classes with the same limit are bounded together; a run that reaches the limit lies in a stretch in which that bound
        is positive throughout and somewhere reaches it. In these stretches the classes of each chain are bounded together.
        """
        out = np.zeros(len(texts), bool)
        if not len(self.classes) or not texts:
            return out
        if not hasattr(self, "_bounds"):
            self._bounds = []
            for limit in np.unique(self.limits):
                here = np.flatnonzero(self.limits == limit)
                chains = list(dict.fromkeys(self.classes[k][0] for k in here))
                of = np.array([chains.index(self.classes[k][0]) for k in here])
                by_chain = np.stack([self.odds[:, here[of == i]].max(axis=1) for i in range(len(chains))], axis=1)
                self._bounds.append((limit - 0.01, by_chain.max(axis=1).astype(np.float64), by_chain))
        raw = [t.encode("utf-8", "replace").replace(b"\xc2\xa0", b"  ") for t in texts]
        for block in _blocks(np.arange(len(raw)), raw, CACHED):
            bins = _bigrams(b"\n".join([raw[i] for i in block]))
            at = np.flatnonzero(bins >= 0)
            starts = np.concatenate([[0], np.cumsum([len(raw[i]) + 1 for i in block])[:-1]])
            begins = np.searchsorted(at, starts)
            columns = self.columns[bins[at]]
            starts_text = np.zeros(len(at) + 1, bool)
            starts_text[begins] = True
            starts_text = starts_text[:-1]
            for limit, bound, by_chain in self._bounds:
                # a step down that nothing makes up for stands before each text, so that no run goes across two
                total = np.cumsum(np.insert(bound[columns], begins, -1e6))
                gain = np.delete(total - np.minimum.accumulate(total), begins + np.arange(len(begins)))
                up = gain > 0
                first = np.flatnonzero(up & ~np.concatenate([[False], up[:-1]]) | up & starts_text)
                if not len(first):
                    continue
                last = np.append(first[1:], len(up))
                high = np.maximum.reduceat(gain, first) >= limit
                for a, b in zip(first[high], last[high]):
                    text = block[np.searchsorted(begins, a, "right") - 1]
                    if out[text]:
                        continue
                    total = np.cumsum(by_chain[columns[a:b][up[a:b]]], axis=0)
                    low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros((1, total.shape[1]), total.dtype), total[:-1]]), axis=0), 0)
                    out[text] = (total - low).max() >= limit
        return out

    def _columns(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The bytes at which bigrams beyond ASCII end, and their columns."""
        bins = bigrams(text)
        at = np.flatnonzero(bins >= 0)
        return at, self.columns[bins[at]]

    def _best(self, columns: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
        """The sum of each class's best run over the columns; long ones take the classes in blocks, to bound the memory."""
        n = len(self.classes) if classes is None else len(classes)
        step = max(1, min(n, BLOCK // max(1, len(columns))))
        out = np.zeros(n, np.float32)
        for first in range(0, n if len(columns) else 0, step):
            odds = self.odds[columns, first : first + step] if classes is None else self.odds[np.ix_(columns, classes[first : first + step])]
            total = np.cumsum(odds, axis=0)
            low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros((1, total.shape[1]), total.dtype), total[:-1]]), axis=0), 0)
            out[first : first + step] = (total - low).max(axis=0)
        return out

    def _rows(self, text: str) -> np.ndarray | None:
        """The rows of ``_parts`` for the text's chunks in order; None where there are more distinct ones than are kept."""
        chunks = _chunks(text)
        memo = self.__dict__.setdefault("_memo", {})
        if not hasattr(self, "_parts"):
            self._parts = np.zeros((4, MEMO_CHUNKS, len(self.classes)), np.float32)  # sum, best beginning, best end, best run
        distinct = dict.fromkeys(chunks)
        if len(distinct) > MEMO_CHUNKS:
            return None
        if len(memo) + sum(c not in memo for c in distinct) > MEMO_CHUNKS:
            memo.clear()
        for chunk in distinct:
            if chunk not in memo:
                row = memo[chunk] = len(memo)
                bins = bigrams(chunk)
                upto = np.cumsum(self.odds[self.columns[bins[bins >= 0]]], axis=0)
                before = np.vstack([np.zeros((1, upto.shape[1]), np.float32), upto[:-1]])
                self._parts[0, row] = upto[-1]
                self._parts[1, row] = np.maximum(upto.max(axis=0), 0)
                self._parts[2, row] = np.maximum(upto[-1] - before.min(axis=0), 0)
                self._parts[3, row] = np.maximum((upto - np.minimum.accumulate(before, axis=0)).max(axis=0), 0)
        return np.array([memo[c] for c in chunks], np.int64)

    def _likely(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The classes whose best run reaches their limits, and those runs' sums.

        First a bound, what the best runs inside single chunks add up to; then, for the classes it leaves, the best run over
        all chunks from their sums, beginnings and ends. Chunks met before aren't scored again.
        """
        rows = self._rows(text)
        if rows is None:
            best = self._best(self._columns(text)[1])
            likely = np.flatnonzero(best >= self.limits - 0.01)
            return likely, best[likely]
        if not len(rows):
            return rows, np.zeros(0, np.float32)
        distinct, n = np.unique(rows, return_counts=True)
        likely = np.flatnonzero(n.astype(np.float32) @ self._parts[3, distinct] >= self.limits - 0.01)
        total, begin, end, run = (self._parts[i][np.ix_(rows, likely)] for i in range(4))
        upto = np.cumsum(total, axis=0)
        best = run.max(axis=0)
        if len(rows) > 1:
            started = np.maximum.accumulate(end - upto, axis=0)
            best = np.maximum(best, (begin[1:] + upto[:-1] + started[:-1]).max(axis=0))
        kept = best >= self.limits[likely] - 0.01
        return likely[kept], best[kept]

    def passages(self, text: str) -> list[tuple[float, int, int, int]]:
        """(log odds, class, first byte, byte after the last) of the best passages of the likeliest classes above their limits, best first."""
        if not len(self.classes):
            return []
        likely, best = self._likely(text)
        if not len(likely):
            return []
        at, columns = self._columns(text)
        out = []
        for k in likely[best >= RIVAL * best.max()]:
            score, start, end = best_run(self.odds[columns, k])
            if score >= self.limits[k]:
                out.append((score, int(k), int(at[start]), int(at[end - 1]) + 1))
        return sorted(out, reverse=True)

    def find(self, text: str | None, may: bool = False) -> tuple[str, str | None, float] | None:
        """``may``: whether ``may_hold`` is known to be true of the text. (chains, restored text or None, log odds of the strongest passage) of a garbled text, None for an intact one.

        A passage that is found divides the text; what stands before and behind it is searched on its own, and what it was
        restored to as well where that is shorter, so that every passage is restored. Lost bytes in one leave no original.
        """
        if not text or text.isascii():
            return None
        chains, scores, whole, lost = {}, [], [], False
        todo = [(text, True)]
        while todo:
            part, open_ = todo.pop()
            hit = self._passage(part) if open_ and not part.isascii() and (may or self.may_hold([part])[0]) else None
            may = False
            if hit is None:
                whole.append(part)
                continue
            first, last, chain, restored, score = hit
            chains[chain] = None
            scores.append(score)
            lost = lost or restored is None
            raw = part.encode("utf-8", "replace")
            middle = raw[first:last].decode("utf-8", "ignore")
            todo.append((raw[last:].decode("utf-8", "ignore"), True))
            todo.append((middle, False) if restored is None else (restored, len(restored) < len(middle)))
            todo.append((raw[:first].decode("utf-8", "ignore"), True))
        if not chains:
            return None
        return " | ".join(chains), None if lost else "".join(whole), max(scores)

    def _passage(self, text: str) -> tuple[int, int, str, str | None, float] | None:
        """(first byte, byte after the last, chain, restored or None, log odds) of one garbled passage."""
        raw = rest = text.encode("utf-8", "replace")
        tried = set()
        while found := self.passages(rest.decode("utf-8", "ignore")):
            for score, k, start, end in found:
                chain = self.classes[k][0]
                if (chain, start, end) in tried or score < RIVAL * found[0][0]:
                    continue
                tried.add((chain, start, end))
                for first, last in _borders(raw, start, end):
                    before, after = (x.decode("utf-8", "ignore") for x in (raw[max(0, first - 8) : first], raw[last : last + 8]))
                    restored = self._restore(raw[first:last].decode("utf-8"), chain, before, after)
                    if restored is not None:
                        return first, last, chain_name(chain), restored, score
            score, k, start, end = max(found, key=lambda f: f[0] / self.limits[f[1]])
            start, end = _whole_characters(rest, start, end)
            if score >= UNRESTORED or b"\xef\xbf\xbd" in raw[start:end]:
                return start, end, chain_name(self.classes[k][0]), None, score
            # the strongest passage is correct text: the rest may hold a weaker one that isn't
            start, end = _whole_characters(rest, *found[0][2:])
            rest = rest[:start] + b" " * (end - start) + rest[end:]
        return None

    def _restore(self, passage: str, chain: tuple[tuple[str, str], ...], before: str, after: str) -> str | None:
        """The original of a passage, verified: strict decoding, the way back, and that it reads better; else run by run."""
        if chain[-1][1] == "utf-8" and _LOST.search(passage):
            return None
        restored = invert(passage, chain)
        if restored is None and not _LOST.search(passage):
            restored = _RUN.sub(lambda m: invert(m.group(), chain) or m.group(), passage)
            if _beyond(restored) > 0.8 * _beyond(passage):  # nearly nothing could be inverted
                return None
        elif restored is None or garble(restored, chain) != passage:
            return None
        return restored if restored != passage and self._better(before + passage + after, before + restored + after) and (chain[0][0] not in _LETTERWISE or self._known(restored)) else None

    def _known(self, restored: str) -> bool:
        """Whether a word of the restored passage is one of the training texts: where any byte is a letter, rare correct characters give letters too, but no words."""
        words = _WORD.findall(restored.lower())
        return not self.words.isdisjoint([w for w in words if not w.isascii()] or words)

    def _better(self, passage: str, restored: str) -> bool:
        """Whether the restored passage reads as intact text of one language, and better than the passage does."""

        def mean(text: str) -> float:
            columns = self._columns(" " + text + " ")[1]
            return float(self.intact[columns].mean(axis=0).max()) if len(columns) else 0.0

        if not (_LETTER.search(passage) or _LETTER.search(restored)):  # signs between words are correct unless they hide letters
            return False
        if restored.count("\ufffd") > passage.count("\ufffd") or any(len(p.findall(restored)) > len(p.findall(passage)) for p in (_MIXED, _SPLIT)):
            return False
        if _IN_PLACE.sub("", passage).isascii() and not self.words.issuperset(w for w in _WORD.findall(restored.lower()) if not w.isascii()):
            return False  # signs that stand where signs belong hide letters only if these make known words
        return mean(restored) > mean(passage) + GAIN


def _whole_characters(raw: bytes, start: int, end: int) -> tuple[int, int]:
    while start > 0 and raw[start] & 0xC0 == 0x80:
        start -= 1
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end += 1
    return start, end


def _borders(raw: bytes, start: int, end: int):
    """Slices of whole characters around a passage: its whole words, then as found, then grown and shrunk a little."""
    first, last = start, end
    while first > 0 and raw[first - 1] > 0x20:
        first -= 1
    while last < len(raw) and raw[last] > 0x20:
        last += 1
    yield first, last
    near = [i for i in range(max(0, start - 16), min(len(raw), end + 16)) if raw[i] & 0xC0 != 0x80]
    if end + 16 >= len(raw):
        near.append(len(raw))
    lo = max((i for i, x in enumerate(near) if x <= start), default=0)
    hi = next((i for i, x in enumerate(near) if x >= end), len(near) - 1)
    for d in range(4):
        for a in {lo - d, lo + d}:
            for b in {hi + d, hi - d}:
                if 0 <= a < b < len(near):
                    yield near[a], near[b]


def surely_intact(text: str) -> bool:
    """A seed for training: no word that a chain over UTF-8 explains, no lost character, no C1 control."""
    if any(c == "\ufffd" or "\x80" <= c <= "\x9f" for c in text):
        return False
    for piece in text.split():
        if not piece.isascii():
            for chain in CHAINS[:13]:
                got = invert(piece, chain)
                if got is not None and not _ODD.search(got) and _beyond(got) <= 0.67 * _beyond(piece):
                    return False
    return True
