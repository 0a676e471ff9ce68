"""The lite scorer and its parts over one Python string, for operators whose state changes word by word (Arrow batches)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import floor, sqrt

from . import fixed

WORDS, LITE, LETTERS = re.compile(r"[A-Za-z0-9']+"), re.compile(r"[A-Za-z']+"), re.compile(r"[A-Za-z]+")
DROP, KEEP = re.compile(r"[.!?]+(?:\s+|$)"), re.compile(r"(?<=[.!?])\s+")
COMMON = frozenset(fixed.COMMON_WORDS)


def clamp01(x: float) -> float:
    return 0.5 if x != x else min(1.0, max(0.0, x))


def blend(n: int, s1: int, s2: int, tokens: int, common: int) -> float:
    """The lite score from counts: sentences with words, their sum and sum of squares, tokens, common tokens."""
    ratio = common / tokens if tokens else 0.0
    burst = 0.5 if n < 2 else clamp01((0.55 - sqrt(n * s2 - s1 * s1) / s1) / 0.55)
    return clamp01(0.6 * burst + 0.4 * clamp01((ratio - 0.30) / 0.30))


def round4(x: float) -> float:
    return floor(x * 10000 + 0.5) / 10000


def sentences(text: str) -> list[str]:
    """Sentences with their punctuation, trimmed, without empty ones."""
    return [s for s in map(str.strip, KEEP.split(text.strip())) if s]


class Counts:
    """Sentence token counts of a text, kept so that the removal of a word is a matter of a few sentences."""

    def __init__(self, text: str):
        self.text = text
        self.blank = not text or not text.strip()
        ends = [m.end() for m in DROP.finditer(text)]
        self.size: Counter = Counter()
        self.tokens = self.common = at = 0
        for m in LITE.finditer(text):
            while at < len(ends) and ends[at] <= m.start():
                at += 1
            self.size[at] += 1
            self.tokens += 1
            self.common += m[0].lower() in COMMON
        self.ends = ends
        self.n, self.s1, self.s2 = len(self.size), self.tokens, sum(v * v for v in self.size.values())

    def score(self) -> float:
        return 0.5 if self.blank else blend(self.n, self.s1, self.s2, self.tokens, self.common)

    def words(self) -> dict[str, Counter | None]:
        """Letter runs in order of first sight -> how often each stands as a whole word in each sentence.

        A run that touches another word character is not a whole word and would stay. None where removal would change
        more than counts: at an apostrophe, or right behind a sentence's final mark."""
        out: dict[str, Counter | None] = {}
        text, at = self.text, 0
        for m in LETTERS.finditer(text):
            while at < len(self.ends) and self.ends[at] <= m.start():
                at += 1
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            places = out.setdefault(m[0], Counter())
            if (before and (before == "_" or before.isalnum())) or (after and (after == "_" or after.isalnum())):
                continue
            if before and before in "'.!?" or after == "'":
                out[m[0]] = None
            elif places is not None:
                places[at] += 1
        return out

    def without(self, word: str, places: Counter) -> float:
        """The score if the whole words went from these sentences and nothing else changed."""
        n, s1, s2, gone = self.n, self.s1, self.s2, 0
        for sentence, k in places.items():
            v = self.size[sentence]
            n -= v == k
            s1 -= k
            s2 -= v * v - (v - k) ** 2
            gone += k
        return blend(n, s1, s2, self.tokens - gone, self.common - gone * (word.lower() in COMMON))


def _table(kept: str) -> bytes:
    """For bytes.translate: the kept ASCII characters in lower case, a space for every other byte."""
    return bytes(ord(chr(i).lower()) if i < 128 and chr(i) in kept else 32 for i in range(256))


_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_AS_LITE, _AS_WORDS, _COMMON = _table(_LETTERS), _table(_LETTERS + "0123456789"), frozenset(w.encode() for w in COMMON)


def tokens(text: str, table: bytes = _AS_WORDS) -> list[bytes]:
    """The matches of WORDS (or LITE) in lower case. Their characters are ASCII, so bytes will do: far faster than a pattern."""
    return text.encode("utf-8", "surrogatepass").translate(table).split()


def lite_tokens(text: str) -> list[bytes]:
    return tokens(text, _AS_LITE)


def lite(text: str) -> float:
    """Counts(text).score() without the places that only removal needs."""
    if not text or not text.strip():
        return 0.5
    found = [tokens(s, _AS_LITE) for s in DROP.split(text)]
    sizes = [len(t) for t in found if t]
    n = sum(sizes)
    return blend(len(sizes), n, sum(k * k for k in sizes), n, sum(sum(map(_COMMON.__contains__, t)) for t in found))


def top_score(text: str) -> float:
    """A reading, rounded as readings are; blank texts read 0."""
    return round4(lite(text)) if text.strip() else 0.0


def dice(a: str, b: str, words_of_a: Counter | None = None) -> float:
    """words_of_a: Counter(tokens(a)), where one text is compared with several."""
    if not a.strip() or not b.strip():
        return 1.0 if not a.strip() and not b.strip() else 0.0
    if a == b:
        return 1.0
    ca, cb = Counter(tokens(a)) if words_of_a is None else words_of_a, Counter(tokens(b))
    if not ca and not cb:
        return 1.0
    return 2.0 * sum(min(n, cb[w]) for w, n in ca.items() if w in cb) / (ca.total() + cb.total()) if ca and cb else 0.0


def importance(text: str) -> list[tuple[str, float]]:
    """Unique words and the drop of the score without them, largest first, first seen first among equals.

    Where only counts change the score comes from them; otherwise the text without the word is scored."""
    counts, base = Counts(text), top_score(text)
    found = counts.words()
    lone = len(found) <= 1  # the rest may be blank
    drops = []
    for word, places in found.items():
        if places is None or lone:
            rest = top_score(re.sub(rf"\b{re.escape(word)}\b", "", text))
        else:
            rest = round4(counts.without(word, places))
        drops.append((word, base - rest))
    return sorted(drops, key=lambda x: -x[1])


@dataclass(frozen=True)
class Draft:
    """A text under revision: its reading, how many words were swapped, and the place of the word swapped last."""

    text: str
    reading: float
    swaps: int = 0
    place: int = -1


def swap_table(text: str, synonyms: Mapping[str, Sequence[str]], most: int = 6) -> list[tuple[int, str, str]]:
    """(place, word, synonym) of the words without which the reading falls, most telling first; at most six a word, without repeats."""
    telling = [word for word, drop in importance(text) if drop > 0]
    return [(place, word, s) for place, word in enumerate(telling) for s in list(dict.fromkeys(synonyms.get(word.lower(), ())))[:most]]


def revised(draft: Draft, entry: tuple[int, str, str], goal: float, most: int) -> Draft:
    """The draft with one entry of the swap table put in, if it may still change, its word is not swapped yet and the reading falls."""
    place, word, synonym = entry
    if place == draft.place or draft.swaps >= most or draft.reading < goal:
        return draft
    found = re.search(rf"\b{re.escape(word)}\b", draft.text)
    if found is None:
        return draft
    text = draft.text[: found.start()] + synonym + draft.text[found.end() :]
    reading = top_score(text)
    return Draft(text, reading, draft.swaps + 1, place) if reading < draft.reading else draft


def substituted(text: str, threshold: float = fixed.THRESHOLD, most: int = 8, synonyms: Mapping[str, Sequence[str]] = fixed.SYNONYMS) -> tuple[str, int]:
    """A scan of the swap table that keeps each swap under which the reading falls; the text and how many."""
    start = Draft(text, top_score(text))
    if start.reading < threshold or most < 1:
        return text, 0
    end = reduce(lambda draft, entry: revised(draft, entry, threshold, most), swap_table(text, synonyms), start)
    return end.text, end.swaps


_OPENERS = re.compile(rf"^({'|'.join(map(re.escape, fixed.DROPPED_OPENERS))}),?\s+", re.I)


def without_opener(sentence: str) -> str:
    rest = _OPENERS.sub("", sentence)
    return rest[:1].upper() + rest[1:] if rest[:1].islower() else rest


def paired(block: list[str]) -> list[str]:
    """The first two sentences of a block as one, then the others."""
    if len(block) < 2:
        return block
    first, second = (s.rstrip(".") for s in block[:2])
    return [f"{first}, and {second[:1].lower()}{second[1:]}.", *block[2:]]


_SWAPS = [(word.lower(), re.compile(rf"\b{re.escape(word)}\b", re.I), put) for word, put in fixed.SWAPS.items()]
#: Letters beyond ASCII that re.I takes for ASCII ones and str.lower does not.
_ALIKE = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def folded(text: str) -> str:
    """Lower case as re.I compares ASCII letters: a word that it finds in a text stands in the folded text."""
    return (text if text.isascii() else text.translate(_ALIKE) if any(chr(c) in text for c in _ALIKE) else text).lower()


def plan(strength: float) -> tuple[int, int, bool]:
    """What a strength comes down to: every how many sentences lose an opener, sentences a block (0: none), whether to swap."""
    return 1 if strength >= 0.5 else 2, max(2, 4 - round(2 * strength)) if strength > 0 else 0, strength >= 0.34


def scripted(text: str, strength: float) -> str:
    """The scripted rewrite: sentences lose their openers (all, or every other one under half strength), each block of two
    to four sentences begins with a pair that is joined, and from a third of the strength on phrases are swapped."""
    every, size, swaps = plan(strength)
    sentences = [s for s in KEEP.split(text.strip()) if s]
    sentences[::every] = map(without_opener, sentences[::every])
    if size:
        sentences = [s for at in range(0, len(sentences), size) for s in paired(sentences[at : at + size])]
    out = " ".join(sentences)
    seen = folded(out) if swaps else ""
    for word, pattern, put in _SWAPS if swaps else ():
        if word in seen:
            out = pattern.sub(put, out)
            seen = folded(out)
    return out
