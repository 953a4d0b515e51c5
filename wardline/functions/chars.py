"""The same normalization for Python code inside Arrow UDFs, where offsets into the text are needed."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from operator import add

import regex

from wardline import fixed

_LETTERS = {ch: letter for letter, group in fixed.FOLD.items() for ch in group}
_REPEATS = regex.compile(r"(.)\1+", regex.S)


@lru_cache(maxsize=65536)
def folded(ch: str) -> str | None:
    """The letter a character counts as, "" if it counts for nothing, None if it separates."""
    low = ch.lower()
    if low in fixed.IGNORED:
        return ""
    return _LETTERS.get(low) or (low if is_alnum(low[:1]) else None)


@lru_cache(maxsize=65536)
def is_alnum(ch: str) -> bool:
    kind = unicodedata.category(ch)
    return kind[0] == "L" or kind == "Nd"


def collapse(s: str) -> str:
    return _REPEATS.sub(r"\1", s)


class _Table(dict):
    def __missing__(self, code: int) -> str:
        self[code] = folded(chr(code)) or ""
        return self[code]


_TABLE = _Table()


def compact(s: str, collapsed: bool = True, normalized: bool = True) -> str:
    if normalized and not s.isascii():
        s = unicodedata.normalize("NFKC", s)
    out = s.translate(_TABLE)
    return collapse(out) if collapsed else out


def lexical(s: str) -> str:
    return "".join(ch.lower() for ch in s if ch.isalpha())


_LETTER = r"[\p{L}\p{Nd}@!|$×]"
_OBFUSCATED = regex.compile(rf"{_LETTER}[{regex.escape(fixed.LEET)}]|[{regex.escape(fixed.LEET)}]{_LETTER}|{_LETTER}.*[^\p{{L}}\p{{Nd}}@!|$×]{_LETTER}", regex.S)
_NOTHING = str.maketrans("", "", fixed.IGNORED + "ЪЬ")


def has_obfuscation(s: str) -> bool:
    return _OBFUSCATED.search(s.translate(_NOTHING)) is not None


def alnum_span(s: str, start: int, end: int) -> tuple[int, int]:
    """The span widened over the letters and digits on both sides."""
    while start and is_alnum(s[start - 1]):
        start -= 1
    while end < len(s) and is_alnum(s[end]):
        end += 1
    return start, end


def one_deletion(full: str, reduced: str) -> bool:
    """Whether ``reduced`` is ``full`` less one character."""
    return len(full) == len(reduced) + 1 and any(full[:i] + full[i + 1 :] == reduced for i in range(len(full)))


def is_subsequence(haystack: str, needle: str) -> bool:
    if len(needle) > len(haystack):
        return False
    at = -1
    for ch in needle:
        at = haystack.find(ch, at + 1)
        if at < 0:
            return False
    return True


@lru_cache(maxsize=512)
def bigrams(s: str) -> frozenset[str]:
    return frozenset(map(add, s, s[1:])) if len(s) > 1 else frozenset((s,))


def ad_similarity(a: str, b: str, least: float = 0.0) -> float:
    """Shared bigrams, more for texts that hold one another or are as long. Below ``least``, any value below it."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = bigrams(a), bigrams(b)
    short, long = sorted((len(a), len(b)))
    top = lambda j: max(j, j * 0.7 + 0.25 + short / long * 0.1)
    most = min(len(x), len(y)) / max(len(x), len(y))
    if top(most) < least:
        return 0.0
    both = len(x & y)
    j = both / (len(x) + len(y) - both)
    if top(j) < least:
        return 0.0
    boost = 0.0
    if short >= 6:
        boost = 0.25 if a in b or b in a else 0.15 if is_subsequence(a, b) or is_subsequence(b, a) else 0.0
    return min(1.0, max(j, j * 0.7 + boost + short / long * 0.1))


def contains_spaced(haystack: str, needle: str) -> bool:
    if len(needle) < 4:
        return False
    return needle in haystack or (len(needle) >= 5 and len(haystack) <= 4 * len(needle) and is_subsequence(haystack, needle))
