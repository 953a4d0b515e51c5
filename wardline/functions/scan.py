"""Whole texts at once: what of a long text needs a closer look, found with array operations, so that most of its words are never cut out."""

from __future__ import annotations

import ctypes
import unicodedata

import numpy as np
import pyarrow as pa
import regex

from wardline import fixed
from wardline.functions import chars

#: Shorter texts are not worth the arrays.
LONG = 160
_SPACE, _NONE, _ODD = 1, 2, 3
#: Stands in labels for a letter that no ASCII letter is read for.
FOREIGN = "~"
_IS_SPACE, _IS_LABEL = regex.compile(r"\s"), regex.compile(r"[\p{L}\p{Nd}_-]")
_STARTS = regex.compile(r"[\p{L}\p{N}_@]")
_LIKE = regex.compile(r"[\p{L}\p{Nd}@!|$×]")
_HIDDEN = regex.compile(fixed.INVISIBLE)
#: Characters that other letters stand for where case does not count, or whose lower case depends on what is beside them.
_ODD_CASE = "\u017f\u0130\u0131\u03a3\u212a\u212b"
_LOOSE = set(fixed.IGNORED + "ЪЬ")

_fold = np.zeros(0x110000, np.uint32)  # 0: not seen yet; _SPACE, _NONE, _ODD or the folded letter
_label = np.zeros(0x110000, np.uint32)  # the letter of a label in lower case, a space, or _ODD
_kind = np.zeros(0x110000, np.uint8)  # 1: leet, 2: separates or counts for nothing, 4: a letter, a digit or like one, 8: can begin a name or label


def _learn(codes: np.ndarray) -> None:
    for code in np.unique(codes).tolist():
        ch = chr(code)
        got, low = chars.folded(ch), ch.lower()
        odd = ch in _ODD_CASE or len(low) != 1 or (got is not None and len(got) > 1) or 0xD800 <= code < 0xE000 or code < 4
        like = _LIKE.match(ch) is not None and ch not in _LOOSE
        _kind[code] = (ch in fixed.LEET) | (not like) << 1 | like << 2 | (_STARTS.match(ch) is not None) << 3
        _label[code] = _ODD if odd or _HIDDEN.match(ch) else 32 if not _IS_LABEL.match(ch) else ord(low if low.isascii() or low in fixed.DOMAIN_FOLD else FOREIGN)
        _fold[code] = _ODD if odd else _SPACE if _IS_SPACE.match(ch) else ord(got) if got else _NONE


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le")


def _single(codes: np.ndarray) -> np.ndarray:
    """Which places differ from the one before."""
    out = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=out[1:])
    return out


class Scan:
    """A text in arrays. ``plain``: NFKC leaves it as it is and every character folds by itself, so a part's form is a part of the form."""

    def __init__(self, s: str):
        self.s = s
        self.codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
        self.fold = _fold[self.codes]
        if not self.fold.all():
            _learn(self.codes[self.fold == 0])
            self.fold = _fold[self.codes]
        self.plain = (s.isascii() or unicodedata.is_normalized("NFKC", s)) and not (self.fold == _ODD).any()
        self._form = self._tokens = self._labels = None

    def form(self) -> str:
        """compact() of a plain text."""
        if self._form is None:
            own = self.fold[self.fold > _ODD]
            self._form = _text(own[_single(own)])
        return self._form

    def pairs(self) -> int:
        """At most as many as there are different pairs of neighbours in the form."""
        own = self.fold[self.fold > _ODD]
        own = own[_single(own)]
        seen = np.zeros(1 << 16, bool)
        seen[(own[:-1] * np.uint32(256) + own[1:]) & 0xFFFF] = True
        return int(np.count_nonzero(seen))

    def tokens(self) -> tuple[tuple[str, np.ndarray], tuple[str, np.ndarray], tuple[str, np.ndarray], np.ndarray]:
        """Of a plain text, each with the places of its letters: the forms of the words with a separator between; forms of three letters at
        most, joined where they are neighbours; the forms of words that may look obfuscated. Then the places of white space."""
        if self._tokens is None:
            at = np.flatnonzero(self.fold != _NONE)
            at = at[_single(self.fold[at])]
            forms = self.fold[at]
            space = forms == _SPACE
            ids = np.cumsum(space)
            short = (np.bincount(ids, weights=~space) <= 3)[ids]
            kind = _kind[self.codes]
            odd = kind & 1 > 0
            odd[:-1] |= (kind[:-1] & 2 > 0) & (kind[1:] & 4 > 0)
            gaps = self.fold == _SPACE
            word = np.cumsum(gaps)
            own = np.zeros(int(word[-1]) + 1, bool)
            own[word[odd & ~gaps]] = True
            own = own[word[at]]
            self._tokens = (_text(forms), at), (_text(forms[space ^ short]), at[space ^ short]), (_text(forms[own]), at[own]), np.flatnonzero(gaps)
        return self._tokens

    def labels(self) -> tuple[list[str], np.ndarray, np.ndarray] | None:
        """The text's labels in lower case, other letters than those of domains as one, with their places; None if a character needs more than that."""
        if self._labels is None:
            low = _label[self.codes]
            if not (low == _ODD).any():
                inside = np.zeros(len(low) + 2, np.int8)
                inside[1:-1] = low != 32
                step = np.diff(inside)
                self._labels = _text(low).split(), np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return self._labels

    def widest(self) -> int:
        """No fewer characters than any six neighbours take of the words a name or label can begin in, with all that is between them."""
        edges = np.concatenate([[-1], np.flatnonzero(self.fold == _SPACE), [len(self.codes)]])
        own = np.zeros(len(edges) - 1, bool)
        own[np.cumsum(self.fold == _SPACE)[_kind[self.codes] & 8 > 0]] = True
        starts, stops = edges[:-1][own] + 1, edges[1:][own]
        return int((stops[5:] - starts[:-5]).max()) if len(starts) > 5 else len(self.codes)


    def around(self, places: np.ndarray) -> list[tuple[int, str]]:
        """Start and text of the words that have one of the places."""
        spaces = self.tokens()[-1]
        edges = np.concatenate([[-1], spaces, [len(self.s)]])
        k = np.unique(np.searchsorted(spaces, places))
        return [(a, self.s[a:b]) for a, b in zip((edges[k] + 1).tolist(), edges[k + 1].tolist(), strict=True) if a < b]


_last: list[Scan] = []


def scan(s: str) -> Scan:
    """Filters look at the same text one after another: the last one's arrays are kept."""
    if not _last or (_last[0].s is not s and _last[0].s != s):
        _last[:] = [Scan(s)]
    return _last[0]


def form_of(s: str) -> str:
    """compact()."""
    return scan(s).form() if len(s) >= LONG and scan(s).plain else chars.compact(s)


def hand_back() -> None:
    """Gives the system the memory that a task's batches took; the worker process stays for other tasks."""
    _last.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
