"""Domain normalization for Python code inside Arrow UDFs; the Column forms are in normalize."""

from __future__ import annotations

from functools import lru_cache

import regex

from wardline import fixed
from wardline.operators.spans import java

_FOLD = str.maketrans(fixed.DOMAIN_FOLD)
_LABEL = regex.compile(r"[A-Za-z0-9_-]{1,63}")
_TAIL = regex.compile("[/?#].*", regex.S)
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")
_GAP, _FOREIGN, _DOTS, _LATIN = (regex.compile(p) for p in (r"[․·,;\s]", "[^a-z0-9_.-]", r"\.+", "[A-Za-z]"))
_CYRILLIC = regex.compile(r"\p{Script=Cyrillic}")


def tld_alias(domain: str) -> str:
    head, dot, last = domain.rpartition(".")
    if dot and not head:
        return domain
    alias = fixed.TLD_ALIASES.get(last.lower())
    return domain if alias is None else head + dot + alias


@lru_cache(maxsize=65536)
def latin_domain(s: str) -> str:
    s = _GAP.sub(".", s.lower()).translate(_FOLD)
    s = _DOTS.sub(".", _FOREIGN.sub("", s))
    return tld_alias(s.strip("."))


@lru_cache(maxsize=65536)
def latin_letters(s: str) -> int:
    return sum("a" <= ch <= "z" for ch in s.lower())


def is_latin_label(s: str) -> bool:
    return _LABEL.fullmatch(s) is not None


@lru_cache(maxsize=65536)
def is_domain_token(s: str) -> bool:
    if not 1 <= len(s) <= 63:
        return False
    if is_latin_label(s):
        return True
    if len(s) > 3 and _CYRILLIC.search(s) and not _LATIN.search(s):
        return False
    out = latin_domain(s)
    return len(out) <= 24 and is_latin_label(out)


@lru_cache(maxsize=65536)
def for_detection(s: str) -> str:
    plain = s.isascii()
    if not plain:
        s = java(fixed.INVISIBLE).sub("", s)
    if ":" in s:
        s = java(fixed.SCHEME).sub("", s, count=1)
    if "/" in s or "?" in s or "#" in s:
        s = _TAIL.sub("", s)
    if not plain or "dot" in s.lower():
        s = java(fixed.OBFUSCATED_DOT).sub(".", s)
    s = _OTHER.sub(".", s).strip(".").lower()
    return tld_alias(s if plain else s.translate(_FOLD))
