"""Advertising in a message: handles, promotional keywords, phrase templates and a score. History raises the score; see suspicion."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import regex

from wardline import fixed
from wardline.config import Ads
from wardline.functions.chars import ad_similarity, bigrams, compact, is_alnum, is_subsequence, lexical
from wardline.functions.domains import is_domain_token, latin_domain, latin_letters, tld_alias
from wardline.functions.scan import LONG, form_of, scan
from wardline.operators.spans import java


def handles(s: str) -> list[str]:
    if "@" not in s:
        return []
    found = [m[1] for m in java(fixed.HANDLE_LOOSE).finditer(s)] + [m[1] for m in java(fixed.HANDLE_STRICT).finditer(f" {s} ")]
    return [h for h in dict.fromkeys(map(compact, found)) if 4 <= len(h) <= 32]


_WORDS = regex.compile(r"[^\p{L}\p{N}@]+")
_NAME = regex.compile(r"[A-Za-z0-9_-]*[A-Za-z][A-Za-z0-9_-]*")
_form = lru_cache(maxsize=65536)(compact)


def significant_tokens(s: str) -> list[str]:
    words = [_form(w.removeprefix("@")) for w in dict.fromkeys(_WORDS.split(s.lower()))]
    return [t for t in dict.fromkeys([compact(s), *words]) if len(t) >= 4]


def keyword_matches(form: str, tokens: Iterable[str], key: str) -> bool:
    if len(key) < 2 or not form:
        return False
    if len(key) <= 3:
        return form == key or key in tokens
    if key in form or any(key in t for t in tokens):
        return True
    return len(key) >= 5 and len(form) <= 3 * len(key) and is_subsequence(form, key)


def keywords(s: str, keys: Iterable[str]) -> list[str]:
    """Folded keywords of a message, in the order of the list."""
    form = form_of(s)
    tokens = () if len(s) >= LONG and scan(s).plain else significant_tokens(s)  # words of a plain text are parts of its form, and too long for short keys
    return [k for k in dict.fromkeys(map(compact, keys)) if keyword_matches(form, tokens, k)]


def is_weak(key: str) -> bool:
    return len(key) <= 3 or key in fixed.WEAK_KEYWORDS


def is_urlish(s: str) -> bool:
    low = s.lower()
    return any(w in low for w in ("://", "www.", ".me/", ".gg/", ".com/")) and java(fixed.URLISH).search(s) is not None


def _has_word(s: str, word: str) -> bool:
    at = s.find(word)
    while at >= 0:
        end = at + len(word)
        if not (at and is_alnum(s[at - 1])) and not (end < len(s) and is_alnum(s[end])):
            return True
        at = s.find(word, at + 1)
    return False


def is_recruiting(s: str) -> bool:
    low, form = s.lower(), compact(s)
    return any(w in low for w in fixed.RECRUITING) or any(w in form for w in fixed.RECRUITING_FOLDED)


def names_platform(s: str, keys: Iterable[str]) -> bool:
    low = s.lower()
    return any(w in low for w in fixed.PLATFORM_PARTS) or any(_has_word(low, w) for w in fixed.PLATFORM_WORDS) or any(k in fixed.PLATFORM_KEYS for k in keys)


def is_benign_contact(s: str, keys: Iterable[str], linked: bool, urlish: bool) -> bool:
    """A short message that only tells where to find its author."""
    return not linked and not urlish and 3 <= len(s) <= 64 and not is_recruiting(s) and names_platform(s, keys)


class Target(NamedTuple):
    form: str
    kind: str
    raw: str
    start: int
    end: int


def _is_domain(norm: str) -> bool:
    *labels, last = norm.split(".")
    if len(norm) < 4 or not labels or last.lower() not in fixed.TARGET_TLDS or not all(1 <= len(x) <= 63 for x in labels):
        return False
    return sum(map(latin_letters, labels)) >= (3 if len(labels) > 1 else 4)


def targets(s: str) -> list[Target]:
    """What a message may advertise: handles, domains, domains spelt with spaces, and Latin names; each kind and form once."""
    found: list[Target] = []
    spans = {compact(m[1]): m.span() for m in reversed(list(java(fixed.HANDLE_LOOSE).finditer(s)))}
    for h in handles(s):
        a, b = spans.get(h, (-1, -1))
        found.append(Target(h, "handle", s[a:b] if a >= 0 else "@" + h, a, b))
    for m in java(fixed.TARGET_DOMAIN, unicode=True).finditer(s):
        norm = latin_domain(m[0])
        if _is_domain(norm):
            found.append(Target(norm, "domain", m[0], *m.span()))
    tokens = list(java(fixed.TARGET_TOKEN).finditer(s))
    for i, t in enumerate(tokens):
        last = latin_domain(t[0])
        if last not in fixed.TARGET_TLDS or not is_domain_token(t[0]):
            continue
        first = i
        while first > max(0, i - 4) and is_domain_token(tokens[first - 1][0]):
            first -= 1
        if first == i or latin_letters(last) + sum(latin_letters(x[0]) for x in tokens[first:i]) < 6:
            continue
        a, b = tokens[first].start(), t.end()
        norm = latin_domain(s[a:b])
        if not _is_domain(norm) and "." not in norm:
            norm = tld_alias(".".join(latin_domain(x[0]) for x in tokens[first : i + 1]))
        if _is_domain(norm):
            found.append(Target(norm, "domain", s[a:b], a, b))
    for t in tokens:
        if form := _name_form(t[0]):
            found.append(Target(form, "name", t[0], *t.span()))
    return list({(t.kind, t.form): t for t in reversed(found)}.values())[::-1]


@lru_cache(maxsize=65536)
def _name_form(token: str) -> str | None:
    """The folded form of a token that can be a Latin name."""
    form = compact(token)
    if not _NAME.fullmatch(token) or not 4 <= len(form) <= 32 or latin_letters(token) < 4 or form in fixed.TARGET_STOP or form in fixed.TARGET_TLDS:
        return None
    return form


@dataclass(frozen=True)
class Template:
    raw: str
    skeleton: str
    kinds: tuple[str, ...]
    anchors: tuple[str, ...]


_SLOT = regex.compile(r"\{(name|@name|domain)\}", regex.I)
_KINDS = {"name": ("handle", "name"), "@name": ("handle",), "domain": ("domain",)}


def compile_template(raw: str | None) -> Template | None:
    """A phrase with exactly one slot; anchors are its folded words, the longest first, eight at most."""
    raw = (raw or "").strip()
    slots = _SLOT.findall(raw)
    if len(raw) < 6 or len(slots) != 1:
        return None
    rest = _SLOT.sub("\x01", raw)
    words = [compact(w) for w in regex.split(r"[^\p{L}\p{N}]+", rest.lower()) if w]
    anchors = sorted((w for w in words if len(w) >= 3 or w in fixed.SHORT_ANCHORS), key=len, reverse=True)[:8]
    skeleton = compact(rest)
    return Template(raw, skeleton, _KINDS[slots[0].lower()], tuple(anchors)) if len(skeleton) >= 2 and anchors else None


def _anchors_in(form: str, anchors: Iterable[str]) -> int:
    real = [a for a in anchors if a not in fixed.FILLER_ANCHORS]
    long = [a for a in real if len(a) >= 3]
    return sum(a in form for a in (long or [a for a in real if a in fixed.SHORT_ANCHORS]))


class Phrase(NamedTuple):
    template: str
    target: str
    kind: str
    similarity: float


class Templates:
    def __init__(self, raws: Iterable[str], percent: int = 72, min_length: int = 12):
        self.templates = [t for t in map(compile_template, raws) if t]
        self.least = max(0.5, min(1.0, percent / 100))
        self.min_length = max(6, min_length)
        self.longest = max((len(p.skeleton) for p in self.templates), default=0)

    def best(self, s: str | None) -> Phrase | None:
        """The most similar template for any target cut out of the message; the first of equals."""
        if not s or len(s) < self.min_length or not self.templates:
            return None
        form = form_of(s)
        if len(form) < self.min_length - 2:
            return None
        if len(s) >= LONG and scan(s).plain and self._too_long(form, scan(s).widest() + 34 * ("@" in s), scan(s).pairs()):
            return None
        found = targets(s)
        if not found or self._hopeless(form, max(len(t.raw) for t in found)):
            return None
        shapes = []
        for t in found:
            if t.start >= 0:
                cut = s[: t.start] + "\x01" + s[t.end :]
            else:
                at = s.lower().find(t.raw.lower())
                cut = s if at < 0 else s[:at] + "\x01" + s[at + len(t.raw) :]
            shapes.append((t, compact(cut)))
        scored = (Phrase(p.raw, t.raw, t.kind, sim) for p in self.templates for t, form in shapes if t.kind in p.kinds for sim in [self._similarity(p, t, form)] if sim is not None)
        return max(scored, key=lambda m: m.similarity, default=None)

    def _hopeless(self, form: str, cut: int) -> bool:
        """Whether a message is too long for any template even with ``cut`` characters gone: then a similarity of 0.93 is asked for, which
        takes 0.8 of shared bigrams, but too many of the message's are in no template."""
        return self._too_long(form, cut, len(form)) and self._too_long(form, cut, len(bigrams(form)))

    def _too_long(self, form: str, cut: int, pairs: int) -> bool:
        """pairs: no more than the form's different bigrams."""
        return len(form) - cut - 2 > 6 * self.longest + 40 and 0.8 * (pairs - cut - 3) > self.longest

    def _similarity(self, p: Template, t: Target, form: str) -> float | None:
        anchors = _anchors_in(form, p.anchors)
        if len(form) < 2 or not anchors:
            return None
        sim = ad_similarity(form, p.skeleton)
        brand = t.kind != "domain" and len(t.form) >= 5 and any(m in form or m in p.skeleton for m in fixed.CRITICAL)
        if sim < self.least and ((t.kind == "domain" and anchors >= 2) or brand):
            sim = self.least + 0.01
        times, more = (4, 20) if t.kind == "domain" else (6, 40) if brand else (2, 10)
        if sim < self.least or (sim < 0.93 and len(form) > times * len(p.skeleton) + more):
            return None
        return sim


class Hit(NamedTuple):
    start: int
    end: int
    text: str
    reason: str
    score: int


@dataclass(frozen=True)
class Signals:
    """What a message says by itself."""

    text: str
    form: str
    handles: tuple[str, ...]
    keywords: tuple[str, ...]
    strong: bool
    linked: bool
    urlish: bool
    phrase: Phrase | None

    @property
    def base(self) -> int:
        score = 80 * self.linked + 55 * (self.urlish and not self.linked) + 35 * self.strong + 30 * bool(self.handles)
        score += 25 * (self.strong and (bool(self.handles) or self.linked or self.urlish))
        return score + 5 * (bool(self.keywords) and not self.strong)


class AdScorer:
    """Scores a message; names: lexical forms of users present, whose mentions are no handles."""

    def __init__(self, cfg: Ads = Ads(), names: Iterable[str] = ()):
        self.cfg, self.names = cfg, frozenset(names)
        self.keys = tuple(cfg.keywords or fixed.DEFAULT_KEYWORDS)
        self.templates = Templates(cfg.templates or fixed.DEFAULT_TEMPLATES, cfg.template_percent, cfg.template_min_length)

    def phrase(self, s: str) -> Phrase | None:
        got = self.templates.best(s) if self.cfg.templates_on else None
        if got and got.kind != "domain" and len(lexical(got.target)) >= 2 and lexical(got.target) in self.names:
            return None
        return got

    def signals(self, s: str, linked: bool, level: int = 0) -> Signals | None:
        """None where nothing hints at an ad and the user's record is clean."""
        phrase, urlish = self.phrase(s), is_urlish(s)
        if level == 0 and not linked and "@" not in s and not urlish and phrase is None:
            return None
        gone = {compact(m[1]) for m in java(fixed.MENTION).finditer(s) if len(lexical(m[1])) >= 2 and lexical(m[1]) in self.names}
        keys = keywords(s, self.keys)
        own = tuple(h for h in handles(s) if h not in gone)
        return Signals(s, form_of(s), own, tuple(keys), any(not is_weak(k) for k in keys), linked, urlish, phrase)

    def hit(self, s: str, reason: str, score: int) -> Hit:
        end = len(s) if self.cfg.whole_message else min(len(s), 32)
        return Hit(0, end, s[:end], reason, score)

    def first_hits(self, x: Signals, level: int = 0) -> tuple[int, list[Hit]]:
        """The score, and hits that need no history."""
        score, hits = x.base, []
        benign = level == 0 and is_benign_contact(x.text, x.keywords, x.linked, x.urlish)
        if x.phrase and not benign:
            score = max(score, self.cfg.template_score, self.cfg.min_score)
            hits.append(self.hit(x.text, "phrase-template", max(self.cfg.template_score, self.cfg.min_score)))
        if level == 0 and not benign:
            if x.strong and (x.handles or x.urlish or x.linked):
                hits.append(self.hit(x.text, "promo-combo", score))
            elif x.handles and x.urlish:
                hits.append(self.hit(x.text, "handle-url", score))
        return score, hits

    def accept(self, hits: list[Hit]) -> list[Hit]:
        """Disjoint hits by start, then score, that score enough."""
        out: list[Hit] = []
        for h in sorted(hits, key=lambda h: (h.start, -h.score, h.start - h.end)):
            if not out or h.start >= out[-1].end:
                out.append(h)
        return [h for h in out if h.score >= self.cfg.min_score]

    def evaluate(self, s: str | None, linked: bool) -> list[Hit]:
        """Hits of a message from a user without a record."""
        if not self.cfg.enabled or not s or len(s) < 3:
            return []
        x = self.signals(s, linked)
        return self.accept(self.first_hits(x)[1]) if x else []
