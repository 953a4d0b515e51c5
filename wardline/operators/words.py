"""Dictionary words in obfuscated text: Aho-Corasick over folded views whose letters know where they came from."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from wardline import fixed
from wardline.config import Words
from wardline.functions.chars import alnum_span, compact, folded, has_obfuscation, lexical, one_deletion
from wardline.functions.scan import LONG, Scan, hand_back, scan
from wardline.operators.lexicon import FUZZY_FROM, SHORTEST, Matchers, matches_of

#: Different tokens, of at most so many characters, whose analysis an engine remembers.
REMEMBERED, MEMO_CHARS = 20_000, 64
MATCH = "array<struct<start: int, end: int, dict_word: string, text: string, confidence: int, reason: string>>"
_TOKEN = regex.compile(r"\S+")
_ALNUM = regex.compile(r"[\p{L}\p{Nd}]+")


class Match(NamedTuple):
    start: int
    end: int
    dict_word: str
    text: str
    confidence: int
    reason: str


class View(NamedTuple):
    """Folded letters, repeats single, with the first and the last place of each in the text."""

    text: str
    first: list[int]
    last: list[int]


def views(s: str, gap: int | None) -> list[View]:
    """The view of a text, cut where more than ``gap`` separators stand between letters (None: nowhere)."""
    out: list[View] = []
    letters, first, last, between = [], [], [], 0
    for i, ch in enumerate(s):
        f = folded(ch)
        if f is None:
            between += 1
        elif f:
            if gap is not None and between > gap and letters:
                out.append(View("".join(letters), first, last))
                letters, first, last = [], [], []
            between = 0
            if letters and letters[-1] == f:
                last[-1] = i
            else:
                letters.append(f)
                first.append(i)
                last.append(i)
    if letters:
        out.append(View("".join(letters), first, last))
    return out


def greedy(matches: Iterable[Match]) -> list[Match]:
    """Disjoint matches: by start, then the more certain, then the longer."""
    out: list[Match] = []
    for m in sorted(matches, key=lambda m: (m.start, -m.confidence, m.start - m.end)):
        if not out or m.start >= out[-1].end:
            out.append(m)
    return out


class Token(NamedTuple):
    """What is known of a token wherever it stands; places count from its start."""

    form: str
    matches: tuple[Match, ...]
    safe: tuple[tuple[int, int], ...]


def _holds(automaton, form: str) -> bool:
    return any(True for _ in matches_of(automaton, form))


class Engine:
    def __init__(self, matchers: Matchers, level: str = "high", names: frozenset[str] = frozenset(), fuzzy_from: int = FUZZY_FROM):
        self.m, self.level, self.names, self.fuzzy_from = matchers, level.lower(), names, fuzzy_from
        self.fuzzy = self.level == "high"
        self.gap = {"low": 0, "medium": 2}.get(self.level, 3)
        self.least = 80 if self.fuzzy else 70
        self.memo: dict[str, Token] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def token(self, text: str) -> Token:
        got = self.memo.get(text)
        if got is None:
            form, matches, safe = compact(text), [], []
            other = not text.isascii()  # the views of an ASCII token are parts of its form, so what is not in that is in no view
            if max(len(form), len(text)) >= SHORTEST:
                if other or _holds(self.m.exact_automaton, form):
                    matches += self._streams(text)
                if self.fuzzy and self.m.fuzzy and (other or _holds(self.m.fuzzy_automaton, form)) and has_obfuscation(text):
                    matches += self._fuzzy(text)
            if len(text) >= SHORTEST and self.m.safe_automaton is not None and (other or _holds(self.m.safe_automaton, form)):
                safe = [(view.last[a], view.last[b - 1] + 1) for view in views(text, None) for a, b, _ in matches_of(self.m.safe_automaton, view.text)]
            got = Token(form, tuple(matches), tuple(safe))
            if len(text) <= MEMO_CHARS:
                if len(self.memo) >= REMEMBERED:
                    self.memo.clear()
                self.memo[text] = got
        return got

    def find(self, s: str | None) -> list[Match]:
        if not s or len(s) < SHORTEST or not self.m.words:
            return []
        if self.level == "low":
            return greedy(self._whole_tokens(s))
        if len(s) >= LONG and (x := scan(s)).plain:
            return self._find_plain(s, x)
        tokens, found = [], []
        for t in _TOKEN.finditer(s):
            form, matches, _ = self.token(t[0])
            start = t.start()
            tokens.append((start, t[0], form))
            if matches:
                found += [m._replace(start=m.start + start, end=m.end + start) for m in matches]
        found += self._fragments(s, tokens)
        if not found:
            return []
        return self._chosen(found, self._protected(tokens))

    def _chosen(self, found: list[Match], regions: list[tuple[int, int]]) -> list[Match]:
        return greedy(m for m in found if m.confidence >= self.least and not any(m.start < b and a < m.end for a, b in regions))

    def _find_plain(self, s: str, x: Scan) -> list[Match]:
        """find() of a plain text: only words whose form holds an entry, or that look obfuscated, can match; and only words that overlap a
        match can protect from it."""
        exact = self.m.exact_automaton
        if exact is None:
            return []
        (forms, at), (short, short_at), (odd, odd_at), _ = x.tokens()
        near = at[[last for last, _ in exact.iter(forms)]]
        if self.fuzzy and self.m.fuzzy_automaton is not None:
            near = np.concatenate([near, odd_at[[last for last, _ in self.m.fuzzy_automaton.iter(odd)]]])
        found = []
        if len(near):
            for start, text in x.around(near):
                found += [m._replace(start=m.start + start, end=m.end + start) for m in self.token(text).matches]
        runs = {}
        for last, _ in exact.iter(short):
            first, stop = short.rfind("\x01", 0, last) + 1, short.find("\x01", last)
            runs[first] = stop if stop >= 0 else len(short)
        for first, stop in runs.items():
            own = x.around(np.arange(short_at[first], short_at[stop - 1] + 1))
            found += self._fragments(s, [(start, text, self.token(text).form) for start, text in own])
        if not found:
            return []
        inside = np.concatenate([np.arange(m.start, m.end) for m in found])
        return self._chosen(found, self._protected([(start, text, self.token(text).form) for start, text in x.around(inside)]))

    def _whole_tokens(self, s: str) -> Iterator[Match]:
        for t in _ALNUM.finditer(s):
            form = compact(t[0], False)
            if len(form) >= SHORTEST and form not in self.m.safe and form in self.m.words:
                yield Match(t.start(), t.end(), form, t[0], 100, "exact-token")

    def _is_form(self, form: str, word: str) -> bool:
        if not self.fuzzy or len(word) < self.fuzzy_from:
            return False
        return form == word or (len(form) == len(word) - 1 and (self.m.fuzzy.get(form) == word or one_deletion(word, form)))

    def _judge(self, s: str, start: int, end: int, word: str) -> tuple[str, str, int, int] | None:
        """What the whole token around a hit is: the word ("same"), a fuzzy form, or neither ("part"); None if the hit does not count."""
        left, right = alnum_span(s, start, end)
        whole = compact(s[left:right])
        if whole in self.m.safe:
            return None
        if whole == word or whole in self.m.words:
            return "same", whole, left, right
        if self._is_form(whole, word):
            return "form", whole, left, right
        return None if word in whole else ("part", whole, left, right)

    @staticmethod
    def _soft_end(s: str, end: int) -> int:
        while end < len(s) and s[end] in fixed.SOFT_SIGNS:
            end += 1
        return end

    def _streams(self, s: str) -> Iterator[Match]:
        for view in views(s, self.gap):
            for a, b, word in matches_of(self.m.exact_automaton, view.text):
                start, end = view.first[a], view.last[b - 1] + 1
                got = self._judge(s, start, end, word)
                if got is None:
                    continue
                kind, _, left, right = got
                if kind == "same":
                    yield Match(left, right, word, s[left:right], 100, "exact-word")
                elif kind == "part":
                    end = self._soft_end(s, end)
                    yield Match(start, end, word, s[start:end], 92, "stream")
                elif has_obfuscation(s):
                    yield Match(left, right, word, s[left:right], 80, "fuzzy-word")

    def _fuzzy(self, s: str) -> Iterator[Match]:
        for view in views(s, None):
            if len(view.text) < max(4, self.fuzzy_from - 1):
                continue
            for a, b, word in matches_of(self.m.fuzzy_automaton, view.text):
                if len(word) < self.fuzzy_from or word in view.text:
                    continue
                start, end = view.last[a], self._soft_end(s, view.last[b - 1] + 1)
                got = self._judge(s, start, end, word)
                if got is None or (got[0] == "part" and len(got[1]) > len(word) + 2):
                    continue
                if got[0] != "part":
                    start, end = got[2:]
                yield Match(start, end, word, s[start:end], 80, "fuzzy-compact")

    def _fragments(self, s: str, tokens: list[tuple[int, str, str]]) -> Iterator[Match]:
        """Words spelt over neighbouring tokens of three letters at most each."""
        run: list[int] = []
        for i in range(len(tokens) + 1):
            if i < len(tokens) and 1 <= len(tokens[i][2]) <= 3:
                run.append(i)
                continue
            if len(run) > 1:
                yield from self._in_run(s, [tokens[j] for j in run])
            run = []

    def _in_run(self, s: str, run: list[tuple[int, str, str]]) -> Iterator[Match]:
        starts, ends, at = {}, {}, 0
        for k, (_, _, form) in enumerate(run):
            starts[at] = k
            at += len(form)
            ends[at] = k
        for a, b, word in matches_of(self.m.exact_automaton, "".join(form for _, _, form in run)):
            if a not in starts or b not in ends or ends[b] == starts[a] or word in self.m.safe:
                continue
            own = run[starts[a] : ends[b] + 1]
            spelt = len(own) >= b - a  # a letter a token
            if not spelt and any(lexical(text) in fixed.FUNCTION_WORDS for _, text, _ in own):
                continue
            start, end = own[0][0], own[-1][0] + len(own[-1][1])
            yield Match(start, end, word, s[start:end], 95, "spaced-fragments")

    def _protected(self, tokens: list[tuple[int, str, str]]) -> list[tuple[int, int]]:
        out = []
        for start, text, form in tokens:
            if self.names and lexical(text) in self.names and not self._profane(form):
                out.append((start, start + len(text)))
            else:
                out += [(start + a, start + b) for a, b in self.token(text).safe]
        return out

    def _profane(self, form: str) -> bool:
        return _holds(self.m.exact_automaton, form) or _holds(self.m.fuzzy_automaton, form)


def engine(cfg: Words, names: Iterable[str] = ()) -> Engine:
    """The engine of one dictionary; names: folded by lexical(), their tokens are not words."""
    return Engine(Matchers(cfg.words, cfg.safe, cfg.level.lower() == "high"), cfg.level, frozenset(map(lexical, names)))


def find_words(spark: SparkSession, cfg: Words, names: Iterable[str] = ()):
    """A function from a text column to its matches; the engine is broadcast once."""
    sent = spark.sparkContext.broadcast(engine(cfg, names))

    @F.pandas_udf(MATCH)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for s in batches:
            yield s.map(lambda t: [m._asdict() for m in own.find(t)])
        own.memo.clear()
        hand_back()

    once = find.asNondeterministic()  # else Spark infers a filter from an explode and runs it twice
    return lambda c: once(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def rewrite(text: Column, spans: Column, cfg: Words) -> Column:
    """The text with every span masked; spans are disjoint and in order."""
    from wardline.functions.text import mask_full, mask_keep_edges

    mask = (lambda t: mask_keep_edges(t, cfg.mask)) if cfg.keep_edges else (lambda t: mask_full(t, cfg.mask))
    return replace_spans(text, spans, lambda m: mask(m["text"]))


def replace_spans(text: Column, spans: Column, replacement) -> Column:
    """Puts ``replacement(span)`` in place of each span; one pass from left to right."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, m: F.struct(
        F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), replacement(m)).alias("out"), m["end"].alias("at")
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def found_words(spans: Column) -> Column:
    """Distinct texts of the spans, in order."""
    return F.array_distinct(F.transform(spans, lambda m: m["text"]))
