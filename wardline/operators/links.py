"""Links, addresses and domains, however they are spelt."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import fixed
from wardline.config import Links
from wardline.functions.domains import for_detection, is_domain_token, latin_letters
from wardline.functions.normalize import for_detection as for_detection_column
from wardline.functions.normalize import text
from wardline.functions.scan import FOREIGN, LONG, hand_back, scan
from wardline.operators.ads import AdScorer
from wardline.operators.spans import java

#: Different words whose reading as a last label a finder remembers.
REMEMBERED = 20_000
SPAN = "array<struct<start: int, end: int, text: string>>"
_HARD = r"[.,;/\\․·]"
_ALIAS = r"(?:точка|тчк|dot)(?![\p{L}\p{Nd}_-])"
_LABEL = regex.compile(r"[\p{L}\p{Nd}_-]+")
_BREAK = regex.compile(rf"(?:{_ALIAS}|{_HARD}|[()\[\]{{}}]|\s)+", regex.I)
_REAL_BREAK = regex.compile(rf"{_HARD}|{_ALIAS}", regex.I)
_ALIAS_WORD = regex.compile(_ALIAS, regex.I)
_QUICK = regex.compile(r"[.,;/\\․·:@\[({]")
_PARTS = regex.compile(rf"(?:\s|{_HARD})+")
_SPACE = regex.compile(r"\s")
_SHORT_DOMAIN = regex.compile(r"[a-z0-9-]{2,}\.[a-z0-9-]{2,}")
_TRAIL = ".,;!?)]\"'"
#: What of an address, an invitation or a spelt dot any text with one holds in lower case.
_OTHER_WAYS = ("точк", "тчк", "т.ч.к", "discord", "t.me/", "telegram.me", "tg://", "vk.c", "bit.ly", "goo.gl", "tinyurl", "youtu.be", "dsc.gg", "invite.gg")
_BLANKS, _DOTS = " \t\n\x0b\f\r", frozenset(".,․·/;")
_NUMBERS = regex.compile(r"\d(?:\s*[.,\-․·]\s*\d{1,3}){3}")


class Span(NamedTuple):
    start: int
    end: int
    text: str


def host(domain: str) -> str:
    return domain.removeprefix("www.")


def link_pattern(pattern: str | None) -> regex.Pattern:
    """The configured pattern, or the built-in one where that cannot be read."""
    try:
        return java("(?i)" + pattern.removeprefix("(?i)"), unicode=True) if (pattern or "").strip() else java(fixed.LINK_FALLBACK, unicode=True)
    except regex.error:
        return java(fixed.LINK_FALLBACK, unicode=True)


def disjoint(spans: Iterable[Span]) -> list[Span]:
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, s.start - s.end)):
        if not out or s.start >= out[-1].end:
            out.append(s)
    return out


class LinkFinder:
    def __init__(self, cfg: Links = Links(), names: Iterable[str] = ()):
        self.cfg = cfg
        self.tlds = frozenset(t.lower() for t in cfg.tlds)
        self.domains = frozenset(d for d in (host(for_detection(x)) for x in cfg.domains if x.strip()) if d)
        self.pattern = link_pattern(cfg.regex)
        self.ads = AdScorer(cfg.ads, names)
        self.endings: dict[str, bool] = {}
        self.labels: dict[str, bool] = {}
        self.plain_ends = frozenset(t for t in (*self.tlds, *fixed.TLD_ALIASES) if t.isascii() and t.isalpha())
        self.by_end = cfg.smart and cfg.real_tld and all(t.isascii() for t in self.tlds)

    def may_hold_link(self, s: str) -> bool:
        if _QUICK.search(s):
            return True
        low = s.lower()
        if any(w in low for w in (*self.cfg.triggers, "dot", "точка", "тчк")):
            return True
        return any(2 <= len(t) <= 24 and t.lower().rstrip(_TRAIL) in self.tlds and len(t.rstrip(_TRAIL)) >= 2 for t in _PARTS.split(s))

    def is_valid(self, norm: str) -> bool:
        parts = norm.rstrip(".").split(".")
        if len(parts) < self.cfg.min_parts or not all(1 <= len(p) <= 63 for p in parts) or len(parts[-1]) < 2:
            return False
        return not self.cfg.real_tld or parts[-1].lower() in self.tlds

    def is_allowed(self, link: str) -> bool:
        norm = for_detection(link)
        if not any(java(p).search(link) for p in (fixed.IP, fixed.DISCORD, fixed.INVITE)):
            if not norm:
                return True
            looks = self.is_valid(norm) or (not self.cfg.smart and (_SHORT_DOMAIN.search(norm) or ("." in norm and len(norm) > 5)))
            if not looks:
                return True
        if not self.cfg.list_on:
            return False
        own = host(norm)
        return not own or (own in self.domains) == (self.cfg.list_mode == "whitelist")

    def by_pattern(self, s: str) -> Iterator[Span]:
        for p in (java(fixed.IP), java(fixed.DISCORD), java(fixed.INVITE), self.pattern, java(fixed.OBFUSCATED_DOMAIN)):
            yield from (Span(m.start(), m.end(), m[0]) for m in p.finditer(s) if len(m[0]) >= 4)

    def joined_labels(self, s: str, may: Callable[[int, int], bool] = lambda start, end: True) -> Iterator[Span]:
        """Labels joined by anything that reads as a dot; after the first real one spaces join too. ``may``: which spans can be valid."""
        at = 0
        while label := _LABEL.search(s, at):
            start, end, real = label.start(), label.end(), 0
            while gap := _BREAK.match(s, end):
                spaces = gap[0].isspace()
                hard = not spaces and (_REAL_BREAK.search(gap[0]) is not None or _ALIAS_WORD.search(s, gap.start(), gap.end()) is not None)
                if not hard and not (real and (spaces or _SPACE.search(gap[0]))):
                    break
                label = _LABEL.match(s, gap.end())
                if not label:
                    break
                real += hard
                end = label.end()
            if real and end - start >= 4 and may(start, end) and self.is_valid(for_detection(s[start:end])):
                yield Span(start, end, s[start:end])
            at = max(start + 1, end)

    def _ends(self, label: str) -> bool:
        """Whether a word by itself can end a domain spelt with spaces."""
        got = self.endings.get(label)
        if got is None:
            last = for_detection(label)
            got = last in self.tlds and last not in fixed.SPACED_TLD_STOP
            if len(self.endings) >= REMEMBERED:
                self.endings.clear()
            self.endings[label] = got
        return got

    def spaced(self, s: str) -> Iterator[Span]:
        """A known last label after up to six words that could be labels, with enough Latin letters."""
        labels = list(_LABEL.finditer(s))
        for i, m in enumerate(labels):
            if not self._ends(m[0]):
                continue
            first = i
            while first > max(0, i - 6) and is_domain_token(labels[first - 1][0]):
                first -= 1
            if first < i and sum(latin_letters(x[0]) for x in labels[first:i]) >= 7:
                yield Span(labels[first].start(), m.end(), s[labels[first].start() : m.end()])

    def links(self, s: str | None) -> list[Span]:
        """Blocked links without advertising; an allowed one does not hide what overlaps it."""
        if not s or len(s) < 3:
            return []
        if len(s) >= LONG and self.by_end and (found := self._by_ends(s)) is not None:
            return disjoint(x for x in found if not self.is_allowed(x.text)) if found and self.may_hold_link(s) else []
        if not self.may_hold_link(s):
            return []
        return disjoint(x for x in (*self.by_pattern(s), *self.joined_labels(s), *self.spaced(s)) if not self.is_allowed(x.text))

    def _has_end(self, label: str) -> bool:
        """Whether any part of a label could be the last part of a domain."""
        got = self.labels.get(label)
        if got is None:
            norm = for_detection(label)
            got = norm in self.tlds or any(p in self.tlds or p in fixed.TLD_ALIASES for p in norm.split("."))
            if len(self.labels) >= REMEMBERED:
                self.labels.clear()
            self.labels[label] = got
        return got

    def _by_ends(self, s: str) -> list[Span] | None:
        """Every span that can be blocked, found from the labels that can end a domain, without which no link is valid. None where a text has
        addresses, invitations, spelt dots or characters that take the long way."""
        got, low = scan(s).labels(), s.lower()
        if got is None or any(w in low for w in _OTHER_WAYS) or _NUMBERS.search(s):
            return None
        words, starts, stops = got
        known = set(words)
        if "dot" in known:
            return None
        hot = known & self.plain_ends
        odd = [w for w in known if not w.isalpha() or not w.isascii()]
        hot.update(w for w in odd if (FOREIGN not in w or "-" in w or "_" in w) and self._has_end(w))
        if not hot:
            return []
        a, b = starts.tolist(), stops.tolist()
        ends = [i for i, w in enumerate(words) if w in hot]
        may = lambda start, end: words[bisect_right(a, end - 1) - 1] in hot or s.find("/", start, end) >= 0
        out: list[Span] = []
        if self.cfg.regex != fixed.LINK or self._dotted(s):
            out += [Span(m.start(), m.end(), m[0]) for m in self.pattern.finditer(s) if len(m[0]) >= 4]
        past = 0
        for i in ends:
            if i < past or not (self._after_dot(s, a[i]) or self._before_slash(s, b[i])):
                continue
            first = past = i  # the labels that dots join to this one: no match goes beyond them
            while first > 0 and s[b[first - 1] : a[first]].strip(_BLANKS) in _DOTS:
                first -= 1
            while past + 1 < len(a) and s[b[past] : a[past + 1]].strip(_BLANKS) in _DOTS:
                past += 1
            past += 1
            found = java(fixed.OBFUSCATED_DOMAIN).finditer(s, a[first], a[past] if past < len(a) else len(s))
            out += [Span(*m.span(), m[0]) for m in found if m.end() - m.start() >= 4 and may(*m.span())]
        if any(self._stops(s, b[i], a[i + 1] if i + 1 < len(a) else -1) for i in ends):
            out += self.joined_labels(s, may)
        for i in ends:
            if self._ends(s[a[i] : b[i]]):
                first = i
                while first > max(0, i - 6) and is_domain_token(s[a[first - 1] : b[first - 1]]):
                    first -= 1
                if first < i and sum(latin_letters(s[a[k] : b[k]]) for k in range(first, i)) >= 7:
                    out.append(Span(a[first], b[i], s[a[first] : b[i]]))
        return out

    @staticmethod
    def _dotted(s: str) -> bool:
        """Whether a dot may stand between two letters."""
        near = lambda ch: ch.isalnum() or ch in "_-" or not ch.isascii()
        at = s.find(".", 1)
        while 0 < at < len(s) - 1:
            if near(s[at + 1]) and near(s[at - 1]):
                return True
            at = s.find(".", at + 1)
        return False

    @staticmethod
    def _after_dot(s: str, start: int) -> bool:
        return s[max(0, start - 64) : start].rstrip()[-1:] in (".", ",", "․", "·", "/", ";") or (start >= 64 and s[start - 64 : start].isspace())

    @staticmethod
    def _before_slash(s: str, end: int) -> bool:
        while end < len(s) and s[end].isspace():
            end += 1
        return s[end : end + 1] == "/"

    @staticmethod
    def _stops(s: str, end: int, after: int) -> bool:
        """Whether joined labels may end after a label, or their host; after: where the next label begins."""
        gap = _BREAK.match(s, end)
        if not gap or gap.end() != after or "/" in gap[0]:
            return True
        return _SPACE.search(gap[0]) is None and _REAL_BREAK.search(gap[0]) is None

    def find(self, s: str | None) -> list[Span]:
        found = self.links(s)
        hits = self.ads.evaluate(s, bool(found))
        return disjoint([*found, *(Span(h.start, h.end, h.text) for h in hits)]) if hits else found


def find_links(spark: SparkSession, cfg: Links = Links(), names: Iterable[str] = (), with_ads: bool = True):
    """A function from a text column to its blocked spans; settings are broadcast, patterns compile once a task."""
    sent = spark.sparkContext.broadcast((cfg, tuple(names)))

    @F.pandas_udf(SPAN)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = LinkFinder(*sent.value)
        one = own.find if with_ads else own.links
        for s in batches:
            yield s.map(lambda t: [m._asdict() for m in one(t)])
        hand_back()

    once = find.asNondeterministic()
    return lambda c: once(text(c))


def best_templates(spark: SparkSession, cfg: Links = Links()):
    """A function from a text column to the phrase template that fits best."""
    sent = spark.sparkContext.broadcast(cfg.ads)

    @F.pandas_udf("template string, target string, kind string, similarity double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = AdScorer(sent.value)
        for s in batches:
            got = [own.templates.best(t) or (None,) * 4 for t in s]
            yield pd.DataFrame(got, columns=["template", "target", "kind", "similarity"], index=s.index)

    once = best.asNondeterministic()
    return lambda c: once(text(c))


def link_candidate(c: Column | str, cfg: Links = Links()) -> Column:
    """Whether anything in a text can begin a link; native, so it runs before any Python does."""
    s = text(c)
    known = F.arrays_overlap(F.transform(F.split(F.lower(s), rf"(?:\s|{_HARD})+"), lambda t: F.regexp_replace(t, r"[.,;!?)\]\"']+$", "")), F.array(*map(F.lit, cfg.tlds)))
    triggers = "|".join((*cfg.triggers, "dot", "точка", "тчк"))
    return s.rlike(rf"[.,;/\\․·:@\[({{]|(?iu:{triggers})") | known


def valid_domain(norm: Column, cfg: Links = Links()) -> Column:
    parts = F.split(F.regexp_replace(norm, r"\.+$", ""), r"\.")
    last = F.element_at(parts, -1)
    sizes = F.forall(parts, lambda p: (F.length(p) >= 1) & (F.length(p) <= 63))
    known = last.isin(*cfg.tlds) if cfg.real_tld else F.lit(True)
    return (F.size(parts) >= cfg.min_parts) & sizes & (F.length(last) >= 2) & known


def listed(df: DataFrame, link: str, domains: DataFrame, keep_listed: bool) -> DataFrame:
    """Rows whose link's host is in (or not in) a table of domains."""
    own = df.withColumn("_host", F.regexp_replace(for_detection_column(link), r"^www\.", ""))
    hosts = domains.select(F.regexp_replace(for_detection_column("domain"), r"^www\.", "").alias("_host")).filter("_host <> ''").distinct()
    return own.join(hosts, "_host", "left_semi" if keep_listed else "left_anti").drop("_host")


def ip_candidates(c: Column | str) -> Column:
    return F.filter(F.regexp_extract_all(text(c), F.lit(f"({fixed.IP[4:]})"), 1), lambda m: F.length(m) >= 4)


def format_links(links: Column, single: str = "{link}", each: str = "{link}", separator: str = ", ") -> Column:
    show = lambda template, v: F.replace(F.lit(template), F.lit("{link}"), v)
    return F.when(F.size(links) == 1, show(single, F.get(links, F.lit(0)))).otherwise(F.array_join(F.transform(links, lambda v: show(each, v)), separator))
