"""Both records of a user stepped over messages whose texts are elsewhere.

A message comes with the facts of its text: digest and length of its form, whether it floods, what it says by itself, and the bitmap of its
bigrams where a record may be compared with it. Short texts come whole. Where a step would need two long texts side by side, it goes on as
if the answer were no and asks; whoever has a yes among the answers must be stepped again with the texts. A user without a yes has
the result that the texts give.
"""

from __future__ import annotations

import marshal
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import md5
from typing import NamedTuple

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.config import Settings
from wardline.functions.chars import ad_similarity, bigrams, contains_spaced
from wardline.functions.scan import form_of, hand_back
from wardline.operators import spam
from wardline.operators.ads import Signals, is_weak
from wardline.operators.fold import Fold
from wardline.operators.links import Span, disjoint
from wardline.operators.suspicion import Print, Record, SuspicionFold

#: Texts of so many characters come whole; no fewer than the rule for benign contacts looks into.
SHORT = 64
ASK = "array<struct<kind: string, a: long, ah: long, b: long, bh: long, arg: string>>"
_PLACES = "abcdefghijklmnopqrstuvwxyz0123456789"


@dataclass(frozen=True, eq=False)
class Form:
    """A folded text by digest and length; ``text`` is None where it is long."""

    id: int
    h: int
    n: int
    key: bytes
    text: str | None = None
    bits: bytes | None = None
    pairs: int = 0

    def __eq__(self, other) -> bool:
        return self.key == other.key

    def __len__(self) -> int:
        return self.n


def digest(s: str) -> bytes:
    return md5(s.encode("utf-8", "surrogatepass")).digest()


@lru_cache(maxsize=65536)
def _bit(pair: str) -> int:
    a, b = _PLACES.find(pair[0]), _PLACES.find(pair[1])
    return 1 << (36 * a + b if a >= 0 and b >= 0 else (31 * ord(pair[0]) + ord(pair[1])) % 1296)


def pair_bits(form: str) -> bytes:
    """A bit for each bigram of a form of two characters at least; bigrams may share one."""
    out = 0
    for pair in bigrams(form):
        out |= _bit(pair)
    return out.to_bytes(162, "little")


def most_similar(a: Form, b: Form) -> float:
    """No less than ad_similarity() of the two texts."""
    if a.bits is None or b.bits is None:
        return 1.0
    x, y = int.from_bytes(a.bits, "little"), int.from_bytes(b.bits, "little")
    only_a, only_b = (x & ~y).bit_count(), (y & ~x).bit_count()
    both = min(a.pairs - only_a, b.pairs - only_b)
    j = both / (a.pairs + b.pairs - both)
    boost = 0.15 if only_a and only_b else 0.25
    return min(1.0, max(j, j * 0.7 + boost + min(a.n, b.n) / max(a.n, b.n) * 0.1))


class Told(NamedTuple):
    """What a text says by itself about links and advertising; ``bits`` are those of its folded form."""

    n: int
    short: str | None
    form_n: int
    key: bytes
    bits: bytes | None
    pairs: int
    handles: tuple[str, ...]
    keywords: tuple[str, ...]
    hinted: bool
    linked: bool
    phrase: bool
    urlish: bool
    n_links: int
    n_hit: int


def facts(spark: SparkSession, cfg: Settings, names: Iterable[str] = ()):
    """A function from a text and what the word filters leave of it to its facts and its number of links. Settings are broadcast."""
    sent = spark.sparkContext.broadcast((cfg, tuple(names)))

    @F.pandas_udf("struct<facts: binary, n_links: int>")
    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        fold = BriefFold(*sent.value)
        for texts, filtered in batches:
            rows = [fold.facts(a, b) for a, b in zip(texts, filtered, strict=True)]
            yield pd.DataFrame({"facts": [r[0] for r in rows], "n_links": pd.Series([r[1] for r in rows], dtype="int32")}, index=texts.index)
        hand_back()

    return look.asNondeterministic()


@dataclass
class Both:
    spam: spam.State = field(default_factory=spam.State)
    ads: Record = field(default_factory=Record)


class BriefFold(Fold):
    """Adds both records' results, the number of links, and what must be asked of the texts."""

    needs = ("facts", "id", "h")
    adds = (("spam_reason", "string"), ("spam_remaining_s", "int"), ("spam_duplicate", "boolean"), ("level", "int"), ("ad_score", "int"), ("n_links", "int"), ("asks", ASK))

    def __init__(self, cfg: Settings = Settings(), names: Iterable[str] = ()):
        self.cfg, self.view = cfg, SuspicionFold(cfg.links, names)
        self.ttl_ms = max(spam.SpamFold(cfg.spam).ttl_ms, self.view.ttl_ms)

    def new(self) -> Both:
        return Both()

    def facts(self, s: str, filtered: str) -> tuple[bytes, int]:
        form = spam.similarity_form(s) if self.cfg.spam.enabled else ""
        told = self._told(filtered) if self.cfg.links.enabled else None
        out = (len(s), s if len(s) <= SHORT else None, len(form), digest(form), spam.is_flood(s, self.cfg.spam), told and tuple(told))
        return marshal.dumps(out), told.n_links if told else 0

    def _told(self, s: str) -> Told:
        v, cfg = self.view.view(s), self.cfg.links.ads
        links, form, bits = [Span(**m) for m in v["links"]], form_of(s), None
        hit = self.view.finder.ads.hit(s, "", 0)
        keys, handles, linked = tuple(v["keywords"]), tuple(v["handles"]), bool(links)
        x = Signals(s, form, handles, keys, any(not is_weak(k) for k in keys), linked, v["urlish"], None)
        if len(s) > SHORT and len(form) >= 8 and cfg.enabled and cfg.track_similarity and (linked or v["phrase"] or x.base + 55 >= cfg.min_score):
            bits = pair_bits(form)
        with_hit = len(disjoint([*links, Span(hit.start, hit.end, hit.text)]))
        return Told(len(s), s if len(s) <= SHORT else None, len(form), digest(form), bits, len(bigrams(form)) if bits else 0, handles, keys, v["hinted"], linked, v["phrase"], v["urlish"], len(links), with_hit)

    def step(self, state: Both, at: int, row: dict) -> tuple:
        n, short, form_n, key, flood, told = marshal.loads(row["facts"])
        asks: list[tuple] = []
        got, ads = None, (None, None, None)
        if self.cfg.spam.enabled:
            form = Form(row["id"], row["h"], form_n, key, None if short is None else spam.similarity_form(short))
            cfg = self.cfg.spam
            got = spam.step(cfg, state.spam, at, range(n), at - cfg.lock_ms, spam.Seen(form, flood, lambda a, b, percent: self._like(a, b, percent, asks)))
        if told:
            ads = self._ads(state.ads, at, row, Told(*told), asks)
        return *(got or (None, None, None)), *ads, [dict(zip(("kind", "a", "ah", "b", "bh", "arg"), x, strict=True)) for x in dict.fromkeys(asks)]

    def _like(self, a: spam.Recent, b: spam.Recent, percent: int, asks: list) -> bool:
        x, y = a.form, b.form
        if x == y:
            return True
        if abs(len(x) - len(y)) > 6:
            return False
        if x.text is not None and y.text is not None:
            return spam.similar(spam.Recent(0, x.text), spam.Recent(0, y.text), percent)
        asks.append(("spam", x.id, x.h, y.id, y.h, str(percent)))
        return False

    def _ads(self, r: Record, at: int, row: dict, v: Told, asks: list) -> tuple:
        """As SuspicionFold.step(): all hits of a message cover the same characters, so it is hit if any scores enough."""
        cfg, ads = self.cfg.links.ads, self.view.finder.ads
        if not cfg.enabled or v.n < 3:
            return r.level, 0, v.n_links
        if r.level and at - r.at > cfg.ttl_ms:
            r.level, r.history, r.handles, r.keywords = 0, [], [], []
        if not r.level and not v.hinted:
            return r.level, 0, v.n_links
        text = None if v.short is None else form_of(v.short)
        bits, pairs = (pair_bits(text), len(bigrams(text))) if text is not None and len(text) >= 8 else (v.bits, v.pairs)
        form = Form(row["id"], row["h"], v.form_n, v.key, text, bits, pairs)
        x = Signals(range(v.n) if v.short is None else v.short, form, v.handles, v.keywords, any(not is_weak(k) for k in v.keywords), v.linked, v.urlish, v.phrase)
        score, hits = ads.first_hits(x, r.level)
        hit = any(h.score >= cfg.min_score for h in hits) or bool(r.level) and self._elevated(r, x, score, asks)
        if hit or v.linked:
            r.level, r.at = min(cfg.max_level, r.level + 1), at
            r.handles = list(dict.fromkeys([*r.handles, *(h for h in x.handles if len(h) >= 4)]))
            r.keywords = list(dict.fromkeys([*r.keywords, *(k for k in x.keywords if not is_weak(k))]))
            r.history = [*r.history, Print(form, x.handles)][-cfg.history :]
        return r.level, score, v.n_hit if hit else v.n_links

    def _elevated(self, r: Record, x: Signals, base: int, asks: list) -> bool:
        """Whether the record alone gives a hit that scores enough; a record's handles hold those of its history."""
        cfg, form = self.cfg.links.ads, x.form
        aimed = x.strong and bool(x.handles or x.urlish)
        if (x.linked or aimed) and base + 10 >= cfg.min_score or r.level >= 3 and (aimed or (x.strong and x.linked)) and base + 20 >= cfg.min_score:
            return True
        known = [h for h in r.handles if len(h) >= 4]
        if base + 55 >= cfg.min_score and any(h == k or ad_similarity(h, k, 0.9) >= 0.9 for k in known for h in x.handles):
            return True
        if base + 50 >= cfg.min_score:
            for k in known:
                if form.text is None:
                    asks.append(("holds", form.id, form.h, form.id, form.h, k))
                elif contains_spaced(form.text, k):
                    return True
        if not cfg.track_similarity or base + 40 < cfg.min_score or not (x.strong or x.handles or x.linked or x.urlish or r.level >= 3):
            return False
        least = (cfg.similar_percent_high if r.level >= 3 else cfg.similar_percent) / 100
        before: list[tuple] = []  # texts that may be the first similar one
        for other in (p.form for p in r.history):
            if min(len(form), len(other)) < 8:
                continue
            if form == other or (form.text is not None and other.text is not None):
                sim = 1.0 if form == other else ad_similarity(form.text, other.text, least)
                if sim >= least:
                    if base + int(sim * 40) < cfg.min_score:
                        return False
                    asks += before
                    return True
            elif (most := most_similar(form, other)) >= least:
                pair = ("ad", form.id, form.h, other.id, other.h)
                before.append((*pair, f"{least} {base} {base}"))
                if base + int(most * 40) >= cfg.min_score:
                    asks.append((*pair, f"{least} {base} {cfg.min_score}"))
        return False

    def dump(self, state: Both) -> str:
        raise NotImplementedError("only tables have their texts elsewhere")

    def load(self, text: str) -> Both:
        raise NotImplementedError("only tables have their texts elsewhere")


def answer(kind: str, a: str, b: str, arg: str) -> bool:
    """Whether a step that asked was wrong to go on as if the answer were no."""
    if kind == "spam":
        return spam.similar(spam.Recent(0, spam.similarity_form(a)), spam.Recent(0, spam.similarity_form(b)), int(arg))
    if kind == "holds":
        return contains_spaced(form_of(a), arg)
    least, base, enough = arg.split()
    x, y = form_of(a), form_of(b)
    sim = ad_similarity(x, y, float(least))
    return sim >= float(least) and min(len(x), len(y)) >= 8 and int(base) + int(sim * 40) >= int(enough)


@F.pandas_udf(T.BooleanType())  # not as a string: workers import this without a session
def answers(kind: pd.Series, a: pd.Series, b: pd.Series, arg: pd.Series) -> pd.Series:
    out = pd.Series([answer(*x) for x in zip(kind, a, b, arg, strict=True)], index=kind.index, dtype=bool)
    hand_back()
    return out
