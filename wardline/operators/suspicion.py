"""Suspicion that grows with a user's advertising: levels, what they advertised, and hits that only a record gives."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.config import Links
from wardline.functions.chars import ad_similarity, contains_spaced
from wardline.functions.normalize import text
from wardline.functions.scan import form_of
from wardline.operators.ads import Hit, Signals, is_weak
from wardline.operators.fold import Fold, along
from wardline.operators.links import SPAN, LinkFinder, Span, disjoint

#: What a text alone says about links and advertising; the record of its user decides the rest.
ADS = f"struct<links: {SPAN}, hinted: boolean, handles: array<string>, keywords: array<string>, phrase: boolean, urlish: boolean>"


class Print(NamedTuple):
    form: str
    handles: tuple[str, ...]


@dataclass
class Record:
    level: int = 0
    at: int = 0
    history: list[Print] = field(default_factory=list)
    handles: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)


class SuspicionFold(Fold):
    """Blocked spans of each message under its user's record. Any blocked link raises the level, hit or not; time without one clears it."""

    adds = (("links", "array<struct<start: int, end: int, text: string>>"), ("level", "int"), ("ad_score", "int"))

    def __init__(self, cfg: Links = Links(), names: Iterable[str] = (), ready: bool = False):
        """ready: messages come with ads(), which is then not worked out again."""
        self.cfg, self.names, self.ready = cfg, tuple(names), ready
        self.needs = ("text", "ads") if ready else ("text",)
        self.ttl_ms = 2 * cfg.ads.ttl_ms
        self._finder: LinkFinder | None = None

    def __getstate__(self):
        return self.__dict__ | {"_finder": None}

    @property
    def finder(self) -> LinkFinder:
        if self._finder is None:
            self._finder = LinkFinder(self.cfg, self.names)
        return self._finder

    def new(self) -> Record:
        return Record()

    def view(self, s: str) -> dict:
        """What ads() gives for a text."""
        links, ads = self.finder.links(s), self.finder.ads
        x = ads.signals(s, bool(links), 1) if self.cfg.ads.enabled and len(s) >= 3 else None
        if x is None:
            return {"links": [m._asdict() for m in links], "hinted": False, "handles": [], "keywords": [], "phrase": False, "urlish": False}
        hinted = bool(links) or "@" in s or x.urlish or x.phrase is not None
        return {"links": [m._asdict() for m in links], "hinted": hinted, "handles": list(x.handles), "keywords": list(x.keywords), "phrase": x.phrase is not None, "urlish": x.urlish}

    def evaluate(self, r: Record, at: int, s: str, v: dict) -> tuple[list[Hit], int]:
        ads, cfg, linked = self.finder.ads, self.cfg.ads, bool(v["links"])
        if not cfg.enabled or len(s) < 3:
            return [], 0
        if r.level and at - r.at > cfg.ttl_ms:
            r.level, r.history, r.handles, r.keywords = 0, [], [], []
        if not r.level and not v["hinted"]:
            return [], 0
        x = Signals(s, form_of(s), tuple(v["handles"]), tuple(v["keywords"]), any(not is_weak(k) for k in v["keywords"]), linked, v["urlish"], v["phrase"])
        score, hits = ads.first_hits(x, r.level)
        if r.level:
            hits += self._elevated(r, x, score)
        accepted = ads.accept(hits)
        if accepted or linked:
            r.level, r.at = min(cfg.max_level, r.level + 1), at
            r.handles = list(dict.fromkeys([*r.handles, *(h for h in x.handles if len(h) >= 4)]))
            r.keywords = list(dict.fromkeys([*r.keywords, *(k for k in x.keywords if not is_weak(k))]))
            r.history = [*r.history, Print(x.form, x.handles)][-cfg.history :]
        return accepted, score

    def _elevated(self, r: Record, x: Signals, base: int) -> list[Hit]:
        cfg, hit, hits = self.cfg.ads, self.finder.ads.hit, []
        aimed = x.strong and bool(x.handles or x.urlish)
        if x.linked or aimed:
            hits.append(hit(x.text, "elevated-base", base + 10))
        for known in (h for h in r.handles if len(h) >= 4):
            if contains_spaced(x.form, known):
                hits.append(hit(x.text, f"known-handle:{known}", base + 50))
            if any(h == known or ad_similarity(h, known, 0.9) >= 0.9 for h in x.handles):
                hits.append(hit(x.text, f"handle-match:{known}", base + 55))
        if cfg.track_similarity and (x.strong or x.handles or x.linked or x.urlish or r.level >= 3):
            least = (cfg.similar_percent_high if r.level >= 3 else cfg.similar_percent) / 100
            for p in r.history:
                sim = ad_similarity(x.form, p.form, least)
                if sim >= least and min(len(x.form), len(p.form)) >= 8:
                    hits.append(hit(x.text, f"similar-ad:{int(sim * 100)}", base + int(sim * 40)))
                    break
                if known := next((h for h in p.handles if len(h) >= 4 and contains_spaced(x.form, h)), None):
                    hits.append(hit(x.text, f"history-handle:{known}", base + 50))
        if r.level >= 3 and (aimed or (x.strong and x.linked)):
            hits.append(hit(x.text, "elevated-strong", base + 20))
        return hits

    def step(self, state: Record, at: int, row: dict) -> tuple:
        """Blocked spans, the level after the message, its score. A message whose ads are null, where those are ready, is not looked at."""
        s = row["text"] or ""
        v = row["ads"] if self.ready else self.view(s)
        if v is None:
            return [], state.level, 0
        hits, score = self.evaluate(state, at, s, v)
        if not hits:
            return v["links"], state.level, score
        found = [Span(**m) for m in v["links"]]
        return [m._asdict() for m in disjoint([*found, *(Span(h.start, h.end, h.text) for h in hits)])], state.level, score

    def dump(self, state: Record) -> str:
        return json.dumps([state.level, state.at, state.history, state.handles, state.keywords])

    def load(self, text: str) -> Record:
        level, at, history, handles, keywords = json.loads(text)
        return Record(level, at, [Print(f, tuple(h)) for f, h in history], handles, keywords)


def ads(spark: SparkSession, cfg: Links = Links(), names: Iterable[str] = ()):
    """A function from a text column to what it says by itself, for a fold that is ready; null for null. Settings are broadcast."""
    sent = spark.sparkContext.broadcast((cfg, tuple(names)))

    @F.pandas_udf(ADS)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fold = SuspicionFold(*sent.value)
        for s in batches:
            yield pd.DataFrame([None if t is None else fold.view(t) for t in s], columns=list(fold.view("")), index=s.index) if len(s) else pd.DataFrame(columns=list(fold.view("")))

    once = look.asNondeterministic()
    return lambda c: F.when(c.isNotNull(), once(F.coalesce(c, F.lit(""))))


def suspicion(messages: DataFrame, cfg: Links = Links(), names: Iterable[str] = (), distinct: bool = True) -> DataFrame:
    """msg_id, ts, user_id, links, level and ad_score; with ``distinct`` each different text is looked at once and joined back by its digest."""
    if not distinct:
        return SuspicionFold(cfg, names).batch(messages)
    own = messages.select("msg_id", "ts", "user_id", text("text").alias("text")).withColumn("_key", F.coalesce(F.sha2("text", 256), F.lit("")))  # never null: else a filter for it parts the two scans
    once = own.select("_key", "text").dropDuplicates(["_key"]).select("_key", "text", ads(messages.sparkSession, cfg, names)(F.col("text")).alias("ads"))
    fold = SuspicionFold(cfg, names, True)
    return fold.batch(own.drop("text").join(once, "_key"))  # a text comes back with what it says, so rows go to the join without it
