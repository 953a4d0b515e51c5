"""Settings with their shipped defaults, and the small languages settings are written in."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from wardline import fixed

UNIT_MS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 365 * 86_400_000}


def duration_ms(text: str | None, default: int = 0) -> int:
    """Sum of all ``<number><unit>`` in a text; anything else in it is passed over; nothing found: the default."""
    found = sum(int(n) * UNIT_MS[u] for n, u in re.findall(r"(\d+)([smhdwy])", (text or "").lower()))
    return found or default


def clamp(value: int, low: int | None = None, high: int | None = None) -> int:
    if low is not None:
        value = max(low, value)
    return value if high is None else min(high, value)


def clean_list(values: Iterable[Any] | None) -> list[str]:
    """Trimmed, without blanks, each once, in order."""
    return list(dict.fromkeys(str(v).strip() for v in values or () if v is not None and str(v).strip()))


def dictionary(values: Iterable[Any] | None) -> list[str]:
    """As clean_list, lower-cased, two characters at least."""
    return list(dict.fromkeys(v.lower() for v in clean_list(values) if len(v) >= 2))


def lookup(tree: Mapping[str, Any], path: str, default: Any) -> Any:
    """The value at a dotted path if it has the default's type, else the default."""
    for key in path.split("."):
        if not isinstance(tree, Mapping) or key not in tree:
            return default
        tree = tree[key]
    if isinstance(default, bool) or isinstance(tree, bool):
        return tree if isinstance(tree, bool) and isinstance(default, bool) else default
    if isinstance(default, float) and isinstance(tree, int):
        return float(tree)
    return tree if default is None or isinstance(tree, type(default)) else default


def merged(defaults: Mapping[str, Any], user: Mapping[str, Any], keep_version: str = "version") -> tuple[dict[str, Any], bool]:
    """The user's tree with what it lacks filled in from the defaults; the defaults' version wins. Also whether anything changed."""
    out, changed = dict(user), False
    for key, value in defaults.items():
        if key == keep_version and out.get(key) != value:
            out[key], changed = value, True
        elif key not in out:
            out[key], changed = value, True
        elif isinstance(value, Mapping) and isinstance(out[key], Mapping):
            out[key], below = merged(value, out[key], "")
            changed |= below
    return out, changed


def version_number(value: Any) -> int:
    """Versions compare by tenths."""
    try:
        return round(float(value) * 10)
    except (TypeError, ValueError):
        return 0


def renamed(tree: Mapping[str, Any], moves: Mapping[str, str], rewrites: Mapping[str, str]) -> dict[str, Any]:
    """Flat settings with key prefixes moved and strings rewritten, in scalars and in lists."""

    def text(v: Any) -> Any:
        if isinstance(v, list):
            return [text(x) for x in v]
        for old, new in rewrites.items():
            v = v.replace(old, new) if isinstance(v, str) else v
        return v

    out = {}
    for key, value in tree.items():
        move = next((m for m in moves if key == m or key.startswith(m + ".")), None)
        out[key if move is None else moves[move] + key[len(move) :]] = text(value)
    return out


def load_yaml(path: str) -> dict[str, Any]:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


@dataclass(frozen=True)
class Words:
    enabled: bool = True
    mode: str = "send-and-notify"
    level: str = "high"
    mask: str = "*"
    keep_edges: bool = True
    words: tuple[str, ...] = ()
    safe: tuple[str, ...] = fixed.SAFE_WORDS

    @classmethod
    def blocked(cls, **more: Any) -> Words:
        return cls(**{"mode": "block-and-notify", "keep_edges": False, "words": fixed.BLOCKED_WORDS, "safe": ()} | more)

    @classmethod
    def of(cls, tree: Mapping[str, Any], kind: str = "bad-words") -> Words:
        """From a settings tree with the list ``kind``, bad-words or blocked-words; bad words have safe words too."""
        at, blocked = f"filter.{kind}.", kind == "blocked-words"
        return cls(
            enabled=lookup(tree, at + "enabled", True),
            mode=lookup(tree, at + "mode", "block-and-notify" if blocked else "send-and-notify").lower(),
            level=lookup(tree, at + "level", "high").lower(),
            mask=lookup(tree, at + "replacement", "*"),
            keep_edges=lookup(tree, at + "keep-edge-letters", not blocked),
            words=tuple(dictionary(lookup(tree, kind, []))),
            safe=() if blocked else tuple(dictionary(lookup(tree, "safe-words", []))),
        )


@dataclass(frozen=True)
class Ads:
    enabled: bool = True
    min_score: int = 70
    ttl_ms: int = 180_000
    history: int = 10
    max_level: int = 5
    similar_percent: int = 68
    similar_percent_high: int = 55
    track_similarity: bool = True
    whole_message: bool = True
    keywords: tuple[str, ...] = fixed.PROMO_KEYWORDS
    templates_on: bool = True
    template_percent: int = 72
    template_min_length: int = 12
    template_score: int = 78
    templates: tuple[str, ...] = fixed.TEMPLATES

    @classmethod
    def of(cls, tree: Mapping[str, Any]) -> Ads:
        """From a settings tree; percents within 10..100, counts and scores at least 1, lengths at least 6. What the tree lacks has the
        defaults of its precision, and templates are off."""
        get = lambda path, default: lookup(tree, "filter.adaptive-ad-filter." + path, default)
        precise = get("high-precision-mode", True)
        percent = lambda path, high, low: clamp(get(path, high if precise else low), 10, 100)
        least = clamp(get("min-score-to-block", 70 if precise else 50), 1)
        return cls(
            enabled=get("enabled", True),
            min_score=least,
            ttl_ms=duration_ms(get("suspicion-ttl", "45m"), 45 * 60_000),
            history=clamp(get("history-size", 10), 1),
            max_level=clamp(get("max-level", 5), 1),
            similar_percent=percent("elevated-similarity-percent", 68, 52),
            similar_percent_high=percent("high-similarity-percent", 55, 38),
            track_similarity=get("track-similarity", True),
            whole_message=get("block-whole-message", True),
            keywords=tuple(clean_list(get("promo-keywords", []))) or fixed.DEFAULT_KEYWORDS,
            templates_on=get("phrase-templates.enabled", False),
            template_percent=percent("phrase-templates.min-similarity-percent", 72, 62),
            template_min_length=clamp(get("phrase-templates.min-message-length", 12), 6),
            template_score=clamp(get("phrase-templates.hit-score", 78), least),
            templates=tuple(clean_list(get("phrase-templates.templates", []))) or fixed.DEFAULT_TEMPLATES,
        )


@dataclass(frozen=True)
class Links:
    enabled: bool = True
    mode: str = "block-and-notify"
    replacement: str = "[link removed]"
    regex: str = fixed.LINK
    list_on: bool = False
    list_mode: str = "whitelist"
    domains: tuple[str, ...] = ()
    smart: bool = True
    tlds: tuple[str, ...] = fixed.TLDS
    triggers: tuple[str, ...] = fixed.QUICK_TRIGGERS
    min_parts: int = 2
    real_tld: bool = True
    ads: Ads = field(default_factory=Ads)

    @classmethod
    def of(cls, tree: Mapping[str, Any]) -> Links:
        get, lower = (lambda path, default: lookup(tree, "filter." + path, default)), (lambda values: tuple(v.lower() for v in clean_list(values)))
        return cls(
            enabled=get("links.enabled", True),
            mode=get("links.mode", "block-and-notify").lower(),
            replacement=get("links.replacement", cls.replacement),
            regex=get("links.regex", fixed.LINK),
            list_on=get("links.list-filter.enabled", False),
            list_mode=get("links.list-filter.mode", "whitelist").lower(),
            domains=tuple(clean_list(get("links.list-filter.domains", []))),
            smart=get("smart-detection.enabled", True),
            tlds=lower(get("smart-detection.tlds", [])),
            triggers=lower(get("smart-detection.quick-triggers", [])),
            min_parts=get("smart-detection.min-domain-parts", 2),
            real_tld=get("smart-detection.require-real-tld", True),
            ads=Ads.of(tree),
        )


@dataclass(frozen=True)
class Caps:
    enabled: bool = True
    mode: str = "replace-and-notify"
    min_length: int = -1
    percent: int = 70
    letters_only: bool = True
    whitelist: tuple[str, ...] = fixed.CAPS_WHITELIST
    #: Which side acts when a message has caps and words: "badwords"/"blockedwords", "caps" or "both"; for notices and for the text.
    notify_bad: str = "badwords"
    notify_blocked: str = "blockedwords"
    filter_bad: str = "both"
    filter_blocked: str = "both"

    @classmethod
    def of(cls, tree: Mapping[str, Any]) -> Caps:
        """From a settings tree; the percent within 0..100, the length at least 1 unless it is -1."""
        get = lambda path, default: lookup(tree, "filter.caps." + path, default)
        length = get("min-length", 5)
        return cls(
            enabled=get("enabled", False),
            mode=get("mode", "replace-and-notify").lower(),
            min_length=-1 if length == -1 else clamp(length, 1),
            percent=clamp(get("max-caps-percent", 70), 0, 100),
            letters_only=get("ignore-non-letters", True),
            whitelist=tuple(clean_list(get("whitelist", []))),
            notify_bad=get("badwords-priority.notification-priority", "badwords").lower(),
            notify_blocked=get("blockedwords-priority.notification-priority", "blockedwords").lower(),
            filter_bad=get("badwords-priority.filter-priority", "both").lower(),
            filter_blocked=get("blockedwords-priority.filter-priority", "both").lower(),
        )

    @property
    def shortest(self) -> int:
        return 1 if self.min_length == -1 else self.min_length


@dataclass(frozen=True)
class Spam:
    """Times in milliseconds; a limit of 0 or less is none."""

    enabled: bool = True
    dedupe_ms: int = 150
    lock_ms: int = 300_000
    cooldown_ms: int = 3_000
    cooldown_min: int = 0
    cooldown_max: int = 0
    similar_ms: int = 10_000
    similar_percent: int = 75
    similar_min: int = 10
    similar_max: int = 0
    flood_chars: int = 5
    flood_patterns: int = 3
    flood_ms: int = 8_000
    history: int = 8
    state_ttl_ms: int = 600_000

    @classmethod
    def of(cls, tree: Mapping[str, Any]) -> Spam:
        """From a settings tree; percent within 50..100, characters at least 2, patterns at least 1."""
        d = cls()
        return cls(
            enabled=lookup(tree, "filter.enabled", d.enabled),
            lock_ms=duration_ms(lookup(tree, "filter.new-player-chat-lock.time", ""), d.lock_ms),
            cooldown_ms=1000 * clamp(lookup(tree, "filter.general-cooldown.seconds", d.cooldown_ms // 1000), 0),
            similar_ms=1000 * clamp(lookup(tree, "filter.similar-message-cooldown.seconds", d.similar_ms // 1000), 0),
            similar_percent=clamp(lookup(tree, "filter.similar-message-cooldown.similarity-percent", d.similar_percent), 50, 100),
            similar_min=lookup(tree, "filter.similar-message-cooldown.min-length", d.similar_min),
            flood_chars=clamp(lookup(tree, "filter.character-flood.max-characters", d.flood_chars), 2),
            flood_patterns=clamp(lookup(tree, "filter.character-flood.max-patterns", d.flood_patterns), 1),
            flood_ms=1000 * clamp(lookup(tree, "filter.character-flood.cooldown-seconds", d.flood_ms // 1000), 0),
        )


@dataclass(frozen=True)
class Settings:
    bad: Words = field(default_factory=Words)
    blocked: Words = field(default_factory=Words.blocked)
    links: Links = field(default_factory=Links)
    caps: Caps = field(default_factory=Caps)
    spam: Spam = field(default_factory=Spam)
    stages: tuple[int, ...] = (1, 3, 5, 7)
    commands: tuple[str, ...] = fixed.COMMANDS

    @classmethod
    def of(cls, trees: Mapping[str, Mapping[str, Any]]) -> Settings:
        """From the trees of the files bad-words, blocked-words, links, caps and spam; a file that is not there is an empty one."""
        tree = lambda name: trees.get(name, {})
        return cls(
            bad=Words.of(tree("bad-words")),
            blocked=Words.of(tree("blocked-words"), "blocked-words"),
            links=Links.of(tree("links")),
            caps=Caps.of(tree("caps")),
            spam=Spam.of(tree("spam")),
        )
